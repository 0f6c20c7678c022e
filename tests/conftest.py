import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ropewalk.session import get_spark, scratch_root  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4",
                                          "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    scratch_root(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)
    return build


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
