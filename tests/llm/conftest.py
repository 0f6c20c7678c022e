import pytest

from ropewalk.session import durable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text, lang, source) as a documents table with columns whose names clash with inner ones."""
    def build(rows, clash=True):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
        if clash:
            df = df.selectExpr("*", "1 AS host", "'x' AS path", "2 AS n", "'y' AS ids", "3 AS size", "4 AS b", "5 AS a",
                               "6 AS uid", "7 AS token", "8 AS n_words", "9 AS copies", "'z' AS decoded")
        return durable(df)
    return build


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
