import numpy as np
import pytest
from pyspark.sql import functions as F

from ropewalk.llm import quality

from .cases import ODD


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return quality.report(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_poor_and_clean_documents(judged):
    out = judged[judged.held_out]
    assert len(out) > 60
    assert out[out.quality == 0].rejected.mean() > 0.95
    assert out[(out.quality == 1) & (out.toxic == 0)].rejected.mean() < 0.03


def test_toxic_documents(judged):
    bad = judged[(judged.toxic == 1) & (judged.quality == 1)]
    assert bad.rejected.mean() > 0.6 and bad.p_toxic.mean() > 10 * judged[judged.toxic == 0].p_toxic.mean()


def test_odd_rows_and_labels(docs_of, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, None, None), (None, 0, 0), (7, 1, 0), (99, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.report(docs_of(ODD), labels)
    assert got.count() == len(ODD)
    df = docs_of(ODD)
    kept = quality.filtered(df, labels)
    assert kept.columns == df.columns and kept.filter("host <> 1 OR path <> 'x'").count() == 0


def test_without_labels_all_stay(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.filtered(docs_of(ODD), none).count() == len(ODD)
    assert quality.report(docs_of(ODD).limit(0), none).count() == 0
    one = spark.createDataFrame([(4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.filtered(docs_of(ODD), one).count() == len(ODD)


def test_sparse_sites_shrink_to_the_prior(spark):
    rng = np.random.default_rng(0)
    rows = []
    for h in range(60):
        rate = 0.9 if h % 3 == 0 else 0.05
        rows += [(f"h{h}", f"p{i % 2}", float(rng.random() < rate)) for i in range(200)]
    rows += [("tiny", "p", 1.0), (None, None, 0.0)]
    got = {(r.host, r.path): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, _chance double")).collect()}
    prior = got[("tiny", "p")].global_rate
    assert got[("h0", "p0")].path_rate > 0.75 and got[("h1", "p0")].path_rate < 0.15
    assert abs(got[("tiny", "p")].path_rate - prior) < 0.5 < abs(1.0 - prior)
    assert (None, None) in got


def test_statistics_count_bytes():
    texts = [b"AB!! cd cd cd", b"", "é|x\n".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = quality.statistics(data, offsets)
    assert got[0, :6] == pytest.approx([2 / 13, 6 / 13, 0, 2 / 13, 0, 0])
    assert got[2, 4:6] == pytest.approx([1 / 5, 2 / 5]) and got[1].sum() == 0
    assert got[0, -2] == pytest.approx(2 / 4) and got[0, -1] == pytest.approx(2 / 4)
