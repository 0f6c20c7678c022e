import hashlib

import pytest

import corpus_pipeline
from ropewalk.llm import mixing
from ropewalk.session import durable

from .cases import jaccard_roots, kept_words, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_columns(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_rows_as_they_are(stages):
    assert stages[1].exceptAll(stages[0]).count() == 0 and 0 < stages[1].count() <= stages[0].count()


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == set(jaccard_roots(rows, 5, 80).values())


def test_passages_go(stages):
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    want = kept_words(list(rows.items()), 50)
    got = {r.doc_id: r for r in stages[3].collect()}
    assert set(got) == set(rows)
    for i, w in want.items():
        assert got[i].text == (rows[i] if len(w) == len(words(rows[i])) else b" ".join(w).decode())
        assert got[i].n_chars == len(got[i].text)


def test_mixture_repeats_rows(stages):
    plan = {r.doc_id: r.copies for r in mixing.copies(stages[3]).collect()}
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: c for i, c in plan.items() if c}


def test_tokens_decode_to_the_texts(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
