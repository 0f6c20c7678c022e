import zlib

import numpy as np
import pyarrow as pa
import pytest

from ropewalk.llm import langid

from .cases import ODD


def test_model_is_a_distribution():
    words = pa.array(["the", "then", "than", "cat", "the"], pa.large_string())
    keys, _ = langid.keys_of(words)
    grams, n = np.unique(keys, return_counts=True)
    model = langid.fit({"xx": (grams, n)})
    units = np.unique(grams & np.uint64(0xFFFF))
    for context in [*np.unique(grams >> np.uint64(16)), np.uint64(123456)]:
        p = np.exp(model.log_probs((context << np.uint64(16)) | units)).sum()
        # the uniform base keeps one share for units never seen
        assert 0.9 < p <= 1.0001


def test_keys_follow_code_points():
    keys, cut = langid.keys_of(pa.array(["é1", "", "\U0001F600"], pa.large_string()))
    assert cut.tolist() == [0, 3, 4, 6]
    unit = lambda k: [(int(k) >> s) & 0xFFFF for s in (48, 32, 16, 0)]
    assert [unit(k) for k in keys] == [[2, 2, 2, 0xE9], [2, 2, 0xE9, 48], [2, 0xE9, 48, 2], [2, 2, 2, 2],
                                       [2, 2, 2, 0xFFFF], [2, 2, 0xFFFF, 2]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    right = [r.score for r in got if r.lang_pred == r.lang]
    assert sum(right) / len(right) > 0.9


def test_odd_rows(docs_of):
    got = langid.identify(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    und = [r for r in got if r.lang_pred == "und"]
    assert sorted((r.doc_id for r in und), key=str) == [1, 2, 3, 5, None] and all(r.score == 0 for r in und)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_without_training_texts(docs_of):
    got = langid.identify(docs_of([(2, "some words", None, "s"), (3, None, "en", "s")])).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(2, "und", 0.0), (3, "und", 0.0)}
    assert langid.identify(docs_of(ODD).limit(0)).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, sample):
    fold = "crc32(cast(doc_id AS string)) % 3 = 1"
    other = sample.selectExpr("doc_id", "text", f"CASE WHEN {fold} THEN 'zz' ELSE lang END AS lang", "source")
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect())
    assert key(sample) == key(other)


def test_every_language_and_gram_counts(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2, raising=False)  # once the languages and n-grams that were kept
    monkeypatch.setattr(langid.train, "__defaults__", (300, 2) if langid.train.__defaults__ else None)
    text = lambda c: " ".join(f"{c}{x}{c * 2}{y}" for x in "aeiou" for y in "klmn")
    docs = docs_of([(i, text("bdfg"[i % 4]), "bdfg"[i % 4], "s") for i in range(24)])
    got = langid.identify(docs).collect()
    assert all(r.lang_pred == "bdfg"[r.doc_id % 4] for r in got)


@pytest.mark.parametrize("shipped", [1, 2_000])
def test_model_in_tables_equals_shipped_model(docs_of, sample, monkeypatch, shipped):
    docs = [docs_of(ODD), sample.select("doc_id", "text", "lang", "source")]
    key = lambda r: (str(r.doc_id), str(r.held_out), r.lang_pred, str(r.rejected), r.score)
    want = [sorted(map(key, langid.identify(d).collect())) for d in docs]
    monkeypatch.setattr(langid, "MAX_ROWS", shipped)
    for d, w in zip(docs, want):
        got = sorted(map(key, langid.identify(d).collect()))
        assert [g[:4] for g in got] == [x[:4] for x in w]
        assert [g[4] for g in got] == pytest.approx([x[4] for x in w], abs=1e-3)


def test_rows_without_a_label_teach_nothing(docs_of, sample):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sample.filter("text IS NOT NULL").collect()]
    more = [(10 ** 6 + i, " ".join(t.split()[::-1])[:400] + " zzz qqq", None, s) for i, t, _, s in rows[:60]]
    score = lambda d: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(d).collect() if r.doc_id < 10 ** 6}
    assert score(docs_of(rows)) == score(docs_of(rows + more))
