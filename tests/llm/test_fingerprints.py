import hashlib

import numpy as np
import pyarrow as pa
import pytest

from ropewalk.llm import fingerprints as fp, flat

from .cases import ODD, shingle_set


def jaccard(a, b):
    a, b = shingle_set(a, 5), shingle_set(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_plain_order(spark, sample):
    got = {r.doc_id: r for r in fp.with_next(sample).collect()}
    rows = sorted(((r.doc_id, r.text) for r in sample.collect()), reverse=True)
    assert len(got) == len(rows)
    errors = []
    for (i, text), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        r, new = got[i], fp.edited(text, nxt)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, new), r.near_next - jaccard(text, nxt)]
    assert np.abs(errors).max() < 0.25 and np.abs(np.mean(errors)) < 0.01


def test_odd_rows(docs_of):
    got = fp.with_next(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    empty = {r.fingerprint for r in got if r.n_chars == 0}
    assert len(empty) == 1
    assert len({r.fingerprint for r in got if r.doc_id == 4 and r.n_chars == 3}) == 1
    assert sorted(r.n_chars for r in got) == sorted(len(r[1] or "") for r in ODD)
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))


def test_one_row_and_none(docs_of):
    r = fp.with_next(docs_of([(5, "abcdef", "en", "s")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
    assert fp.with_next(docs_of(ODD).limit(0)).count() == 0


def test_words_and_shingles_are_exact():
    texts = ["", " a  b\tc ", "One two THREE four five six", "x", "é日 本"]
    for lo, hi, data, offsets in flat.text_chunks(pa.array(texts), 1):
        w = flat.words(data, offsets, lower=True)
        assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)] == texts[lo].encode().lower().split()
        hashes, at = flat.shingles(w, 5)
        assert at.tolist() == [0, len(shingle_set(texts[lo], 5))] and len(set(hashes.tolist())) == len(hashes)
    assert [hi - lo for lo, hi, *_ in flat.text_chunks(pa.array(texts), 10 ** 6)] == [5]


def test_near_duplicates_by_bands(docs_of):
    from .cases import copied_texts, jaccard_roots

    rows = copied_texts(150, seed=9, size=(30, 90), noise=0.01)
    got = {r.doc_id: r.component_id for r in fp.near_duplicates(docs_of([(i, t, "en", "s") for i, t in rows])).collect()}
    want = jaccard_roots(rows, 5, 80)
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.97
    assert all(want[got[i]] == want[i] for i in want)  # no link below the threshold
