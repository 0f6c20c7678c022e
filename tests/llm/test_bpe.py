import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ropewalk.llm import bpe

from .cases import ODD


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


ENCODER = bpe.Encoder(bpe.Vocabulary.load())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_ids_are_the_librarys(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, cut = ENCODER.encode(texts)
    for i, text in enumerate(texts):
        assert ids[cut[i]:cut[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "aaaaaaaaaaaaaaab", "x<|endoftext|><|endoftext|> y", "  \n\n  x", "I'll don't 'S", "\x1c\x1d a\x85b᠎​ c",
    "ab" * 5000, "日本語テスト 123４５", ""])
def test_hard_pieces(library, text):
    ids, _ = ENCODER.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_piece_by_rounds(library):
    text = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 20_000))
    assert ENCODER.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_table(docs_of, library):
    got = bpe.digests(docs_of(ODD)).collect()
    want = []
    for i, text, *_ in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(out.encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_empty_table_and_kept_columns(docs_of):
    df = docs_of(ODD).limit(0)
    assert bpe.digests(df).count() == 0
    coded = bpe.decode(bpe.encode(docs_of(ODD)))
    assert coded.count() == len(ODD) and {"host", "path", "ids", "decoded"} <= set(coded.columns)
    assert coded.filter("text IS NOT NULL AND text <> decoded").count() == 0


def test_cut_ids_decode_to_replacement(spark):
    half = ENCODER.encode(["日"])[0][:1].tolist()
    df = spark.createDataFrame([(1, half), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(df).collect()} == {1: b"\xe6\x97".decode("utf-8", "replace"), 2: "", 3: ""}
