"""Byte-level BPE encoding and decoding with a given public vocabulary.

``encode`` adds the token ids of every whole text, ``decode`` turns ids back into text. Merging works on
many distinct pieces at once: the symbols of all pieces lie in one flat array, each round looks up every
adjacent pair by binary search over the sorted pair keys, finds the lowest rank per piece and merges
its occurrences from the left. Pieces that can merge no further leave the array.

Defined results: a null or empty text has no ids (an empty array); null ids decode to an empty text;
bytes that are not UTF-8 decode to U+FFFD. Only ``text`` (or ``ids``) is read, all columns are kept, and rows
are independent of each other, so repeated rows and ties give repeated results. A column of the output
name is replaced.

The vocabulary is read on the driver and shipped once; it is bounded by its file. A worker
remembers at most ``MEMORY`` distinct pieces between batches.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from . import flat

MEMORY = 200_000
#: Pieces longer than this are encoded but not remembered.
LONGEST = 64
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def printable_bytes() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Merge table sorted by pair key, and the bytes of each id."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    pieces: list[bytes]
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], printable_bytes()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        byte_ids = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            byte_ids[b] = vocab[c]
        return cls(keys[order], order.astype(np.int64),
                   np.array([vocab[a + b] for a, b in pairs], np.int64)[order], byte_ids, pieces, special)


NONE = np.int64(1 << 40)


def merge_rounds(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces given as bytes and offsets: (flat ids, offsets)."""
    count = len(offsets) - 1
    symbols = vocab.byte_ids[data]
    owner = np.repeat(np.arange(count), np.diff(offsets))
    rank, target = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)

    def look_up(at: np.ndarray) -> None:
        """Rank and merged symbol of the pairs that begin at ``at``."""
        pair = (symbols[at] << np.int64(32)) | symbols[at + 1]
        found = np.minimum(np.searchsorted(vocab.keys, pair), len(vocab.keys) - 1)
        rank[at] = np.where((vocab.keys[found] == pair) & (owner[at] == owner[at + 1]), vocab.ranks[found], NONE)
        target[at] = vocab.merged[found]

    look_up(np.arange(len(symbols) - 1))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank, heads)
        best = np.repeat(best, np.diff(np.concatenate([heads, [len(symbols)]])))
        stuck = best == NONE
        if stuck.any():
            done.append((owner[stuck], symbols[stuck]))
            live = ~stuck
            symbols, owner, rank, target, best = symbols[live], owner[live], rank[live], target[live], best[live]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == best)
        # in a run of overlapping hits every second one merges, from the left
        first = np.concatenate([[True], np.diff(hit) != 1])
        run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        symbols[hit] = target[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
        symbols, owner, rank, target = symbols[keep], owner[keep], rank[keep], target[keep]
        rank[hit] = NONE
        changed = np.concatenate([hit[hit > 0] - 1, hit[hit < len(symbols) - 1]])
        look_up(changed)
    if not done:
        return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
    owners = np.concatenate([o for o, _ in done])
    ids = np.concatenate([s for _, s in done]).astype(np.int32)
    order = np.argsort(owners, kind="stable")
    out = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=count), out=out[1:])
    return ids[order], out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` of many slices."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Encoder:
    """Splits texts into pieces and encodes each distinct piece once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.cut = regex.compile(PIECES)
        self.at_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")"
        ) if vocab.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        for token in self.vocab.special:
            self.index[token]
        self.ids = np.array(list(self.vocab.special.values()), np.int32)
        self.starts = np.arange(len(self.ids), dtype=np.int64)
        self.sizes = np.ones(len(self.ids), np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.at_special is None or not any(t in text for t in self.vocab.special):
            return self.cut.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.at_special.split(text)):
            out.extend([part] if i % 2 else self.cut.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and text offsets."""
        if len(self.index) > MEMORY:
            self.forget()
        known, flat_pieces, cuts = len(self.index), [], [0]
        for text in texts:
            flat_pieces += self.pieces(text)
            cuts.append(len(flat_pieces))
        at = np.fromiter(map(self.index.__getitem__, flat_pieces), np.int64, len(flat_pieces))
        new = list(self.index)[known:] if len(self.index) > known else []
        if new:
            raw = [p.encode("utf-8", "surrogatepass") for p in new]
            offsets = np.zeros(len(raw) + 1, np.int64)
            np.cumsum([len(r) for r in raw], out=offsets[1:])
            ids, cut = merge_rounds(self.vocab, np.frombuffer(b"".join(raw), np.uint8), offsets)
            self.starts = np.concatenate([self.starts, len(self.ids) + cut[:-1]])
            self.sizes = np.concatenate([self.sizes, np.diff(cut)])
            self.ids = np.concatenate([self.ids, ids])
        sizes = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = gather(self.ids, self.starts[at], sizes), total[np.array(cuts)]
        if new and max(map(len, new)) > LONGEST:
            self.forget()
        return out


def _set_column(batch: pa.RecordBatch, name: str, values: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    cols = {f: batch.column(f) for f in batch.schema.names if f != name} | {name: values}
    return pa.RecordBatch.from_arrays([cols[f] for f in schema.names], names=schema.names)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add the array ``ids`` of the token ids of ``text``; special strings count as special tokens."""
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    schema = T.StructType([f for f in df.schema.fields if f.name != ids]
                          + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            for lo, hi, _, _ in flat.text_chunks(batch.column(text), 2 << 20):
                part = batch.slice(lo, hi - lo)
                got, cut = encoder.encode([t or "" for t in part.column(text).to_pylist()])
                values = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(got, pa.int32()))
                yield _set_column(part, ids, values, _names(names))

    return df.mapInArrow(run, schema)


class Decoder:
    """Bytes of token ids, gathered from one flat table."""

    def __init__(self, pieces: list[bytes]):
        self.at = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.at[1:])
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        sizes = np.diff(self.at)[ids]
        raw = gather(self.table, self.at[ids], sizes).tobytes()
        cut = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``text``, the decoding of ``ids`` with special tokens kept."""
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path).pieces)
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                col = part.column(ids)
                sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()])
                out = decoder.decode(col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                yield _set_column(part, text, pa.array(out, pa.string()), _names(names))

    return df.mapInArrow(run, schema)


def _names(names: list[str]) -> pa.Schema:
    return pa.schema([(n, pa.null()) for n in names])


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded",
               path: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows; ``text`` itself is dropped."""
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    schema = T.StructType([f for f in df.schema.fields if f.name not in (text, ids, decoded)]
                          + [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shipped.value), Decoder(shipped.value.pieces)
        for batch in batches:
            for lo, hi, _, _ in flat.text_chunks(batch.column(text), 2 << 20):
                part = batch.slice(lo, hi - lo)
                got, cut = encoder.encode([t or "" for t in part.column(text).to_pylist()])
                cols = {f: part.column(f) for f in part.schema.names}
                cols[ids] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(got, pa.int32()))
                cols[decoded] = pa.array(decoder.decode(got, cut), pa.string())
                yield pa.RecordBatch.from_arrays([cols[f] for f in names], names=names)

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and SHA-256 of the ids and of the decoded text of every document."""
    return round_trip(docs.select("doc_id", "text"), path=path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
