"""Hashed bag-of-words vectors and the dot product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import tokens


def hash_bucket(token: Column, dim: int = 256) -> Column:
    """md5(token) mod dim, folded over 32-bit words so that it stays in long arithmetic."""
    digest = F.md5(token.cast("binary"))

    def word(i):
        return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")

    if (1 << 32) % dim == 0:  # higher words vanish
        return F.pmod(word(3), F.lit(dim)).cast("int")
    rest = F.lit(0).cast("long")
    for i in range(4):
        rest = F.pmod(rest * F.lit(1 << 32) + word(i), F.lit(dim).cast("long"))
    return rest.cast("int")


def hash_embed(df: DataFrame, id_col: str, text: Column | str, dim: int = 256) -> DataFrame:
    """Sparse unit vectors: one row per (id, bucket) with its weight.

    The (id, bucket) counts combine on the map side; the norm is a second small aggregate, and no
    per-record list is built.
    """
    counts = (
        df.select(F.col(id_col), F.explode(tokens(text)).alias("_t"))
        .groupBy(id_col, hash_bucket(F.col("_t"), dim).alias("bucket"))
        .agg(F.count("*").alias("tf"))
    )
    norms = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("_norm"))
    return counts.join(norms, id_col).select(
        id_col, "bucket", (F.col("tf") / F.col("_norm")).alias("w"))


def hash_embed_packed(df: DataFrame, id_col: str, text: Column | str, dim: int = 256) -> DataFrame:
    """One row per id with ``buckets`` and ``tf`` arrays sorted by bucket, at most ``dim`` long."""
    counts = (
        df.select(F.col(id_col), F.explode_outer(tokens(text)).alias("_t"))
        .groupBy(id_col, hash_bucket(F.col("_t"), dim).alias("bucket"))
        .agg(F.count("_t").alias("tf"))
    )
    packed = counts.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(),
                                           F.struct("bucket", "tf")))).alias("_e"))
    return packed.select(id_col, F.col("_e.bucket").alias("buckets"), F.col("_e.tf").alias("tf"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays over their common length; unit vectors make it the cosine."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))),
        F.lit(0.0), lambda s, v: s + v)
