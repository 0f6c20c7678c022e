"""Pairs of members of one group, spread over many tasks even when one group is huge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 512


def member_pairs(df: DataFrame, group: str, member: str, carry: list[str] = (),
                 block: int = BLOCK) -> DataFrame:
    """All (a < b) pairs of distinct members per group.

    A group of n members is cut into ceil(n / block) hash blocks and every pair of blocks is its
    own join key, so no key holds more than about two blocks. Groups of one block, the usual case,
    are not copied at all. ``df`` must hold each (group, member) once.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_s"))
    placed = df.join(sizes, group).select(
        group, F.col(member).alias("_m"), *carry,
        F.pmod(F.xxhash64(member), F.col("_s")).cast("int").alias("_b"),
        F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_o"))
    keyed = placed.select(
        group, "_m", "_b", *carry,
        F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    left = keyed.withColumnRenamed("_m", "a").withColumnRenamed("_b", "_ba")
    right = keyed.select(group, "_lo", "_hi", F.col("_m").alias("b"), F.col("_b").alias("_bb"))
    return (left.join(right, [group, "_lo", "_hi"])
            .filter((F.col("a") < F.col("b"))
                    & (F.least("_ba", "_bb") == F.col("_lo"))
                    & (F.greatest("_ba", "_bb") == F.col("_hi")))
            .select(group, "a", "b", *carry))


def salted_join(big: DataFrame, small: DataFrame, on: str, spread_by: str, salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Equi join where ``big`` has hot keys: its rows spread over ``salts`` sub-keys by the hash
    of ``spread_by`` and ``small`` is repeated for each of them."""
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [on, "_salt"], how).drop("_salt")
