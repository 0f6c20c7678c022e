"""Merkle manifest of a table of documents, with a proof for every row.

Leaves are digests of rows. Within a source they ascend by id; every ``FAN`` consecutive nodes become one
until one is left, the source's subroot; subroots, ordered by source, become the root the same way.

Checkpoint and recompute: only every ``STEP``-th level is stored (``Tree.tiers``), as Parquet in the shared
folder. Nodes fall into aligned subtrees of ``FAN ** STEP`` stored descendants. One group is one subtree, so a hot
source is as many groups as it has subtrees, and no group exceeds that size. A proof regenerates the levels
between two stored ones inside the group, emits the siblings of each descendant and drops the rest; the siblings further
up come from the subtree's own proof one tier above, joined once per subtree. All of it is DataFrame expressions.

Defined results: a null field is ``-`` and so differs from an empty one (``0:``); null sources come first and form a source
of their own; a null id comes first in its source; rows equal in source and id follow by leaf, and rows equal in all
fields are interchangeable, each with a place and proof of its own; a source of one row has its leaf as subroot; an
empty table has no rows and no root; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ropewalk.session import durable

FAN = 3          # nodes under one node
STEP = 4         # levels between two stored ones
RANGE = 1 << 20  # nodes ranked together
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value, so that no two rows read alike."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(**changed: Column) -> Column:
    """Digest of a document row; ``changed`` replaces the named fields."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes(key, ...)`` with ``rank`` within ``key`` by ``order`` and ``total``, the nodes of the key.

    Ranges of (key, order) are numbered one by one and shifted by the counts of the ranges before, so no key is
    sorted in one task. Rows equal in ``order`` are told apart by their place in the stored input.
    """
    spark = nodes.sparkSession
    stored = durable(nodes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() // RANGE + 1)
    by = ["key", *order, "_tie"]
    cut = durable(stored.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by)
                  .withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy("key")  # one row per range that holds rows of the key
    shift = cut.groupBy("key", "_range").agg(F.count("*").alias("_n")).select(
        "key", "_range", F.sum("_n").over(whole).alias("total"),
        (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("key", "_range").orderBy(*order, "_tie"))
    return cut.withColumn("_in", inside).join(shift, ["key", "_range"]).select(
        *nodes.columns, (F.col("_before") + F.col("_in") - 1).alias("rank"), "total")


def above(nodes: Column) -> Column:
    """One level up: the digests of every ``FAN`` consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def height(total: Column) -> Column:
    """Levels over ``total`` nodes until one is left, at most ``STEP``."""
    out = F.lit(STEP)
    for levels in reversed(range(STEP)):
        out = F.when(total <= FAN ** levels, levels).otherwise(out)
    return out


def subtrees(tier: DataFrame) -> DataFrame:
    """The aligned subtrees of a tier: key, block, total, height and ``items``, their nodes in order."""
    rest = [c for c in tier.columns if c not in ("key", "rank", "total")]
    return (tier.groupBy("key", F.floor(F.col("rank") / FAN ** STEP).cast("long").alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("rank", *rest))).alias("items"), F.first("total").alias("total"))
            .withColumn("height", height(F.col("total"))))


def with_levels(groups: DataFrame) -> DataFrame:
    """The regenerated levels of each subtree as ``_0`` (stored) to ``_STEP``."""
    out = groups.withColumn("_0", F.col("items.node"))
    for j in range(STEP):
        out = out.withColumn(f"_{j + 1}", F.when(F.col("height") > j, above(F.col(f"_{j}"))).otherwise(F.col(f"_{j}")))
    return out


@dataclass
class Tree:
    """``tiers[t]`` stores level ``t * STEP`` as (key, rank, total, node); tier 0 may have further columns."""

    tiers: list[DataFrame]

    @property
    def tops(self) -> DataFrame:
        """(key, node): the node that each key is left with."""
        return self.tiers[-1].select("key", "node")


def tree(leaves: DataFrame, order: list[str]) -> Tree:
    """Stored tiers over ``leaves(key, node, ...)``, each key a tree of its own."""
    tiers = [durable(ranked(leaves, order))]
    most = tiers[0].agg(F.max("total")).first()[0] or 0
    while most > 1:
        groups = with_levels(subtrees(tiers[-1].select("key", "rank", "total", "node")))
        tiers.append(durable(groups.select(
            "key", F.col("block").alias("rank"), F.ceil(F.col("total") / FAN ** STEP).cast("long").alias("total"),
            F.element_at(f"_{STEP}", 1).alias("node"))))
        most = -(-most // FAN ** STEP)
    return Tree(tiers)


def siblings(level: int, at: Column) -> Column:
    """The nodes beside the ancestor, ``level`` levels up, of the node at ``at``: digests left and right of it."""
    nodes, place = F.col(f"_{level}"), F.floor(at / FAN ** level).cast("int")
    start = place - place % FAN
    return F.struct(F.array_join(F.slice(nodes, start + 1, place - start), "").alias("left"),
                    F.array_join(F.slice(nodes, place + 2, start + FAN - 1 - place), "").alias("right"))


def proofs(t: Tree, tops: DataFrame, carried: list[str]) -> DataFrame:
    """Proof of every leaf: the further columns of tier 0, ``node``, ``path`` (one struct of left and right siblings per
    level, bottom up) and ``carried``. ``tops(key, path, *carried)`` holds what follows over each key's last node."""
    over = tops.select("key", F.lit(0).cast("long").alias("block"), "path", *carried)
    for i, tier in reversed(list(enumerate(t.tiers))):
        rest = [c for c in tier.columns if c not in ("key", "rank", "total")] if i == 0 else []
        groups = with_levels(subtrees(tier)).join(
            over.withColumnRenamed("path", "_up"), ["key", "block"])

        def proof(item: Column, at: Column) -> Column:
            own = F.slice(F.array(*[siblings(j, at) for j in range(STEP)]), 1, F.col("height"))
            return F.struct(item.getField("rank").alias("block"), *[item.getField(c).alias(c) for c in rest],
                            F.concat(own, F.col("_up")).alias("path"))

        over = groups.select("key", F.inline(F.transform("items", proof)), *carried)
    return over.drop("block")


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda at, s: digest(s.getField("left"), at, s.getField("right")))


def path_digest(path: Column) -> Column:
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.getField("left"), s.getField("right"))), ""), 256)


def manifest(leaves: DataFrame, source: str = "source", order: str = "doc_id") -> DataFrame:
    """``leaves(doc_id, source, leaf, ...)`` with ``path``, ``subroot`` and ``root``."""
    key = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source)))
    own = [c for c in leaves.columns if c != "leaf"]
    rows = tree(leaves.select(key.alias("key"), F.col("leaf").alias("node"), *own), [order, "node"])
    sources = tree(rows.tops.select(F.lit(0).alias("key"), "node", F.col("key").alias("name")), ["name"])
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = proofs(sources, sources.tops.select("key", none.alias("path"), F.col("node").alias("root")), ["root"])
    tops = durable(over.select(F.col("name").alias("key"), "path", F.col("node").alias("subroot"), "root"))
    return proofs(rows, tops, ["subroot", "root"]).select(*own, F.col("node").alias("leaf"), "path", "subroot", "root")


def tampered() -> Column:
    """Rows whose text has lost its line ends: ids whose checksum is even."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Per document its leaf, subroot, root, digest of its proof, the root its (tampered) row leads to and whether it is the root."""
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    changed = tampered() & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    leaves = docs.select("doc_id", "source", leaf().alias("leaf"), F.when(changed, leaf(text=cut)).alias("seen"))
    folded = fold(F.coalesce("seen", "leaf"), F.col("path"))
    out = manifest(leaves).select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root",
        path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
