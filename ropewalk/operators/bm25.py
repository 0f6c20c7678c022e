"""A stored BM25 index and exact top-k search that skips blocks of records.

Records lie in blocks of ``BLOCK``, close in length (or in what the caller clusters by). The index is

- ``postings(token, blk, id, ord, len, tf)``, bucketed by (token, blk), so that a search joins it without shuffling it and a
  frequent token is spread over all buckets;
- ``blocks(token, blk, n, max_tf, min_len)``, one row for the postings of a token in a block, bucketed by token;
- ``docs(id, ord, len, blk)`` and ``terms(token, df, idf)``.

New records are appended as a segment: their own postings and blocks are written, those of earlier records are not touched,
only ``terms`` (the vocabulary) is written anew. A segment counts once its row in ``versions`` is written, the
last step, so a search never sees half of one. ``merge`` brings the files of all segments together.

A search adds up, per task and block, the most that a record of the block can score, scores the blocks with the highest sums
and the records that lead without any match, takes the k-th best score so found, and then scores only blocks that can still
reach it. The result is exact; what a task reads is bounded by blocks, not by the length of its posting lists.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import ws_tokens
from ..session import durable, scratch_path
from .ordered import first_k

# Published Okapi defaults.
K1, B, EPSILON = 1.5, 0.75, 0.25

BLOCK_BITS = 4              # records of a block: 2 ** BLOCK_BITS
SEGMENT_BITS = 47           # block numbers of a segment
BUCKET_ROWS = 4_000_000     # postings of a bucket
PROBE = 16                  # blocks scored first, per task
MARGIN = 2e-6               # ranks are by scores rounded to six places


@dataclass
class Bm25Index:
    docs: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    avg_len: float
    n_docs: int
    floor: float  # mean idf over all tokens; below 0 only in tiny pools, whose weights may be negative
    path: str
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON

    @classmethod
    def read(cls, spark: SparkSession, path: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> "Bm25Index":
        """The index at ``path`` as of its last complete segment."""
        seen = spark.read.parquet(f"{path}/versions").orderBy("version").collect()  # one row per segment
        last, segments = seen[-1], [r.segment for r in seen]
        part = {n: _table(spark, path, n).filter(F.col("segment").isin(segments)).drop("segment")
                for n in ("postings", "blocks")}
        docs = spark.read.parquet(f"{path}/docs").filter(F.col("segment").isin(segments)).drop("segment")
        terms = spark.read.parquet(f"{path}/{last.terms}").select("token", "df", F.when(
            F.col("raw") < 0, F.lit(last.floor * epsilon)).otherwise(F.col("raw")).alias("idf"))
        return cls(docs, part["postings"], part["blocks"], terms, last.total / last.n_docs if last.n_docs else 0.0,
                   last.n_docs, last.floor, path, k1, b, epsilon)

    def append(self, docs: DataFrame, cluster: list[Column] | None = None) -> "Bm25Index":
        """The index with ``docs`` (ids it does not hold yet) as a further segment."""
        spark = docs.sparkSession
        _write_segment(spark, self.path, docs, cluster, None)
        return Bm25Index.read(spark, self.path, self.k1, self.b, self.epsilon)

    def merge(self, path: str) -> "Bm25Index":
        """A copy at ``path`` in which each bucket is one file again."""
        spark = self.docs.sparkSession
        segments = [r.segment for r in spark.read.parquet(f"{self.path}/versions").collect()]  # one row per segment
        # read as files, not as buckets: a bucketed scan would not be dealt anew
        postings = spark.read.parquet(f"{self.path}/postings").filter(F.col("segment").isin(segments)).drop("segment")
        _store(spark, path, self.docs, postings, _buckets(spark, path, self.path))
        return Bm25Index.read(spark, path, self.k1, self.b, self.epsilon)

    def write(self, path: str) -> None:
        self.merge(path)

    def part(self, tf: Column, length: Column) -> Column:
        """Term-frequency part of a score, before idf and query weight; grows with ``tf``, falls with ``length``."""
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * length / F.lit(self.avg_len or 1.0))
        return tf * (self.k1 + 1) / (tf + norm)


KEYS = {"postings": ["token", "blk"], "blocks": ["token"]}


def _name(path: str, part: str) -> str:
    return f"bm25_{part}_{hashlib.md5(path.encode()).hexdigest()}"


def _buckets(spark: SparkSession, path: str, other: str | None = None) -> int:
    return spark.read.parquet(f"{other or path}/versions").select("buckets").first()[0]


def _table(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A bucketed part of the index as a table; named in this session's catalog if it is not yet."""
    name = _name(path, part)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{part}").schema)
        keys = ", ".join(KEYS[part])
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {_buckets(spark, path)} BUCKETS LOCATION '{path}/{part}'")
    else:
        spark.catalog.refreshTable(name)
    return spark.table(name)


def _put(df: DataFrame, path: str, part: str, buckets: int) -> None:
    keys = KEYS[part]
    (df.repartition(buckets, *keys).write.mode("append").format("parquet").option("path", f"{path}/{part}")
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(_name(path, part)))


def _store(spark: SparkSession, path: str, docs: DataFrame, postings: DataFrame, buckets: int | None) -> None:
    """One segment: docs(id, ord, len, blk) and postings, then blocks and terms from the stored tables, then its version."""
    segment = uuid.uuid4().hex
    docs.withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{path}/docs")
    if buckets is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(least, postings.count() // BUCKET_ROWS + 1)
    _put(postings.withColumn("segment", F.lit(segment)), path, "postings", buckets)
    own = spark.table(_name(path, "postings")).filter(F.col("segment") == segment)
    _put(own.groupBy("token", "blk").agg(  # no shuffle: grouped as it is bucketed
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
        F.first("segment").alias("segment")), path, "blocks", buckets)
    try:
        before = spark.read.parquet(f"{path}/versions").orderBy("version").collect()
    except AnalysisException:  # no versions yet
        before = []
    segments = [r.segment for r in before] + [segment]
    whole = spark.read.parquet(f"{path}/docs").filter(F.col("segment").isin(segments)).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    df = (spark.table(_name(path, "blocks")).filter(F.col("segment").isin(segments))
          .groupBy("token").agg(F.sum("n").alias("df")))
    n, d = F.lit(whole.n), F.col("df")
    terms = f"terms-{segment}"
    df.withColumn("raw", F.log(n - d + 0.5) - F.log(d + 0.5)).write.parquet(f"{path}/{terms}")
    floor = spark.read.parquet(f"{path}/{terms}").agg(F.avg("raw")).first()[0]
    spark.range(1).select(
        F.lit(len(before)).alias("version"), F.lit(segment).alias("segment"), F.lit(terms).alias("terms"),
        n.cast("long").alias("n_docs"), F.lit(int(whole.total)).cast("long").alias("total"),
        F.lit(float(floor or 0.0)).alias("floor"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode(
        "append").parquet(f"{path}/versions")


def _write_segment(spark: SparkSession, path: str, docs: DataFrame, cluster: list[Column] | None, buckets: int | None) -> None:
    """Tokens are counted within their row and blocks are numbered within their partition, so the only shuffle of the
    size of the index is the one into buckets."""
    try:
        number = spark.read.parquet(f"{path}/versions").count()
        buckets = _buckets(spark, path)
    except AnalysisException:  # the first segment
        number = 0
    words = F.array_sort(ws_tokens("text"))
    rows = docs.select("id", "ord", words.alias("_t"), *[c.alias(f"_c{i}") for i, c in enumerate(cluster or [])])
    rows = rows.withColumn("len", F.size("_t").cast("long"))
    # places where a run of equal tokens begins
    heads = F.filter(F.sequence(F.lit(0), F.col("len").cast("int") - 1),
                     lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    rows = rows.withColumn("_h", F.when(F.col("len") > 0, heads).otherwise(F.array().cast("array<int>")))
    pairs = F.transform("_h", lambda i, j: F.struct(
        F.get("_t", i).alias("token"), (F.coalesce(F.get("_h", j + 1), F.col("len").cast("int")) - i).cast("long").alias("tf")))
    order = [F.col(f"_c{i}") for i in range(len(cluster or []))] + [F.col("len"), F.col("ord")]
    blk = F.lit(number << SEGMENT_BITS) + F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    forward = durable(rows.select("id", "ord", "len", pairs.alias("pairs"), *[f"_c{i}" for i in range(len(cluster or []))])
                      .sortWithinPartitions(*order).withColumn("blk", blk).select("id", "ord", "len", "blk", "pairs"))
    postings = forward.select("blk", "id", "ord", "len", F.inline("pairs")).select("token", "blk", "id", "ord", "len", "tf")
    _store(spark, path, forward.select("id", "ord", "len", "blk"), postings, buckets)


def bm25_index(docs: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON,
               cluster: list[Column] | None = None, path: str | None = None) -> Bm25Index:
    """Index of ``docs(id, ord, text)`` at ``path`` (default: a new folder in the shared scratch folder).

    Records that agree in ``cluster`` come to lie in the same blocks where their partition allows; give what a search adds to
    scores (scope, prior), so that whole blocks can be skipped. It changes no result."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "bm25")
    _write_segment(spark, path, docs, cluster, None)
    return Bm25Index.read(spark, path, k1, b, epsilon)


def query_terms(tasks: DataFrame, text: Column | str = "text") -> DataFrame:
    """(task_id, token, qtf): the query tokens with their multiplicity."""
    return (tasks.select("task_id", F.explode(ws_tokens(text)).alias("token"))
            .groupBy("task_id", "token").agg(F.count("*").alias("qtf")))


def weighted(tasks: DataFrame, index: Bm25Index, text: Column | str) -> DataFrame:
    return query_terms(tasks, text).join(index.terms, "token").select(
        "task_id", "token", "df", (F.col("qtf") * F.col("idf")).alias("_w"))


def asked_blocks(terms: DataFrame, index: Bm25Index) -> DataFrame:
    """(task_id, token, df, blk, _w, _most): the blocks each query token occurs in, and the most it adds there."""
    return terms.join(index.blocks, "token").select(
        "task_id", "token", "df", "blk", "_w",
        (F.greatest(F.col("_w"), F.lit(0.0)) * index.part(F.col("max_tf"), F.col("min_len"))).alias("_most"))


def block_sums(asked: DataFrame, index: Bm25Index) -> DataFrame:
    """Scores (task_id, id, ord, blk, score) of the records of the blocks asked for; the postings join in their buckets."""
    met = index.postings.join(asked.select("task_id", "token", "blk", "_w"), ["token", "blk"])
    return met.groupBy("task_id", "id", "ord", "blk").agg(
        F.round(F.sum(F.col("_w") * index.part(F.col("tf"), F.col("len"))), 6).alias("score"))


def bm25_scores(tasks: DataFrame, index: Bm25Index, text: Column | str = "text") -> DataFrame:
    """(task_id, id, ord, score) for every record that shares a token with the task."""
    return block_sums(asked_blocks(weighted(tasks, index, text), index), index).drop("blk")


@dataclass
class Gain:
    """What a record adds to its score besides matches: ``scale`` of the task times a gain of the record for the task's kind.

    ``tasks(task_id, kind, scale)`` with scale >= 0; ``blocks(kind, blk, gain)``, the largest gain in a block, absent if 0;
    ``of`` adds the exact column ``gain`` to rows with kind and id; ``leaders(kind, id, ord, blk)`` holds at least the first k
    records of a kind by (gain rounded to six places desc, ord)."""

    tasks: DataFrame
    blocks: DataFrame
    of: Callable[[DataFrame], DataFrame]
    leaders: DataFrame


def leading(index: Bm25Index, k: int) -> DataFrame:
    """The first k records by insertion order."""
    return index.docs.select("id", "ord", "blk").orderBy("ord", "id").limit(k)


def block_rounds(tasks: DataFrame, index: Bm25Index, k: int, text: Column | str = "text", gain: Gain | None = None,
                 rare: int = 0, probe: int = PROBE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, rest, bounds): scored records of the first round and the leaders, the blocks that can still matter, and all
    blocks that hold a match. A record in none of them cannot be among the k best: without a match it loses
    to every leader, and with one its block's bound is below the k-th best."""
    asked = durable(asked_blocks(weighted(tasks, index, text), index))
    bounds = asked.groupBy("task_id", "blk").agg(F.sum("_most").alias("bound"), F.min("df").alias("df"))
    ids = tasks.select("task_id").distinct()
    leaders = ids.crossJoin(F.broadcast(leading(index, k)))  # k rows
    if gain is not None:
        bounds = bounds.join(gain.tasks, "task_id").join(gain.blocks, ["kind", "blk"], "left").select(
            "task_id", "blk", (F.col("bound") + F.col("scale") * F.coalesce("gain", F.lit(0.0))).alias("bound"), "df")
        own = gain.tasks.select("task_id", "kind").join(gain.leaders, "kind").select("task_id", "id", "ord", "blk")
        leaders = leaders.unionByName(own).distinct()
    bounds, leaders = durable(bounds), durable(leaders)
    first = first_k(bounds, ["task_id"], [F.col("bound").desc(), F.col("blk")], probe).select("task_id", "blk")
    first = durable(first.unionByName(bounds.filter(F.col("df") <= rare).select("task_id", "blk"))
                    .unionByName(leaders.select("task_id", "blk")).distinct())

    def scored(blocks: DataFrame) -> DataFrame:
        return block_sums(asked.join(blocks, ["task_id", "blk"]), index).drop("blk")

    matched = durable(scored(first))
    lone = leaders.select("task_id", "id", "ord").join(matched, ["task_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    found = _with_gain(matched.unionByName(lone), gain)
    found = durable(found)
    kth = (first_k(found, ["task_id"], [F.col("score").desc()], k).groupBy("task_id")
           .agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k))
    rest = (bounds.join(kth, "task_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - MARGIN))
            .select("task_id", "blk").join(first, ["task_id", "blk"], "left_anti"))
    return found, _with_gain(scored(rest), gain), bounds


def _with_gain(scored: DataFrame, gain: Gain | None) -> DataFrame:
    if gain is None:
        return scored.select("task_id", "id", "ord", "score")
    rows = gain.of(scored.join(gain.tasks, "task_id"))
    return rows.select("task_id", "id", "ord", F.round(
        F.col("score") + F.col("scale") * F.coalesce("gain", F.lit(0.0)), 6).alias("score"))


def block_search(tasks: DataFrame, index: Bm25Index, k: int, text: Column | str = "text", gain: Gain | None = None,
                 rare: int = 0) -> DataFrame:
    """Top k (task_id, id, ord, score, rank) for an index whose weights are not negative."""
    found, rest, _ = block_rounds(tasks, index, k, text, gain, rare)
    return first_k(found.unionByName(rest), ["task_id"], [F.col("score").desc(), F.col("ord").asc()], k)
