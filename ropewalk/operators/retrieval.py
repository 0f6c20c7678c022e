"""Lexical and vector retrieval of records per task.

Tables: ``docs(id, ord, text)``, ``tasks(task_id, text)``. ``ord`` is insertion order and breaks
ties, so it must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import loaded_tokens
from ..functions.vectors import hash_embed, hash_embed_packed
from ..session import durable
from .bm25 import Bm25Index, bm25_index, bm25_scores, block_search
from .ordered import first_k, range_rank
from .similarity import similar

RUN = 4096  # positions of the pool counted together


def first_unmatched(tasks: DataFrame, matched: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(task_id, id, ord): per task the first ``k`` records, in insertion order, that it did not match.

    Positions of the pool are counted in runs of ``RUN``. The free places before a run follow from the matches
    before it, so only runs that hold one of the first ``k`` free places are looked into: at most ``k`` per task,
    whatever the task matched.
    """
    pool = durable(range_rank(docs.select("id", "ord"), [F.col("ord"), F.col("id")], "_at")).select("id", "ord", "_at")
    sizes = durable(pool.groupBy(F.floor(F.col("_at") / RUN).alias("_run")).agg(F.count("*").alias("_size")))
    hits = matched.select("task_id", "id").distinct().join(pool.select("id", "_at"), "id").select(
        "task_id", "_at", F.floor(F.col("_at") / RUN).alias("_run"))
    hits = durable(hits)
    used = hits.groupBy("task_id", "_run").agg(F.count("*").alias("_used"))
    # a task needs no run beyond those it uses and those k free places fill
    span = tasks.select("task_id").distinct().join(
        used.groupBy("task_id").agg(F.count("*").alias("_runs")), "task_id", "left").select(
        "task_id", F.explode(F.sequence(F.lit(0), (F.coalesce("_runs", F.lit(0)) + k // RUN + 1).cast("long"))).alias("_run"))
    each = span.join(sizes, "_run").join(used, ["task_id", "_run"], "left").select(
        "task_id", "_run", (F.col("_size") - F.coalesce("_used", F.lit(0))).alias("_free"))
    before = Window.partitionBy("task_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    open_runs = each.select("*", F.coalesce(F.sum("_free").over(before), F.lit(0)).alias("_before")).filter(
        (F.col("_free") > 0) & (F.col("_before") < k))
    free = (open_runs.join(pool.withColumn("_run", F.floor(F.col("_at") / RUN)), "_run")
            .join(hits.select("task_id", "_at"), ["task_id", "_at"], "left_anti"))
    return first_k(free, ["task_id"], [F.col("ord").asc(), F.col("id").asc()], k).select("task_id", "id", "ord")


def pad_with_zero(tasks: DataFrame, scores: DataFrame, docs: DataFrame, k: int,
                  matched: DataFrame | None = None) -> DataFrame:
    """Records that matched nothing still count, with score 0 in insertion order.

    ``matched`` lists every (task_id, id) that has a score of its own (default: ``scores``), at least for tasks whose
    k best in ``scores`` do not all lie above 0; the others have no room for a zero.
    """
    full = scores.filter("score > 0").groupBy("task_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= k)
    needy = durable(tasks.select("task_id").distinct().join(full, "task_id", "left_anti"))
    pairs = (scores if matched is None else matched).select("task_id", "id").join(needy, "task_id", "left_semi")
    zero = first_unmatched(needy, pairs, docs, k).select("task_id", "id", "ord", F.lit(0.0).alias("score"))
    return scores.unionByName(zero)


def topk_per_task(scores: DataFrame, k: int) -> DataFrame:
    """Best k per task by score, ties by insertion order; adds ``rank`` 1..k."""
    return first_k(scores, ["task_id"], [F.col("score").desc(), F.col("ord").asc()], k)


def bm25_search(tasks: DataFrame, index: Bm25Index, k: int, text: Column | str = "text",
                frequent: int | None = None) -> DataFrame:
    """Top k by Okapi BM25, always k rows per task while the pool has that many.

    Blocks of records that cannot reach the k-th best score are skipped (``bm25``). ``frequent`` has blocks that hold a
    query token of at most so many records scored in the first round, whatever their bound. In tiny pools, where most tokens are in
    more than half of the records, weights can be negative and bounds say nothing: all matches are scored there.
    """
    if index.floor >= 0:
        return block_search(tasks, index, k, text, rare=frequent or 0)
    scores = durable(bm25_scores(tasks, index, text))
    best = durable(topk_per_task(scores, k).drop("rank"))
    return topk_per_task(pad_with_zero(tasks, best, index.docs, k, scores), k)


def vector_scores(tasks: DataFrame, docs: DataFrame, dim: int = 256,
                  task_text: Column | str = "text", doc_text: Column | str = "text") -> DataFrame:
    """Cosine of hashed vectors for every pair that shares a bucket."""
    q = hash_embed(tasks, "task_id", task_text, dim).select(
        "task_id", "bucket", F.col("w").alias("_qw"))
    d = hash_embed(docs, "id", doc_text, dim)
    dots = (d.join(q, "bucket").groupBy("task_id", "id")
            .agg(F.sum(F.col("w") * F.col("_qw")).alias("_s")))
    return dots.join(docs.select("id", "ord"), "id").select(
        "task_id", "id", "ord", F.round("_s", 6).alias("score"))


def vector_search(tasks: DataFrame, docs: DataFrame, k: int, dim: int = 256,
                  task_text: Column | str = "text",
                  doc_text: Column | str = "text") -> DataFrame:
    """Top k by cosine of hashed vectors. A tile of tasks meets a tile of records as two matrices
    and gives k rows per task, so scores that cannot win are never written out."""
    q = hash_embed_packed(tasks, "task_id", task_text, dim).select(
        F.col("task_id").alias("id"), F.lit(-1).cast("long").alias("ord"), "buckets", "tf")
    d = hash_embed_packed(docs, "id", doc_text, dim).join(docs.select("id", "ord"), "id")
    found = similar(q, d, dim, k=k).select(
        F.col("left_id").alias("task_id"), F.col("right_id").alias("id"),
        F.col("right_ord").alias("ord"), F.col("sim").alias("score"))
    return topk_per_task(found, k)


def full_load(tasks: DataFrame, pool: DataFrame) -> DataFrame:
    """Baseline that loads every pool record for every task.

    All tasks get the same set, so the pool table itself is the node list; what differs from other
    routes, size and tokens, is one row of the pool attached to each task.
    """
    whole = pool.agg(F.count("*").alias("n_nodes"),
                     F.sum(loaded_tokens("token_cost", "body")).alias("loaded_tokens"),
                     F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return tasks.select("task_id").crossJoin(F.broadcast(whole))  # one row


def flat_route(tasks: DataFrame, pool: DataFrame, mode: str = "bm25", k: int = 5,
               index: Bm25Index | None = None) -> DataFrame:
    """Top-k baseline without a graph: (task_id, id, ord, score, rank, tokens).

    The task type is part of the query text here, unlike in graph routing.
    """
    query = F.concat_ws(" ", "text", "task_type")
    if mode == "bm25":
        found = bm25_search(tasks, index or bm25_index(pool), k, query)
    elif mode == "embed":
        found = vector_search(tasks, pool, k, task_text=query)
    else:
        raise ValueError("mode is bm25 or embed; the full load is full_load()")
    cost = pool.select("id", loaded_tokens("token_cost", "body").alias("tokens"))
    return found.join(cost, "id")
