"""Graph of canonical steps drawn from ordered chains, and the consensus path through it.

``steps(chain, pos, step, desc, success, task_type, question, seq)``: pos counts from 0 within a
chain, seq is a unique integer in arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import avg_pos, success_rate
from ..session import durable
from .bm25 import Gain, block_search, bm25_index, bm25_scores
from .mining import W_FAIL, W_SUCCESS
from .ordered import first_k, rank_index, with_previous


def step_positions(steps: DataFrame) -> DataFrame:
    """Add ``rel`` = pos / chain length."""
    length = steps.groupBy("chain").agg(F.count("*").alias("chain_len"))
    return steps.join(length, "chain").withColumn("rel", F.col("pos") / F.col("chain_len"))


def transitions(steps: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Consecutive pairs (src, dst) per chain; a step that follows itself makes none."""
    out = with_previous(steps, ["chain"], "pos", ["step"])
    return out.filter(F.col("prev_step").isNotNull()
                      & (F.col("prev_step") != F.col("step"))).select(
        "chain", "pos", F.col("prev_step").alias("src"), F.col("step").alias("dst"), *carry)


def chain_nodes(steps: DataFrame) -> DataFrame:
    """Visits, successes, position sums and first non-empty description per step."""
    has = F.length("desc") > 0
    return (step_positions(steps).groupBy(F.col("step").alias("id")).agg(
        F.count("*").alias("n_visit"), F.count_if("success").alias("n_success"),
        F.sum("rel").alias("pos_sum"), F.count("*").alias("pos_n"),
        F.substring(F.coalesce(F.min_by(F.when(has, F.col("desc")), F.when(has, F.col("seq"))),
                               F.lit("")), 1, 160).alias("desc"),
        F.min("seq").alias("ord")))


def chain_task_types(steps: DataFrame) -> DataFrame:
    """(id, task_type, n): the per-step type counts in long form."""
    return steps.filter(F.length("task_type") > 0).groupBy(
        F.col("step").alias("id"), "task_type").agg(F.count("*").alias("n"))


def with_type_map(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes with a ``task_types`` map; its size is the number of task types."""
    maps = types.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("task_type", "n")))).alias("task_types"))
    return nodes.join(maps, "id", "left")


def chain_edges(steps: DataFrame, w_ok: float = W_SUCCESS, w_fail: float = W_FAIL) -> DataFrame:
    weight = F.when(F.col("success"), F.lit(w_ok)).otherwise(F.lit(w_fail))
    return transitions(steps, ["success", "seq"]).groupBy("src", "dst").agg(
        F.count("*").alias("count"), F.count_if("success").alias("succ"),
        F.sum(weight).alias("weight"), F.min("seq").alias("ord"))


def examples_per_node(steps: DataFrame, n: int = 3, cut: int = 120) -> DataFrame:
    """First ``n`` non-empty questions seen at each step."""
    q = steps.filter(F.length("question") > 0).select(
        F.col("step").alias("id"), F.substring("question", 1, cut).alias("example"), "seq")
    return first_k(q, ["id"], [F.col("seq").asc()], n)


def hubs(nodes: DataFrame, n: int = 60) -> DataFrame:
    """Most visited steps, the registry handed to whoever names new steps."""
    return nodes.orderBy(F.col("n_visit").desc(), F.col("ord").asc()).limit(n)


def chain_seeds(tasks: DataFrame, nodes: DataFrame, examples: DataFrame, k: int = 3,
                text: Column | str = "text") -> DataFrame:
    """Entry steps per task: BM25 over step words, description and examples, plus a prior for
    steps that succeed and are visited often."""
    joined = examples.groupBy("id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda e: e["example"]), " ")
        .alias("_ex"))
    docs = nodes.join(joined, "id", "left").select(
        "id", "ord", F.concat(F.translate("id", "_", " "), F.lit(" "), F.col("desc"), F.lit(" "),
                              F.coalesce("_ex", F.lit(""))).alias("text"))
    prior = nodes.select("id", "ord", (F.lit(0.25) * success_rate("n_success",
                         F.col("n_visit") - F.col("n_success"))
                         + F.lit(0.05) * F.col("n_visit")).alias("_p"))
    index = bm25_index(docs.join(prior.select("id", F.col("_p").alias("_prior")), "id"), cluster=[F.col("_prior")])
    if index.floor < 0:
        return _seeds_of_all_matches(tasks, prior, bm25_scores(tasks, index, text), k)
    placed = durable(index.docs.select("id", "blk").join(prior, "id"))
    one = F.lit(0).alias("kind")
    # steps without a match compete with their prior alone, so the k best priors stand for all of them
    leaders = placed.orderBy(F.round("_p", 6).desc(), "ord").limit(k).select(one, "id", "ord", "blk")
    blocks = placed.groupBy("blk").agg(F.max("_p").alias("gain")).select(one, "blk", "gain")
    gain = Gain(tasks.select("task_id", one, F.lit(1.0).alias("scale")).distinct(), durable(blocks),
                lambda rows: rows.join(placed.select("id", F.col("_p").alias("gain")), "id"), leaders)
    return block_search(tasks, index, k, text, gain)


def _seeds_of_all_matches(tasks: DataFrame, prior: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """For graphs where most tokens are in more than half of the steps, so that a match can lower a score."""
    matched = durable(matched)
    scored = matched.join(prior.drop("ord"), "id").select(
        "task_id", "id", "ord", F.round(F.col("score") + F.col("_p"), 6).alias("score"))
    order = [F.col("score").desc(), F.col("ord").asc()]
    best = first_k(scored, ["task_id"], order, k).drop("rank")
    # Unmatched steps compete with their prior alone. A task with m hits can only need steps among
    # the m + k best priors; the depth below is the largest such number, and the anti join is exact.
    hits = matched.groupBy("task_id").agg(F.count("*").alias("_m"))
    depth = hits.agg((F.coalesce(F.max("_m"), F.lit(0)) + k).alias("_d"))
    ranked = prior.select("id", "ord", F.round("_p", 6).alias("score"),
                          F.round(F.round("_p", 6) * -1000000).cast("long").alias("_v"))
    placed = (rank_index(ranked, "_v", "ord", "_at").crossJoin(F.broadcast(depth))  # one row
              .filter(F.col("_at") < F.col("_d")).select("id", "ord", "score", "_at"))
    want = tasks.select("task_id").join(hits, "task_id", "left").select(
        "task_id", F.explode(F.sequence(F.lit(0), (F.coalesce("_m", F.lit(0)) + k - 1)))
        .alias("_at"))
    lone = (want.join(placed, "_at").join(matched.select("task_id", "id"), ["task_id", "id"],
                                          "left_anti")
            .select("task_id", "id", "ord", "score"))
    return first_k(best.unionByName(lone), ["task_id"], order, k)


def consensus_path(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int = 8,
                   min_succ: int = 1) -> DataFrame:
    """Walk from each seed forward, then backward, along the heaviest edge that ever succeeded.

    A task holds at most ``max_nodes`` steps, so of every step only its ``max_nodes`` heaviest
    edges per direction can matter. They travel as one short array per step, and a walk is one
    small state row per task that meets that array once per move.
    """
    live = edges.filter(F.col("succ") >= min_succ)
    ways = live.select(F.col("src").alias("at"), F.lit(1).alias("dir"), F.col("dst").alias("to"),
                       "weight", "ord").unionByName(
        live.select(F.col("dst").alias("at"), F.lit(-1).alias("dir"), F.col("src").alias("to"),
                    "weight", "ord"))
    top = first_k(ways, ["at", "dir"], [F.col("weight").desc(), F.col("ord").asc()], max_nodes)
    table = durable(top.groupBy("at", "dir").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "to"))), lambda e: e["to"]).alias("_to")))
    state = seeds.groupBy("task_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("seeds"))
    state = state.select("task_id", "seeds", F.col("seeds").alias("chosen"),
                         F.lit(0).alias("i"), F.lit(1).alias("dir"),
                         F.col("seeds")[0].alias("at"))
    n_seeds = seeds.agg(F.coalesce(F.max("rank"), F.lit(1))).first()[0]
    # every move adds a step or ends a direction
    moves = max(0, max_nodes - 1) + 2 * int(n_seeds)
    for move in range(1, moves + 1):
        open_ = F.when((F.size("chosen") < max_nodes) & F.col("at").isNotNull(), F.col("at"))
        state = state.withColumn("at", open_).join(table, ["at", "dir"], "left")
        nxt = F.get(F.filter(F.coalesce("_to", F.array().cast("array<string>")),
                             lambda t: ~F.array_contains(F.col("chosen"), t)), F.lit(0))
        moved = nxt.isNotNull()
        back = ~moved & (F.col("dir") == 1)
        i = F.when(moved | back, F.col("i")).otherwise(F.col("i") + 1)
        state = state.select("task_id", "seeds", "chosen", "i", "dir", "at", nxt.alias("_n"),
                             i.alias("_i"))
        state = state.select(
            "task_id", "seeds",
            F.when(F.col("_n").isNotNull(), F.array_append("chosen", F.col("_n")))
            .otherwise(F.col("chosen")).alias("chosen"),
            F.col("_i").alias("i"),
            F.when(F.col("_n").isNotNull(), F.col("dir")).otherwise(-F.col("dir")).alias("dir"),
            F.when(F.col("_n").isNotNull(), F.col("_n"))
            .otherwise(F.get("seeds", F.col("_i"))).alias("at"))
        if move % 4 == 0:
            state = durable(state)
    place = nodes.select("id", F.round(avg_pos(), 6).alias("avg_pos"))
    return state.select("task_id", F.explode("chosen").alias("id")).join(place, "id")
