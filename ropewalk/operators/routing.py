"""From seeds to an executable set of records per task.

Tables: ``skills(id, ord, status, body, token_cost, success_count, failure_count, task_types)``,
``edges(src, dst, type)``, ``seeds(task_id, id, rank)``. Edge types are plain strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parsing import parse_id_list
from ..functions.scoring import success_rate
from ..functions.text import loaded_tokens, vector_text
from ..schema import EXEC_EDGES, GOVERNANCE_EDGES, TRACE_EDGES
from ..session import durable
from .bm25 import Bm25Index, Gain, block_search, bm25_scores
from .ordered import first_k, prefix, range_rank, row_index
from .retrieval import bm25_search, pad_with_zero, topk_per_task, vector_scores, vector_search


def candidate_pool(skills: DataFrame) -> DataFrame:
    """Deployed records; validated ones only when nothing at all is deployed."""
    any_deployed = skills.agg(
        F.coalesce(F.max((F.col("status") == "deployed").cast("int")), F.lit(0)).alias("_any"))
    return (skills.filter(F.col("status").isin("deployed", "validated"))
            .crossJoin(F.broadcast(any_deployed))  # one row
            .filter((F.col("status") == "deployed") | (F.col("_any") == 0)).drop("_any"))


def active(skills: DataFrame) -> DataFrame:
    return skills.filter(F.col("status") != "retired")


def deployed(skills: DataFrame) -> DataFrame:
    return skills.filter(F.col("status") == "deployed")


def exec_edges(edges: DataFrame) -> DataFrame:
    """Edges a route may walk: dependency, composition, parent-child."""
    return edges.filter(F.col("type").isin(*EXEC_EDGES))


def layer_of(edge_type: Column | str) -> Column:
    t = F.col(edge_type) if isinstance(edge_type, str) else edge_type
    return (F.when(t.isin(*TRACE_EDGES), "trace")
            .when(t.isin(*GOVERNANCE_EDGES), "governance").otherwise("capability"))


def type_match(task_type: Column, task_types: Column) -> Column:
    """Some declared type is a substring of the task's type; "all" and "" never match."""
    tt = F.lower(task_type)
    return F.coalesce(F.exists(task_types, lambda t: (t != "") & (t != "all")
                               & F.contains(tt, t)), F.lit(False))


def type_matches(tasks: DataFrame, pool: DataFrame) -> DataFrame:
    """(task_id, id) for declared types that occur in the task type.

    The theta join runs once per distinct task type and distinct declared type, both short
    vocabularies, and comes back to rows by equi joins.
    """
    wanted = tasks.select("task_type").distinct()
    declared = pool.select(F.explode("task_types").alias("declared")).distinct()
    link = wanted.join(declared, (F.col("declared") != "") & (F.col("declared") != "all")
                       & F.contains(F.lower("task_type"), F.col("declared")))
    by_type = pool.select("id", F.explode("task_types").alias("declared"))
    return (tasks.select("task_id", "task_type").join(link, "task_type")
            .join(by_type, "declared").select("task_id", "id").distinct())


def boost(tasks: DataFrame, scores: DataFrame, pool: DataFrame, weight: float,
          k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raise records whose declared scope fits the task by ``weight`` times the task's best score.

    A boosted record may have matched no token. For each declared scope only its first ``k``
    unmatched records by insertion order can reach the top, all having the same score, so those k
    per scope are enough.
    """
    scoped = pool.select("id", "ord", "task_types", scope_of("task_types").alias("_scope"))
    tops = scores.groupBy("task_id").agg(F.max("score").alias("_top"))
    ref = tasks.select("task_id", "task_type").join(tops, "task_id", "left").select(
        "task_id", "task_type",
        F.when(F.coalesce(F.col("_top"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("_top"))
        .alias("_ref"))
    fits = type_match(F.col("task_type"), F.col("task_types"))
    lifted = (scores.join(ref, "task_id").join(scoped.drop("ord"), "id")
              .select("task_id", "id", "ord", F.round(
                  F.col("score") + F.when(fits, F.lit(weight) * F.col("_ref")).otherwise(0.0), 6)
                  .alias("score")))
    return lifted, ref, scoped


def boosted_search(tasks: DataFrame, pool: DataFrame, scores: DataFrame, weight: float,
                   k: int) -> DataFrame:
    scores = durable(scores)  # read four times below
    lifted, ref, scoped = boost(tasks, scores, pool, weight, k)
    best = topk_per_task(lifted, k).drop("rank")
    # unmatched records: per scope the first k that the task did not match
    types = ref.select("task_type").distinct()
    scopes = scoped.select("_scope", "task_types").dropDuplicates(["_scope"])
    fitting = types.join(scopes, type_match(F.col("task_type"), F.col("task_types")))
    need = ref.join(fitting.select("task_type", "_scope"), "task_type")
    matched = (scores.select("task_id", "id").join(scoped.select("id", "_scope"), "id")
               .groupBy("task_id", "_scope").agg(F.count("*").alias("_m")))
    deepest = matched.groupBy("_scope").agg((F.max("_m") + k).alias("_depth"))
    depth = scopes.select("_scope").join(deepest, "_scope", "left").select(
        "_scope", F.coalesce("_depth", F.lit(k)).alias("_depth"))
    indexed = row_index(scoped.select("id", "ord", "_scope"), ["_scope"], "ord", "_at")
    heads = indexed.join(depth, "_scope").filter(F.col("_at") < F.col("_depth"))
    need = need.join(matched, ["task_id", "_scope"], "left").select(
        "task_id", "_scope", "_ref", (F.coalesce("_m", F.lit(0)) + k).alias("_upto"))
    lone = (need.join(heads.select("_scope", "id", "ord", "_at"), "_scope")
            .filter(F.col("_at") < F.col("_upto"))
            .join(scores.select("task_id", "id"), ["task_id", "id"], "left_anti")
            .select("task_id", "id", "ord", F.round(F.lit(weight) * F.col("_ref"), 6)
                    .alias("score")))
    first = durable(topk_per_task(best.unionByName(lone), k).drop("rank"))
    matched = scores.select("task_id", "id").unionByName(lone.select("task_id", "id"))
    return topk_per_task(pad_with_zero(tasks, first, pool, k, matched), k)


def scope_gain(tasks: DataFrame, pool: DataFrame, index: Bm25Index, weight: float, k: int) -> Gain:
    """Records whose declared scope fits a task's type gain ``weight`` times the task's best score (1 if that is 0)."""
    best = block_search(tasks, index, 1).select("task_id", F.col("score").alias("_top"))
    kinds = tasks.select("task_id", F.col("task_type").alias("kind")).join(best, "task_id", "left").select(
        "task_id", "kind", (F.lit(weight) * F.when(F.coalesce("_top", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_top")))
        .alias("scale"))
    scope = scope_of("task_types")
    scoped = durable(pool.select("id", scope.alias("_scope"), "task_types").join(index.docs.select("id", "ord", "blk"), "id"))
    scopes = scoped.select("_scope", "task_types").dropDuplicates(["_scope"])
    # two vocabularies: types of tasks and declared scopes
    fits = durable(tasks.select(F.col("task_type").alias("kind")).distinct().join(
        scopes, type_match(F.col("kind"), F.col("task_types"))).select("kind", "_scope"))
    heads = first_k(scoped, ["_scope"], [F.col("ord"), F.col("id")], k).select("_scope", "id", "ord", "blk")
    blocks = scoped.select("_scope", "blk").distinct().join(fits, "_scope").select("kind", "blk", F.lit(1.0).alias("gain"))

    def gained(rows: DataFrame) -> DataFrame:
        return rows.join(scoped.select("id", "_scope"), "id").join(
            fits.withColumn("gain", F.lit(1.0)), ["kind", "_scope"], "left")

    leaders = first_k(heads.join(fits, "_scope"), ["kind"], [F.col("ord"), F.col("id")], k)
    return Gain(durable(kinds), durable(blocks.distinct()), gained, leaders.select("kind", "id", "ord", "blk"))


def scope_of(task_types: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(task_types)), "\x1f")


def lexical_seeds(tasks: DataFrame, pool: DataFrame, index: Bm25Index, k: int = 3,
                  type_boost: float = 0.0, retriever: str = "bm25") -> DataFrame:
    """Seeds by BM25 (or hashed vectors) on the task text alone, optionally scope-boosted."""
    if not type_boost:
        if retriever == "bm25":
            return bm25_search(tasks, index, k)
        return vector_search(tasks, pool, k, doc_text=vector_text("name", "description", "body"))
    if retriever == "bm25" and index.floor >= 0 and type_boost > 0:
        return block_search(tasks, index, k, gain=scope_gain(tasks, pool, index, type_boost, k))
    text = vector_text("name", "description", "body")
    scores = (bm25_scores(tasks, index) if retriever == "bm25"
              else vector_scores(tasks, pool, doc_text=text))
    return boosted_search(tasks, pool, scores, type_boost, k)


def seeds_from_replies(replies: DataFrame, pool: DataFrame) -> DataFrame:
    """Ranked ids from selector replies: the last flat array that names a pool record wins."""
    lists = replies.select("task_id", F.posexplode(parse_id_list("reply")).alias("_g", "_ids"))
    named = lists.select("task_id", "_g", F.posexplode("_ids").alias("_p", "id")).join(
        pool.select("id"), "id", "left_semi")
    chosen = named.groupBy("task_id").agg(F.min("_g").alias("_win"))
    return (named.join(chosen, "task_id").filter(F.col("_g") == F.col("_win"))
            .select("task_id", "id", (F.col("_p") + 1).alias("rank")))


def seed_override(tasks: DataFrame, external: DataFrame, skills: DataFrame,
                  fallback: DataFrame, k: int) -> DataFrame:
    """External ranked ids where a task has a known one, else the fallback seeds."""
    known = external.join(skills.select("id"), "id", "left_semi").select("task_id", "id", "rank")
    best = first_k(known.withColumnRenamed("rank", "_r"), ["task_id"], [F.col("_r")], k)
    rest = fallback.join(known.select("task_id").distinct(), "task_id", "left_anti")
    return (best.select("task_id", "id", "rank", F.lit("external").alias("origin"))
            .unionByName(rest.select("task_id", "id", "rank", F.lit("lexical").alias("origin")))
            .join(tasks.select("task_id"), "task_id", "left_semi"))


# ---------------------------------------------------------------------------------- expansion
def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return frontier.join(edges, frontier["id"] == edges["src"]).select(
        "task_id", F.col("dst").alias("id")).distinct()


def _reach(starts: DataFrame, edges: DataFrame, hops_per_round: int) -> DataFrame:
    """(start, id) for everything reachable. A round walks several hops in one plan, each from the nodes of the hop
    before; what is new goes to reliable storage, and the next round sets out from what only the last hop reached.
    The only action on the driver is an emptiness test per round."""
    hop = durable(edges)
    ends = new = durable(starts.select(F.col("id").alias("start"), "id").distinct())
    found = [new]
    while True:
        current, walked = ends, []
        for n in range(1, hops_per_round + 1):
            current = current.join(hop, current["id"] == hop["src"]).select(
                "start", F.col("dst").alias("id")).distinct()
            walked.append(current.withColumn("_hop", F.lit(n)))
        seen = reduce(DataFrame.union, found)
        # one aggregate both removes duplicates and tells new pairs from seen ones
        new = durable(reduce(DataFrame.union, walked, seen.withColumn("_hop", F.lit(0))).groupBy("start", "id")
                      .agg(F.min("_hop").alias("_hop")).filter(F.col("_hop") > 0))
        if new.isEmpty():
            return seen
        found.append(new.select("start", "id"))
        ends = new.filter(F.col("_hop") == hops_per_round).select("start", "id")


def dependency_closure(seeds: DataFrame, edges: DataFrame, skills: DataFrame,
                       hops_per_round: int = 4) -> DataFrame:
    """Seeds plus everything they need, per task. Cycles end because seen pairs never re-enter;
    ids without a record drop out.

    The loop runs over distinct seeds, so its size follows the graph and not the number of tasks;
    tasks join the finished closure once.
    """
    known = skills.select("id")
    deps = (edges.filter(F.col("type") == "depends_on").select("src", "dst")
            .join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
            .select("src", "dst").distinct())
    wanted = durable(seeds.select("task_id", "id").distinct().join(known, "id", "left_semi")
                     .select("task_id", "id"))
    reach = _reach(wanted, deps, hops_per_round)
    return wanted.join(reach, wanted["id"] == reach["start"]).select(
        "task_id", reach["id"]).distinct()


def k_hop(seeds: DataFrame, edges: DataFrame, hop: int) -> DataFrame:
    """Undirected neighbourhood over executable edges within ``hop`` steps."""
    e = exec_edges(edges).select("src", "dst")
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = current = seeds.select("task_id", "id").distinct()
    for _ in range(hop):
        current = _step(current, both)
        out = out.union(current).distinct()
    return out


# ---------------------------------------------------------------------------------- governance
def blocked(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("type") == "blocks_routing").select(
        F.col("dst").alias("id")).distinct()


def drop_blocked(activated: DataFrame, edges: DataFrame) -> DataFrame:
    return activated.join(blocked(edges), "id", "left_anti")


def resolve_conflicts(activated: DataFrame, seeds: DataFrame, edges: DataFrame,
                      skills: DataFrame) -> DataFrame:
    """Drop one end of every conflict that is active in a task.

    For an edge src -> dst the loser is dst, unless dst is a seed and src is not, or dst has the
    higher success rate. An edge acts only while both ends are still there, so edges that touch
    the same record are applied in (src, dst) order.
    """
    fighting = edges.filter((F.col("type") == "conflicts_with") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    # only ends of a conflict are looked at; all others pass
    ends = fighting.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rate = ends.join(skills.select("id", success_rate().alias("_rate")), "id", "left")
    here = durable(activated.select("task_id", "id").join(rate, "id")
                   .join(seeds.select("task_id", "id", F.lit(True).alias("_seed")).distinct(),
                         ["task_id", "id"], "left")
                   .select("task_id", "id", F.coalesce("_seed", F.lit(False)).alias("_seed"), "_rate"))
    a = here.select("task_id", F.col("id").alias("src"), F.col("_seed").alias("_sa"),
                    F.col("_rate").alias("_ra"))
    b = here.select("task_id", F.col("id").alias("dst"), F.col("_seed").alias("_sb"),
                    F.col("_rate").alias("_rb"))
    conflicts = range_rank(fighting, [F.col("src"), F.col("dst")], "_n")
    live = a.join(conflicts, "src").join(b, ["task_id", "dst"])
    src_loses = (F.col("_sb") & ~F.col("_sa")) | (F.col("_rb") > F.col("_ra"))
    fights = durable(live.select(
        "task_id", "src", "dst", "_n",
        F.when(src_loses, F.col("src")).otherwise(F.col("dst")).alias("_loser")).distinct())
    return activated.join(_settle(fights), ["task_id", "id"], "left_anti")


def _settle(fights: DataFrame) -> DataFrame:
    """(task_id, id) of the records that are gone once all conflicts were applied in the order ``_n``.

    Let A(x, j) say that x is still there after the j-th conflict it would lose. With y the other end of that
    conflict and k the number of conflicts that y would lose before it, A(x, j) = A(x, j - 1) and not A(y, k), and A(x, 0) is
    true. So there is one condition of two inputs per conflict, however many conflicts meet in a record. A round puts known
    inputs in and lets an input whose condition has one input left point past it, so chains halve with
    each round; a round reads only what the one before left open.
    """
    ends = fights.select("task_id", "_n", "_loser", F.explode(F.array("src", "dst")).alias("_end"))
    ends = ends.withColumn("_loses", F.col("_end") == F.col("_loser"))
    placed = prefix(ends, ["task_id", "_end"], "_n", {"_k": ("sum", F.col("_loses").cast("long"))},
                    levels=1, ranked=True)
    here = F.struct(F.col("_end").alias("id"), F.col("_k").alias("at"))
    both = placed.groupBy("task_id", "_n").agg(F.max(F.when(F.col("_loses"), here)).alias("_x"),
                                               F.max(F.when(~F.col("_loses"), here)).alias("_y"))

    def literal(end: str, no: bool) -> Column:
        return F.struct(F.col(f"{end}.id").alias("id"), F.col(f"{end}.at").alias("at"), F.lit(no).alias("no"))

    own = F.when(F.col("_x.at") > 0, F.array(literal("_x", False))).otherwise(F.array())
    state = durable(both.select(
        "task_id", F.col("_x.id").alias("id"), (F.col("_x.at") + 1).alias("at"),
        F.concat(own, F.array(literal("_y", True))).alias("ins"),
        F.when(F.col("_y.at") == 0, F.lit(False)).alias("value")))
    lost = []
    while True:
        lost.append(state.filter(~F.col("value")).select("task_id", "id"))
        todo = state.filter(F.col("value").isNull())
        if todo.isEmpty():
            return reduce(DataFrame.union, lost).distinct()
        state = durable(_settle_round(state, todo))


def _settle_round(state: DataFrame, todo: DataFrame) -> DataFrame:
    on = ["task_id", "_i", "_a"]
    known = state.select("task_id", F.col("id").alias("_i"), F.col("at").alias("_a"), F.col("value").alias("_v"),
                         F.when(F.col("value").isNull() & (F.size("ins") == 1), F.get("ins", F.lit(0))).alias("_m"))
    asked = todo.select("task_id", "id", "at", F.explode("ins").alias("_l")).select(
        "task_id", "id", "at", F.col("_l.id").alias("_i"), F.col("_l.at").alias("_a"), F.col("_l.no").alias("_no"))
    past = F.col("_m").isNotNull()
    moved = asked.join(known, on).select(
        "task_id", "id", "at", F.when(past, F.col("_m.id")).otherwise(F.col("_i")).alias("_i"),
        F.when(past, F.col("_m.at")).otherwise(F.col("_a")).alias("_a"),
        F.when(past, F.col("_no") != F.col("_m.no")).otherwise(F.col("_no")).alias("_no"))
    # what was pointed to may be known by now, so no input is left that the next round would not find
    met = moved.join(known.drop("_m"), on).withColumn("_is", F.col("_v") != F.col("_no"))
    left = F.collect_set(F.when(F.col("_is").isNull(), F.struct(
        F.col("_i").alias("id"), F.col("_a").alias("at"), F.col("_no").alias("no"))))
    opposed = (F.size("ins") == 2) & (F.get("ins", F.lit(0))["id"] == F.get("ins", F.lit(1))["id"]) & (
        F.get("ins", F.lit(0))["at"] == F.get("ins", F.lit(1))["at"])
    return met.groupBy("task_id", "id", "at").agg(left.alias("ins"), F.bool_and("_is").alias("_all")).select(
        "task_id", "id", "at", "ins",
        F.when(~F.col("_all") | opposed, False).when(F.size("ins") == 0, True).alias("value"))


def route_status_filter(activated: DataFrame, skills: DataFrame) -> DataFrame:
    ok = skills.filter(F.col("status").isin("deployed", "validated")).select("id")
    return activated.join(ok, "id", "left_semi")


def open_records(activated: DataFrame, skills: DataFrame, block_edges: DataFrame) -> DataFrame:
    """Activated records that are not blocked; ``routable`` says whether their status lets them on a route."""
    ok = F.coalesce(F.col("status").isin("deployed", "validated"), F.lit(False))
    each = skills.select("id", ok.alias("_ok")).groupBy("id").agg(F.max("_ok").alias("routable"))
    return activated.join(drop_blocked(each, block_edges), "id").select("task_id", "id", "routable")


# ---------------------------------------------------------------------------------- route detail
def induced_edges(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Executable edges whose two ends are in the same task's route."""
    r = routes.select("task_id", "id").distinct()
    e = exec_edges(edges).select("src", "dst", "type")
    half = r.withColumnRenamed("id", "src").join(e, "src")
    return half.join(r.withColumnRenamed("id", "dst"), ["task_id", "dst"], "left_semi").select(
        "task_id", "src", "dst", "type")


def guards(routes: DataFrame, guard_edges: DataFrame) -> DataFrame:
    """First checkpoint of each routed record; ``guard_edges(rule_id, id, seq)``."""
    first = guard_edges.groupBy("id").agg(F.min_by("rule_id", "seq").alias("rule_id"))
    return routes.join(first, "id").select("task_id", "id", "rule_id")


def excluded(tasks: DataFrame, pool: DataFrame, routes: DataFrame) -> DataFrame:
    """The pool minus each task's route, as runs of consecutive pool positions.

    The complement of a small set is nearly the whole pool, so writing it out row by row costs
    tasks times pool. Between two routed records it is one run: (task_id, first_pos, last_pos,
    n_excluded) with zero-based positions in id order. ``excluded_ids`` turns runs into ids.
    """
    placed = pool_positions(pool)
    size = pool.agg(F.count("*").alias("_n"))
    used = routes.select("task_id", "id").distinct().join(placed, "id").select(
        "task_id", F.col("pos").alias("_at"))
    ends = (tasks.select("task_id").distinct().crossJoin(F.broadcast(size))  # one row
            .select("task_id", F.col("_n").alias("_at")))
    win = Window.partitionBy("task_id").orderBy("_at")
    cuts = used.unionByName(ends).select("task_id", "_at", F.lag("_at").over(win).alias("_prev"))
    return (cuts.select("task_id", (F.coalesce("_prev", F.lit(-1)) + 1).alias("first_pos"),
                        (F.col("_at") - 1).alias("last_pos"))
            .filter(F.col("first_pos") <= F.col("last_pos"))
            .withColumn("n_excluded", F.col("last_pos") - F.col("first_pos") + 1))


def pool_positions(pool: DataFrame) -> DataFrame:
    """(id, pos): zero-based position of each pool record in ``ord`` order."""
    return row_index(pool.select("id", "ord"), [], "ord", "pos").select("id", "pos")


def excluded_ids(runs: DataFrame, pool: DataFrame) -> DataFrame:
    """(task_id, id) of the given runs, for the tasks someone wants to read in full."""
    spots = runs.select("task_id", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    return spots.join(pool_positions(pool), "pos").select("task_id", "id")


def route_tokens(routes: DataFrame, skills: DataFrame) -> DataFrame:
    """Nodes and loaded tokens per task."""
    cost = skills.select("id", loaded_tokens("token_cost", "body").alias("_c"))
    return routes.join(cost, "id").groupBy("task_id").agg(
        F.count("*").alias("n_nodes"), F.sum("_c").alias("loaded_tokens"))
