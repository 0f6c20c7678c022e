"""The whole routing plan for many tasks at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import bm25_text
from ..operators import mining, routing
from ..operators.bm25 import Bm25Index, bm25_index
from ..session import durable


@dataclass
class Routes:
    """``nodes(task_id, id)`` and what hangs off them; everything but nodes is lazy."""

    tasks: DataFrame
    pool: DataFrame
    skills: DataFrame
    edges: DataFrame
    guard_edges: DataFrame | None
    seeds: DataFrame
    nodes: DataFrame

    def induced_edges(self) -> DataFrame:
        return routing.induced_edges(self.nodes, self.edges)

    def guards(self) -> DataFrame:
        return routing.guards(self.nodes, self.guard_edges)

    def excluded(self) -> DataFrame:
        return routing.excluded(self.tasks, self.pool, self.nodes)

    def totals(self) -> DataFrame:
        return routing.route_tokens(self.nodes, self.skills)

    def gap_fill(self, cooc: DataFrame, evidence: DataFrame, max_synth: int = 3,
                 min_weight: float = 3.0) -> DataFrame:
        return mining.gap_fill(self.nodes, cooc, evidence, self.pool, max_synth, min_weight)

    def bodies(self) -> DataFrame:
        """(task_id, id, rank, body): bodies join only now, routing never carries them."""
        return self.nodes.join(self.skills.select("id", "body"), "id").select(
            "task_id", "id", F.col("id").alias("rank"), "body")


def pool_index(pool: DataFrame, path: str | None = None) -> Bm25Index:
    """Index over the pool's texts, records of one scope side by side; give a ``path`` to keep it for later sessions."""
    docs = pool.select("id", "ord", bm25_text("name", "description", "body").alias("text"), "task_types")
    return bm25_index(docs, cluster=[routing.scope_of("task_types")], path=path)


def expand(seeds: DataFrame, skills: DataFrame, edges: DataFrame, block_edges: DataFrame,
           hop: int = 1) -> DataFrame:
    """seeds -> neighbourhood -> closure -> minus blocked -> conflicts -> routable status."""
    start = seeds.select("task_id", "id")
    if hop > 1:
        start = routing.k_hop(start, edges, hop - 1)
    wide = routing.dependency_closure(start, edges, skills)
    # stored, as conflicts and the route both read it; a record that is not routable still takes part in conflicts
    open_ = durable(routing.open_records(wide, skills, block_edges))
    kept = routing.resolve_conflicts(open_, start, edges, skills)
    return kept.filter("routable").select("task_id", "id")


def route(tasks: DataFrame, skills: DataFrame, edges: DataFrame, block_edges: DataFrame,
          guard_edges: DataFrame | None = None, index: Bm25Index | None = None, top: int = 3,
          hop: int = 1, type_boost: float = 0.0, retriever: str = "bm25",
          external_seeds: DataFrame | None = None) -> Routes:
    """Route ``tasks(task_id, text, task_type)`` over a skill graph.

    Pass a stored ``index`` to search without touching bodies; ``external_seeds(task_id, id,
    rank)`` take the place of lexical seeds where they name a known record.
    """
    pool = routing.candidate_pool(skills)
    index = index or pool_index(pool)
    seeds = routing.lexical_seeds(tasks, pool, index, top, type_boost, retriever)
    if external_seeds is not None:
        seeds = routing.seed_override(tasks, external_seeds, skills, seeds, top)
    seeds = durable(seeds.select("task_id", "id", "rank"))
    nodes = durable(expand(seeds, skills, edges, block_edges, hop))
    return Routes(tasks, pool, skills, edges, guard_edges, seeds, nodes)


def role_tasks(tasks: DataFrame, roles: list[str]) -> DataFrame:
    """One task row per role; the id becomes task/role so that every role gets its own route."""
    per = tasks.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    return per.withColumn("task_id", F.concat(F.col("task_id").cast("string"), F.lit("/"),
                                              F.col("role")))


def role_routes(tasks: DataFrame, roles: list[str], *args, **kw) -> Routes:
    return route(role_tasks(tasks, roles), *args, **kw)
