"""Keeping the library small: near-duplicates, merges, splits, links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import (loaded_tokens, paragraphs, section_name, slugify,
                              vector_text)
from ..functions.vectors import hash_embed_packed
from ..session import durable
from .containment import uncontained
from .ordered import first_k, prefix, range_rank, row_index
from .pairs import salted_join
from .routing import layer_of
from .similarity import similar

# Fixed value: the number appended to a slug that is already taken, 2 or more.
_SUFFIX = r"-([2-9]|[1-9]\d+)$"


def embed(df: DataFrame, text: Column | str = "text", dim: int = 256,
          keep: list[str] = ()) -> DataFrame:
    """Packed hashed vectors (id, ord, buckets, tf) of whole texts."""
    packed = hash_embed_packed(df, "id", text, dim)
    return df.select("id", "ord", *keep).join(packed, "id")


def _fold_copies(vectors: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add ``gid`` (ord of the first copy of the same vector). The vectors are stored, as both sides read them."""
    vectors = durable(vectors)
    payload = ["buckets", "tf"] if "buckets" in vectors.columns else ["vec"]
    groups = vectors.groupBy(*[F.col(c).alias(f"_g_{c}") for c in payload]).agg(
        F.min("ord").alias("gid"))
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return vectors.join(groups, same).select(*vectors.columns, "gid"), payload


def similarity_edges(vectors: DataFrame, existing: DataFrame | None = None,
                     threshold: float = 0.5, k: int = 8, dim: int = 256) -> DataFrame:
    """alternative_to edges: per record the k most similar earlier ones at or over threshold.

    Of a group of identical vectors only the first k can be targets. The (k+1)-th copy already
    sees at least k records of the highest similarity before it, so later copies have the same
    edges and take them by an equi join; the similarity step sees at most k + 1 copies of anything.
    Pairs that have an edge already are dropped after the top k is taken.
    """
    folded, payload = _fold_copies(vectors)
    folded = durable(folded)
    near = durable(first_k(folded.drop(*payload), ["gid"], [F.col("ord").asc()], k + 1, "_c"))
    kept = folded.join(near.select("id", "_c"), "id")
    found = similar(kept, kept.filter(F.col("_c") <= k), dim, threshold, k, earlier_only=True)
    best = first_k(found, ["left_id"], [F.col("sim").desc(), F.col("right_ord").asc()], k)
    best = durable(best.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"),
                               F.col("sim").alias("weight"), "rank"))
    last = near.filter(F.col("_c") == k + 1).select(F.col("id").alias("src"), "gid")
    late = folded.select("id", "gid").join(near.select("id"), "id", "left_anti")
    shared = best.join(last, "src").select("gid", "dst", "weight", "rank")
    copied = salted_join(late, shared, "gid", "id").select(
        F.col("id").alias("src"), "dst", "weight", "rank")
    out = best.unionByName(copied).withColumn("type", F.lit("alternative_to"))
    if existing is not None:
        out = out.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    return out


def nearest(queries: DataFrame, nodes: DataFrame, threshold: float, dim: int = 256) -> DataFrame:
    """Most similar node per query, first one on ties, null under the threshold.

    Copies of a node cannot win over the first copy, and copies of a query share its answer, so
    both sides are folded before they are compared.
    """
    q, payload = _fold_copies(queries)
    n, _ = _fold_copies(nodes)
    q = durable(q)
    heads = q.filter(F.col("ord") == F.col("gid"))
    targets = n.filter(F.col("ord") == F.col("gid"))
    found = similar(heads, targets, dim, threshold, 1)
    best = found.filter(F.col("sim") > 0).groupBy("left_id").agg(
        F.max_by(F.struct("right_id", "sim"), F.struct("sim", -F.col("right_ord"))).alias("_b"))
    by_group = heads.select(F.col("id").alias("left_id"), "gid").join(best, "left_id").select(
        "gid", F.col("_b.right_id").alias("node"), "_b.sim")
    return q.select("id", "gid").join(by_group, "gid", "left").select("id", "node", "sim")


PARTNERS = 16  # earlier partners kept per record at a time
LAST = 1 << 16  # records that one task settles, once no more are left
FRONT = 16  # first edits of a slug that are looked at together; so many times more whenever none of them creates it
HEAD = 1 << 13  # earliest targets that are asked first; most records of large families need no others


class EarlierPartners:
    """The first few earlier similar records of each asking record, more only when those are settled.

    In a family of m near copies everything waits for the first member, and every member has it among its first ``PARTNERS``
    partners, so a family costs m * PARTNERS rows, not m * m. A record whose partners have all been settled without
    staying, while it may have further ones, is asked again among what is still there.
    """

    def __init__(self, asking: DataFrame, targets: DataFrame, threshold: float, dim: int):
        """``asking`` and ``targets`` are vectors with id and ord; answers are by ord."""
        self.asking, self.targets, self.threshold, self.dim = asking, targets, threshold, dim
        self.pairs, self.more = self._ask(asking, targets)
        self.any_more = not self.more.isEmpty()

    def _first(self, asking: DataFrame, targets: DataFrame) -> DataFrame:
        """The first partners of each record, those among the ``HEAD`` earliest targets before all others."""
        def found(a: DataFrame, t: DataFrame) -> DataFrame:
            return similar(a, t, self.dim, self.threshold, earlier_only=True, first=PARTNERS + 1)

        if asking.limit(HEAD).count() < HEAD:  # one search costs less than two
            return found(asking, targets)
        head = targets.select("ord").orderBy("ord").limit(HEAD).agg(F.count("*").alias("n"), F.max("ord").alias("end")).first()
        if head["n"] < HEAD:
            return found(asking, targets)
        early = found(asking, targets.filter(F.col("ord") <= head["end"]))
        done = early.groupBy(F.col("left_id").alias("id")).count().filter(F.col("count") > PARTNERS).select("id")
        late = F.col("ord") > head["end"]
        return early.unionByName(found(asking.filter(late).join(done, "id", "left_anti"), targets.filter(late)))

    def _ask(self, asking: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept = first_k(self._first(asking, targets), ["left_id"], [F.col("right_ord").asc()], PARTNERS + 1)
        kept = durable(kept.join(asking.select(F.col("id").alias("left_id"), F.col("ord").alias("e")), "left_id").select(
            "e", F.col("right_ord").alias("h"), "sim", "rank"))
        return kept.filter(F.col("rank") <= PARTNERS).select("e", "h", "sim"), kept.filter(F.col("rank") > PARTNERS).select("e")

    def ask_also(self, asking: DataFrame) -> None:
        """Take in further asking records."""
        self.asking = self.asking.unionByName(asking)
        pairs, more = self._ask(asking, self.targets)
        self.pairs, self.more = self.pairs.unionByName(pairs), self.more.unionByName(more)
        self.any_more = not self.more.isEmpty()

    def among(self, todo: DataFrame, stays: DataFrame, again: bool = False) -> DataFrame:
        """(e, h, stays): partners of ``todo(e)`` that stay (``stays(h)``) or are still to do; none that was settled otherwise.
        Records that must be asked again wait as rows without a partner, until ``again`` does it for all of them at once."""
        live = stays.select("h", F.lit(True).alias("stays")).unionByName(
            todo.select(F.col("e").alias("h"), F.lit(False).alias("stays")))
        near = self.pairs.join(todo.select("e"), "e", "left_semi").join(live, "h").select("e", "h", "stays")
        if not self.any_more:
            return near
        near = durable(near)
        spent = self.more.join(todo.select("e"), "e", "left_semi").join(near.select("e").distinct(), "e", "left_anti")
        if not again:
            return near.unionByName(spent.select("e", F.lit(None).cast("long").alias("h"), F.lit(False).alias("stays")))
        spent = durable(spent)
        asking = self.asking.join(spent.select(F.col("e").alias("ord")), "ord", "left_semi")
        targets = self.targets.join(live.select(F.col("h").alias("ord")).distinct(), "ord", "left_semi")
        pairs, more = self._ask(asking, targets)
        self.pairs = durable(self.pairs.join(spent, "e", "left_anti").unionByName(pairs))
        self.more = durable(self.more.join(spent, "e", "left_anti").unionByName(more))
        self.any_more = not self.more.isEmpty()
        return self.pairs.join(todo.select("e"), "e", "left_semi").join(live, "h").select("e", "h", "stays")


    def settled(self, todo: DataFrame, stays: DataFrame, again: bool) -> DataFrame:
        """(e, stays) for the records of a small ``todo(e)`` that can be decided, one after the other in one task; the others
        need to be asked again. At most ``LAST`` records with ``PARTNERS`` partners each."""
        near = self.among(todo, stays, again)
        rows = todo.join(near, "e", "left").join(self.more.withColumn("more", F.lit(True)), "e", "left").select(
            "e", F.coalesce("h", F.lit(0)).alias("h"), F.isnotnull("h").alias("near"), F.coalesce("stays", F.lit(False)).alias("stays"),
            F.coalesce("more", F.lit(False)).alias("more"), F.lit(0).alias("_all"))

        def decide(pdf: pd.DataFrame) -> pd.DataFrame:
            state: dict[int, bool | None] = {}
            pdf = pdf.sort_values("e", kind="stable")
            e, h, near, stays, more = (pdf[c].tolist() for c in ("e", "h", "near", "stays", "more"))
            at = 0
            while at < len(e):
                end = at + 1
                while end < len(e) and e[end] == e[at]:
                    end += 1
                partners = [state.get(h[i]) for i in range(at, end) if near[i]]
                if any(stays[at:end]) or True in partners:
                    state[e[at]] = False
                elif None in partners or more[at]:
                    state[e[at]] = None
                else:
                    state[e[at]] = True
                at = end
            known = [(e, x) for e, x in state.items() if x is not None]
            return pd.DataFrame({"e": np.array([e for e, _ in known], np.int64), "stays": np.array([x for _, x in known], bool)})

        return rows.groupBy("_all").applyInPandas(decide, "e long, stays boolean")  # LAST records


def fold_assignments(fragments: DataFrame, nodes: DataFrame, threshold: float = 0.80,
                     dim: int = 256) -> DataFrame:
    """Decide each fragment in ``ord`` order: fold into the most similar earlier record or insert.

    A fragment is folded as soon as any earlier record that stays (an existing node or an inserted
    fragment) reaches the threshold; it is inserted once every earlier similar fragment is known
    to have been folded. Each round settles all fragments for which that is known, and the last ``LAST`` are settled in one task. Similar pairs are never
    listed in full: rounds work on the first few partners, and targets come from one search among the records that stay. Returns
    (id, ord, action, target, sim).
    """
    every = nodes.withColumn("_node", F.lit(True)).unionByName(
        fragments.withColumn("_node", F.lit(False)))
    folded, payload = _fold_copies(every)
    folded = durable(folded)
    heads = folded.filter(F.col("ord") == F.col("gid"))
    asking = heads.filter(~F.col("_node"))
    partners = EarlierPartners(asking, heads, threshold, dim)
    todo = durable(asking.select(F.col("gid").alias("e")))
    stays = durable(heads.filter("_node").select(F.col("gid").alias("h")))
    before, left_over = -1, todo.count()
    settled = False
    while left_over:
        if left_over <= LAST:
            # one task has settled all that the listed partners tell, so the next one must ask for more
            known = durable(partners.settled(todo, stays, again=settled or left_over == before))
            settled = True
            stays = durable(stays.unionByName(known.filter("stays").select(F.col("e").alias("h"))))
            todo = durable(todo.join(known.select("e"), "e", "left_anti"))
            before, left_over = left_over, todo.count()
            continue
        near = partners.among(todo, stays, again=left_over == before)
        hit = near.filter("stays").select("e").distinct()
        waits = near.filter(~F.col("stays")).select("e").distinct()
        left = todo.join(hit, "e", "left_anti")
        stays = durable(stays.unionByName(left.join(waits, "e", "left_anti").select(F.col("e").alias("h"))))
        todo = durable(left.join(waits, "e", "left_semi"))
        before, left_over = left_over, todo.count()
    # targets: the best record that stays and came earlier. A later copy may also take one that came in between; those are
    # inserted fragments, of which no two are similar, so a record has few of them
    kept = heads.join(stays.select(F.col("h").alias("ord")), "ord", "left_semi")
    gone = asking.join(stays.select(F.col("h").alias("ord")), "ord", "left_anti")
    # who has no more partners than were listed has its answer among them; only the others, and nodes that have copies, search
    rows = folded.filter(~F.col("_node")).select("id", "ord", F.col("gid").alias("g"))
    copied = rows.filter(F.col("ord") != F.col("g")).select(F.col("g").alias("ord")).distinct()
    many = partners.more.select(F.col("e").alias("ord")).distinct()
    asks = gone.join(many, "ord", "left_semi").unionByName(heads.filter("_node").join(copied, "ord", "left_semi"))
    listed = (partners.pairs.join(many.withColumnRenamed("ord", "e"), "e", "left_anti").join(stays, "h", "left_semi")
              .join(gone.select(F.col("gid").alias("e")), "e", "left_semi").select(F.col("e").alias("g"), "h", "sim"))
    earlier = first_k(similar(asks, kept, dim, threshold, 1, earlier_only=True), ["left_id"],
                      [F.col("sim").desc(), F.col("right_ord").asc()], 1).drop("rank")
    between = similar(gone.join(copied, "ord", "left_semi"), kept.filter(~F.col("_node")), dim, threshold, same_table=True)
    options = (heads.select(F.col("id").alias("left_id"), F.col("gid").alias("g")).join(earlier.unionByName(between), "left_id")
               .select("g", F.col("right_ord").alias("h"), "sim").unionByName(listed).distinct()
               .unionByName(kept.select(F.col("gid").alias("g"), F.col("gid").alias("h"), F.lit(1.0).alias("sim"))))
    choice = (salted_join(rows, options, "g", "id").filter(F.col("h") < F.col("ord"))
              .groupBy("id").agg(F.max_by(F.struct("h", "sim"), F.struct("sim", -F.col("h"))).alias("_b")))
    names = heads.select(F.col("gid").alias("_h"), F.col("id").alias("target"))
    return (rows.join(choice, "id", "left")
            .select("id", "ord", F.col("_b.h").alias("_h"), F.col("_b.sim").alias("sim"))
            .join(names, "_h", "left")
            .select("id", "ord", F.when(F.col("target").isNull(), "insert").otherwise("merge")
                    .alias("action"), "target", "sim"))


def suffixed_ids(new: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """Ids for inserts: the slug of the name, then slug-2, slug-3, ... in ``ord`` order.

    A slug never holds a hyphen, so an existing id blocks a number only when it is that very
    suffix of the same slug; blocked numbers are skipped.
    """
    slug = new.select("*", slugify(name).alias("_slug"))
    used = taken.select(
        F.regexp_replace("id", _SUFFIX, "").alias("_slug"),
        F.coalesce(F.regexp_extract("id", _SUFFIX, 1).try_cast("long"), F.lit(1))
        .alias("_n"))
    used = used.join(slug.select("_slug").distinct(), "_slug", "left_semi").distinct()
    # free number for position p: p + 1 + how many used numbers lie at or below it
    shift = used.select("_slug", F.col("_n")).withColumn("_ord", F.col("_n"))
    before = row_index(shift, ["_slug"], "_ord", "_b").select(
        "_slug", (F.col("_n") - F.col("_b")).alias("_from"))
    # used number n with b used below it pushes every position whose free rank is >= n - b
    at = row_index(slug, ["_slug"], "ord", "_p").withColumn("_p", F.col("_p") + 1)
    steps = before.groupBy("_slug", "_from").agg(F.count("*").alias("_k"))
    ranks = (at.select("_slug", F.col("_p").alias("_o"), F.lit(0).cast("long").alias("_k"), "ord",
                       F.lit(1).alias("_row"))
             .unionByName(steps.select("_slug", F.col("_from").alias("_o"), "_k",
                                       F.lit(None).cast("long").alias("ord"),
                                       F.lit(0).alias("_row"))))
    # shifts sort before the row of the same number: order key 2*o + row
    ranks = ranks.withColumn("_key", F.col("_o") * 2 + F.col("_row"))
    pushed = prefix(ranks, ["_slug"], "_key", {"_add": ("sum", "_k")}).filter("_row = 1").select(
        "ord", (F.col("_o") + F.col("_add")).alias("_num"))
    return at.join(pushed, "ord").select(
        *new.columns, F.when(F.col("_num") == 1, F.col("_slug")).otherwise(
            F.concat("_slug", F.lit("-"), F.col("_num").cast("string"))).alias("new_id"))


def fold_fragments(fragments: DataFrame, skills: DataFrame, step: int, threshold: float = 0.80,
                   dim: int = 256) -> dict[str, DataFrame]:
    """Fold a batch of ``fragments(frag, ord, name, description, body, task_types, evidence)``
    into ``skills(id, ord, name, description, body, status)``.

    Fragment ord continues after the skills' ord. Returns ``inserted`` rows, ``merged`` rows
    (fragment -> target), and long tables ``types``, ``evidence`` and ``rules``.
    """
    keyed = fragments.withColumn("id", F.concat(F.lit("\x00"), F.col("frag").cast("string")))
    if threshold > 1.0:  # no cosine gets there: everything is new
        decided = keyed.select("id", "ord", F.lit("insert").alias("action"),
                               F.lit(None).cast("string").alias("target"),
                               F.lit(None).cast("double").alias("sim"))
    else:
        text = vector_text("name", "description", "body")
        nodes = embed(skills.filter(F.col("status") != "retired"), text, dim)
        decided = durable(fold_assignments(embed(keyed, text, dim), nodes, threshold, dim))
    f = fragments.withColumn("_fid", F.concat(F.lit("\x00"), F.col("frag").cast("string")))
    new = decided.filter("action = 'insert'").select(F.col("id").alias("_fid")).join(f, "_fid")
    inserted = durable(suffixed_ids(new, skills))
    ids = skills.select(F.col("id").alias("target"), F.col("id").alias("node_id")).unionByName(
        inserted.select(F.col("_fid").alias("target"), F.col("new_id").alias("node_id")))
    merged = (decided.filter("action = 'merge'")
              .select(F.col("id").alias("_fid"), "target", "sim")
              .join(f, "_fid").join(ids, "target")
              .select("frag", "ord", "name", "node_id", "sim", "task_types", "evidence"))
    merged = durable(merged)
    where = inserted.select("frag", "ord", F.col("new_id").alias("node_id"), "task_types",
                            "evidence").unionByName(
        merged.select("frag", "ord", "node_id", "task_types", "evidence"))
    numbered = row_index(merged, [], "ord", "_n")
    rules = numbered.select(
        slugify(F.concat(F.lit("merge_"), "node_id", F.lit(f"_{step}_"),
                         (F.col("_n") + 1).cast("string"))).alias("id"),
        F.lit("merge_decision").alias("kind"),
        F.concat(F.lit("fragment '"), "name", F.lit("' folded into "), "node_id",
                 F.lit(" (sim "), F.format_string("%.2f", F.round("sim", 2)), F.lit(")"))
        .alias("statement"), F.col("node_id").alias("target")).unionByName(
        inserted.select(
            slugify(F.concat(F.lit("insert_"), "new_id", F.lit(f"_{step}"))).alias("id"),
            F.lit("insert_decision").alias("kind"),
            F.concat(F.lit("insert '"), "name", F.lit("' from "),
                     F.size("evidence").cast("string"), F.lit(" trajectory evidence(s)"))
            .alias("statement"), F.col("new_id").alias("target")))
    return {
        "inserted": inserted.select(F.col("new_id").alias("id"), "frag", "ord", "name",
                                    "description", "body", F.lit("candidate").alias("status")),
        "merged": merged.select("frag", F.col("node_id").alias("id"), "sim"),
        "types": where.select(F.col("node_id").alias("id"), F.explode("task_types")
                              .alias("task_type")).distinct(),
        "evidence": where.select(F.col("node_id").alias("id"), F.explode("evidence")
                                 .alias("trace")).distinct(),
        "rules": rules,
    }


def patch_edits(patches: DataFrame) -> DataFrame:
    """One row per edit of ``patches(patch, task_id, task_type, edits)``, in arrival order."""
    e = patches.select("patch", "task_id", "task_type", F.posexplode("edits").alias("_p", "e"))
    return e.select(
        (F.col("patch") * F.lit(1 << 20) + F.col("_p")).alias("seq"), "task_id", "task_type",
        section_name("e.target_section", "e.after_section", "e.file").alias("name"),
        F.regexp_replace(F.coalesce("e.content", F.lit("")), r"(?U)^\s+|\s+$", "").alias("body"),
    ).withColumn("slug", slugify("name"))


def absorb_edits(edits: DataFrame, skills: DataFrame, threshold: float = 0.82,
                 dim: int = 256) -> dict[str, DataFrame]:
    """Route every edit to a record: same slug, else the nearest record, else a new one.

    Edits act in ``seq`` order. Of the edits of an unknown slug the first that is near no record
    present at that time creates it; those before go to their nearest record, those after to the
    slug. Each round settles every slug for which the earlier edits it depends on are settled.
    Similarity is to the text a record had at the start of the batch or was created with.

    ``skills(id, ord, name, description, body, status)``, seq >= 0. Returns ``nodes`` (created), ``assigned``
    (seq -> id), and long tables ``bodies`` (the parts appended to each record, with their first seq: a body that the record's
    text or an earlier part contains is not appended), ``types`` and ``evidence``.
    """
    known = skills.select(F.col("id").alias("slug"))
    fresh = durable(edits.join(known, "slug", "left_anti"))
    reps = fresh.groupBy("slug", "body").agg(
        F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
    base = skills.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_base"))
    reps = durable(reps.crossJoin(F.broadcast(base))  # one row
                   .withColumn("ord", F.col("_base") + F.col("seq"))
                   .withColumn("id", F.concat(F.lit("\x00"), F.col("seq").cast("string"))))
    own = embed(reps, F.concat("name", F.lit(". "), "name", F.lit(" "), "body"), dim)
    there = embed(skills.filter(F.col("status") != "retired"),
                  vector_text("name", "description", "body"), dim)
    there = durable(there.unionByName(own))

    def vectors(e: DataFrame) -> DataFrame:
        asked = reps.join(e.select(F.col("e").alias("ord")).distinct(), "ord", "left_semi")
        return embed(asked, F.concat("name", F.lit(" "), "body"), dim)

    todo = durable(reps.select("slug", F.col("ord").alias("e")))
    stays = durable(skills.filter(F.col("status") != "retired").select(
        F.lit(None).cast("string").alias("slug"), F.col("ord").alias("h")))
    # only the first edits of a slug are looked at, and more of them once those are settled without creating it
    partners, asked, width = None, todo.limit(0), FRONT
    before, left_over, more_asked = -1, todo.count(), False
    while left_over:
        rank = F.rank().over(Window.partitionBy("slug").orderBy("e"))
        open_slugs = todo.join(asked, ["slug", "e"], "left_semi").select("slug").distinct()
        front = durable(todo.join(open_slugs, "slug", "left_anti").withColumn("_r", rank).filter(F.col("_r") <= width).drop("_r"))
        more_asked = not front.isEmpty()
        if more_asked:
            width *= FRONT
            asked = durable(asked.unionByName(front))
            if partners is None:
                partners = EarlierPartners(durable(vectors(front)), there, threshold, dim)
            else:
                partners.ask_also(durable(vectors(front)))
        near = durable(partners.among(todo.select("e"), stays.select("h"), again=left_over == before and not more_asked))
        hit = near.filter("stays").select("e").distinct()
        waits = near.filter(~F.col("stays")).select("e").distinct()
        looked = todo.join(asked, ["slug", "e"], "left_semi")
        open_ = looked.join(hit, "e", "left_anti")
        head = open_.groupBy("slug").agg(F.min("e").alias("e"))
        born = durable(head.join(waits, "e", "left_anti").select("slug", F.col("e").alias("h")))
        stays = durable(stays.unionByName(born))
        # settled: slugs just created, and edits before the first open one of their slug
        ends = looked.groupBy("slug").agg(F.max("e").alias("_looked")).join(
            head.select("slug", F.col("e").alias("_first")), "slug", "left")
        rest = todo.join(born.select("slug"), "slug", "left_anti").join(ends, "slug", "left")
        todo = durable(rest.filter(F.coalesce(F.col("e") >= F.col("_first"), F.col("e") > F.col("_looked"), F.lit(True)))
                       .select("slug", "e"))
        before, left_over = left_over, todo.count()
    made = stays.filter(F.col("slug").isNotNull())
    born_at = made.select("slug", F.col("h").alias("_born"))
    rows = (fresh.join(reps.select("slug", "body", F.col("ord").alias("e")), ["slug", "body"])
            .crossJoin(F.broadcast(base)).withColumn("_at", F.col("_base") + F.col("seq"))
            .join(born_at, "slug", "left")
            .withColumn("_own", F.coalesce(F.col("_at") >= F.col("_born"), F.lit(False))))
    # rows of other slugs than their own go to the best record before them. Skills come before all edits; what was created
    # between an edit and its last copy is one record per slug at most
    lost = durable(rows.filter(~F.col("_own")).select("seq", "_at", "e"))
    kept = there.join(stays.select(F.col("h").alias("ord")), "ord", "left_semi")
    earlier = first_k(similar(vectors(lost), kept, dim, threshold, 1, earlier_only=True), ["left_id"],
                      [F.col("sim").desc(), F.col("right_ord").asc()], 1).drop("rank")
    between = similar(vectors(lost.filter(F.col("_at") > F.col("e"))), there.join(made.select(F.col("h").alias("ord")), "ord", "left_semi"),
                      dim, threshold, same_table=True)
    options = earlier.unionByName(between).join(reps.select(F.col("id").alias("left_id"), F.col("ord").alias("e")), "left_id").select(
        "e", F.col("right_ord").alias("h"), F.col("right_id").alias("h_id"), "sim").distinct()
    nearest_one = (salted_join(lost, options, "e", "seq").filter(F.col("h") < F.col("_at"))
                   .groupBy("seq").agg(F.max_by("h_id", F.struct("sim", -F.col("h")))
                                       .alias("h_id")))
    names = reps.select(F.col("id").alias("h_id"), F.col("slug").alias("_made"))
    placed = nearest_one.join(names, "h_id", "left").select(
        "seq", F.coalesce("_made", "h_id").alias("_target"))
    assigned = durable(edits.join(placed, "seq", "left").select(
        "seq", "slug", "name", "body", "task_id", "task_type",
        F.coalesce("_target", "slug").alias("id")))
    parts = assigned.filter(F.length("body") > 0).groupBy("id", "body").agg(
        F.min("seq").alias("seq"))
    seeds = skills.join(parts.select("id").distinct(), "id", "left_semi").select(
        "id", F.lit(-1).cast("long").alias("seq"), F.coalesce("body", F.lit("")).alias("body"))
    kept = uncontained(seeds.filter(F.length("body") > 0).unionByName(parts.select("id", "seq", "body")))
    return {
        "nodes": reps.join(made.select(F.col("h").alias("ord")), "ord", "left_semi").select(
            F.col("slug").alias("id"), "name", F.col("name").alias("description"), "body",
            F.lit("candidate").alias("status"), "ord"),
        "assigned": assigned.select("seq", "id", "task_id", "task_type"),
        "bodies": kept.filter("seq >= 0").select("id", "body", "seq"),
        "types": assigned.filter(F.length("task_type") > 0).groupBy("id", "task_type").agg(
            F.min("seq").alias("seq")),
        "evidence": assigned.filter(F.length("task_id") > 0).groupBy("id", "task_id").agg(
            F.min("seq").alias("seq")),
    }


def grown(absorbed: dict[str, DataFrame], skills: DataFrame) -> dict[str, DataFrame]:
    """Records after ``absorb_edits``, without their text in one value: ``records(id, ord, name, description, status, body_len,
    n_types)``, ``parts(id, seq, body)`` from the text at the start (seq -1) on, and ``types(id, task_type, n)`` in order of
    arrival. ``skills`` may have ``task_types``, which come first."""
    base = skills.select("id", "ord", "name", "description", "status").unionByName(
        absorbed["nodes"].select("id", "ord", "name", "description", "status"))
    parts = skills.filter(F.length("body") > 0).select("id", F.lit(-1).cast("long").alias("seq"), "body").unionByName(
        absorbed["bodies"].select("id", "seq", "body"))
    size = parts.groupBy("id").agg((F.sum(F.length("body") + 2) - 2).alias("body_len"))
    types = absorbed["types"].select("id", "task_type", "seq")
    if "task_types" in skills.columns:
        old = skills.select("id", F.posexplode("task_types").alias("_p", "task_type")).select(
            "id", "task_type", (F.col("_p") - (1 << 31)).cast("long").alias("seq"))
        types = old.unionByName(types).groupBy("id", "task_type").agg(F.min("seq").alias("seq"))
    ranked = range_rank(types, [F.col("id"), F.col("seq"), F.col("task_type")], "_at")
    heads = ranked.groupBy("id").agg(F.min("_at").alias("_from"), F.count("*").alias("n_types"))
    types = durable(ranked.join(heads, "id").select("id", "task_type", (F.col("_at") - F.col("_from")).alias("n"), "n_types"))
    records = base.join(size, "id", "left").join(types.select("id", "n_types").distinct(), "id", "left").select(
        *base.columns, F.coalesce("body_len", F.lit(0)).alias("body_len"), F.coalesce("n_types", F.lit(0)).alias("n_types"))
    return {"records": records, "parts": parts, "types": types.select("id", "task_type", "n")}


def absorb_patches(edits: DataFrame, skills: DataFrame, step: int, threshold: float = 0.82, dim: int = 256,
                   max_tokens: int = 600, min_types: int = 3) -> dict[str, DataFrame]:
    """``absorb_edits``, then the split of every record that has become large and serves several task types.

    One child per task type, in order of arrival, has the paragraph of that number of the record's text (else the first, else
    the description). Adds to the result of ``absorb_edits`` what ``split`` returns, as ``children``, ``parents``, ``edges`` and
    ``rules``, and ``child_evidence(id, task_id)``: children have their parent's evidence.
    """
    out = {k: durable(v) for k, v in absorb_edits(edits, skills, threshold, dim).items()}
    now = grown(out, skills)
    records = durable(now["records"])
    large = records.filter((F.col("status") != "retired") & (F.floor(F.col("body_len") / 4) >= max_tokens)
                           & (F.col("n_types") >= max(min_types, 2)))
    kids = large.join(now["types"], "id")
    # paragraphs are numbered over all parts of a record; only as many as it has task types are looked at
    pieces = now["parts"].join(large.select("id", "n_types"), "id").withColumn("_p", paragraphs("body"))
    numbered = prefix(pieces, ["id"], "seq", {"_from": ("sum", F.size("_p").cast("long"))}).filter(
        F.col("_from") < F.col("n_types"))
    each = numbered.select("id", "_from", F.posexplode("_p").alias("_i", "paragraph")).select(
        "id", (F.col("_from") + F.col("_i")).alias("n"), "paragraph")
    each = durable(each)
    lead = each.filter("n = 0").select("id", F.col("paragraph").alias("_lead"))
    named = F.concat("name", F.lit(" for "), "task_type")
    children = kids.join(each, ["id", "n"], "left").join(lead, "id", "left").select(
        F.col("id").alias("parent"), F.col("n").alias("child_no"), F.col("task_type").alias("child_type"),
        slugify(named).alias("id"), named.alias("name"),
        F.concat("name", F.lit(" specialised for "), "task_type", F.lit(" tasks")).alias("description"),
        F.coalesce("paragraph", "_lead", "description").alias("body"))
    cut = split(records, durable(children), step)
    evidence = cut["children"].select("id", "parent").join(
        out["evidence"].select(F.col("id").alias("parent"), "task_id"), "parent").select("id", "task_id")
    return {**out, **cut, "child_evidence": evidence}


# ---------------------------------------------------------------------------------- links
def latest_edges(edges: DataFrame) -> DataFrame:
    """One edge per (layer, src, dst): the one with the highest ``seq``."""
    e = edges.withColumn("layer", layer_of("type"))
    return e.groupBy("layer", "src", "dst").agg(
        F.max_by(F.struct("type", "weight"), "seq").alias("_v"), F.max("seq").alias("seq")).select(
        "layer", "src", "dst", "_v.type", "_v.weight", "seq")


def link(edges: DataFrame, new: DataFrame, skills: DataFrame) -> DataFrame:
    """Upsert edges whose two ends exist; the later type of a pair wins within its layer."""
    ids = skills.select("id")
    ok = (new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
          .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    cols = ["src", "dst", "type", "weight", "seq"]
    return latest_edges(edges.select(*cols).unionByName(ok.select(*cols)))


def declared_links(new: DataFrame) -> DataFrame:
    """(id, field, value): list columns that linking extends."""
    return new.filter(F.col("type").isin("depends_on", "conflicts_with")).select(
        F.col("src").alias("id"),
        F.when(F.col("type") == "depends_on", "dependencies").otherwise("conflicts")
        .alias("field"), F.col("dst").alias("value")).distinct()


def unlink(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Remove the edge of each pair in the layer of the named type, whatever type it has."""
    gone = pairs.select(layer_of("type").alias("layer"), "src", "dst").distinct()
    return edges.withColumn("layer", layer_of("type")).join(
        gone, ["layer", "src", "dst"], "left_anti")


def insert(skills: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append records with new ids, the first by ord of each; also returns the refused rows."""
    first = new.groupBy("id").agg(F.min("ord").alias("ord"))
    fresh = new.join(first, ["id", "ord"], "left_semi").join(
        skills.select("id"), "id", "left_anti")
    refused = new.join(fresh.select("id", "ord"), ["id", "ord"], "left_anti")
    return skills.unionByName(fresh.select(*skills.columns)), refused


# ---------------------------------------------------------------------------------- merge, split
def merge_groups(skills: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """Merge each group of two or more present records into the one with most successes.

    ``groups(group, id)``; ties go to the lower ord. Lists come back in long form, because the
    union over a big group has no bound. Returns survivors, retired, edges and members.
    """
    m = groups.join(skills, "id")
    agg = m.groupBy("group").agg(
        F.count("*").alias("_n"),
        F.max_by("id", F.struct("success_count", -F.col("ord"))).alias("survivor"),
        F.sum("success_count").alias("success_count"),
        F.sum("failure_count").alias("failure_count"), F.sum("n_visit").alias("n_visit"))
    survivors = durable(agg.filter(F.col("_n") >= 2).withColumnRenamed("_n", "members"))
    types = (m.select("group", F.explode("task_types").alias("task_type")).distinct()
             .groupBy("group").agg(F.count("*").alias("coverage")))
    away = (m.select("group", "id").join(survivors.select("group", "survivor"), "group")
            .filter(F.col("id") != F.col("survivor")))
    return {
        "survivors": survivors.join(types, "group", "left").withColumn(
            "coverage", F.coalesce("coverage", F.lit(0))),
        "retired": away.select("id"),
        "edges": away.select(F.col("id").alias("src"), F.col("survivor").alias("dst"),
                             F.lit("alternative_to").alias("type")),
        "members": m.select("group", "id").join(survivors.select("group", "survivor"), "group"),
    }


def merge_lists(skills: DataFrame, members: DataFrame, field: str) -> DataFrame:
    """(survivor, value): distinct values of one list column over the merged group."""
    return members.join(skills.select("id", field), "id").select(
        "survivor", F.explode(field).alias("value")).distinct()


def propose_children(skills: DataFrame, mode: str = "paragraphs") -> DataFrame:
    """One child per declared task type: paragraph i (else the first, else the description), or
    with ``mode="copies"`` the whole body."""
    kids = skills.select("*", F.posexplode("task_types").alias("child_no", "child_type"))
    if mode == "copies":
        return kids.select(
            F.col("id").alias("parent"), "child_no", "child_type",
            F.concat(F.col("id").cast("string"), F.lit("--"), slugify("child_type")).alias("id"),
            F.concat("name", F.lit(" ("), "child_type", F.lit(")")).alias("name"),
            F.concat("description", F.lit(" ["), "child_type", F.lit("]")).alias("description"),
            "body")
    parts = paragraphs("body")
    named = F.concat("name", F.lit(" for "), "child_type")
    return kids.select(
        F.col("id").alias("parent"), "child_no", "child_type", slugify(named).alias("id"),
        named.alias("name"),
        F.concat("name", F.lit(" specialised for "), "child_type", F.lit(" tasks"))
        .alias("description"),
        F.coalesce(F.get(parts, F.col("child_no")), F.get(parts, F.lit(0)), F.col("description"))
        .alias("body"))


def router_stub(children: DataFrame) -> DataFrame:
    """(parent, stub) body of a split parent, from (parent, parent_name, parent_description,
    child_no, name, description). A parent has one child per task type, a short list."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(
        "child_no", F.concat(F.lit("- **"), "name", F.lit("**: "), "description").alias("line")))),
        lambda e: e["line"])
    return children.groupBy("parent", "parent_name", "parent_description").agg(
        lines.alias("_l")).select(
        "parent", F.concat(F.lit("# "), "parent_name", F.lit("\n"), "parent_description",
                           F.lit("\n\n## Sub-skills\n"), F.array_join("_l", "\n")).alias("stub"))


def split(skills: DataFrame, children: DataFrame, step: int,
          child_status: str = "candidate") -> dict[str, DataFrame]:
    """Turn parents into thin plan records over their children.

    ``children(parent, child_no, id, name, description, body, child_type)``. Children are numbered by (parent's ``ord``
    if there is one, parent, child_no) in ``ord``. An id that exists, or that an earlier child has, becomes
    slug(name + parent), with -2, -3, ... where that is in use too. The pair's parent_child edge is overwritten by depends_on, since a
    pair has one edge per layer.
    """
    taken = skills.select("id", F.lit(True).alias("_t"))
    owner = skills.select(F.col("id").cast("string").alias("parent"),
                          F.col("name").alias("parent_name"),
                          F.col("description").alias("parent_description"),
                          (F.col("ord") if "ord" in skills.columns else F.lit(0)).alias("_po"))
    kids = (children.withColumn("id", F.col("id").cast("string")).withColumn("parent", F.col("parent").cast("string"))
            .join(taken.withColumn("id", F.col("id").cast("string")), "id", "left").join(owner, "parent"))
    kids = durable(range_rank(kids, [F.col("_po"), F.col("parent"), F.col("child_no")], "ord"))
    # the first child to ask for a free id has it
    has = kids.filter(F.col("_t").isNull()).groupBy("id").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("_own"))
    kids = kids.join(has, "ord", "left")
    kept = kids.filter("_own").withColumn("new_id", F.col("id"))
    moved = kids.filter(F.col("_own").isNull()).withColumn("_named", F.concat("name", F.lit("_"), "parent"))
    used = taken.select(F.col("id").cast("string").alias("id")).union(kept.select("id"))
    kids = durable(kept.unionByName(suffixed_ids(moved, used, "_named").drop("_named")).withColumn(
        "id", F.col("new_id")).drop("_t", "_po", "_own", "new_id"))
    listed = kids.groupBy("parent").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("child_no", "id"))), lambda e: e["id"])
        .alias("children"))
    return {
        "children": kids.select("parent", "child_no", "ord", "id", "name", "description", "body",
                                "child_type", F.lit("atomic").alias("granularity"),
                                F.lit(child_status).alias("status")),
        "parents": router_stub(kids).withColumn("granularity", F.lit("plan")),
        "edges": kids.select(F.col("parent").alias("src"), F.col("id").alias("dst"),
                             F.lit("depends_on").alias("type")),
        "rules": listed.select(
            slugify(F.concat(F.lit("split_"), "parent", F.lit(f"_{step}"))).alias("id"),
            F.lit("split_decision").alias("kind"),
            F.concat(F.lit("SPLIT "), "parent", F.lit(" into ["),
                     F.array_join(F.transform("children", lambda c: F.concat(
                         F.lit("'"), c, F.lit("'"))), ", "), F.lit("]")).alias("statement"),
            F.concat(F.array("parent"), "children").alias("targets")),
    }


def monolith_rollup(skills: DataFrame, by: str, rows_per_part: int = 256) -> DataFrame:
    """One fat record per domain: bodies joined in ord order, tokens summed.

    A domain may hold most of the library, so its text comes in numbered parts of bounded size;
    the record is the parts in order, joined by a blank line.
    """
    placed = row_index(skills.select(by, "ord", "body", "token_cost"), [by], "ord", "_at")
    part = F.floor(F.col("_at") / F.lit(rows_per_part)).cast("long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))),
                                      lambda e: e["body"]), "\n\n")
    return placed.groupBy(by, part.alias("part")).agg(
        joined.alias("body"), F.count("*").alias("n_skills"),
        F.sum(loaded_tokens("token_cost", "body")).alias("tokens"))


# ---------------------------------------------------------------------------------- sets
def union_lists(*lists: Column | str) -> Column:
    """Distinct values of several list columns, first occurrence order."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def minus_per_task(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("task_id", "id"), ["task_id", "id"], "left_anti")


def both_per_task(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("task_id", "id"), ["task_id", "id"], "left_semi")


def id_differences(requested: DataFrame, found: DataFrame) -> DataFrame:
    """(id, side): requested but not found, and found but not requested."""
    r, f = requested.select("id").distinct(), found.select("id").distinct()
    return (r.subtract(f).withColumn("side", F.lit("not_found"))
            .unionByName(f.subtract(r).withColumn("side", F.lit("not_requested"))))
