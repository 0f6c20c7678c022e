"""Ordered computations that do not put a whole key, or the whole table, into one task.

A plain window over a hot key sorts all of that key's rows in one task, and ``over()`` without a
key sorts the table in one task. Here the order column is a unique integer per key, so the rows
fall into blocks of at most ``width`` consecutive ranks. Each block is one small window, the
per-block totals are scanned one level up, and the two are joined back together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ropewalk.session import durable

WIDTH = 1 << 16


def prefix(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, Column | str]],
           width: int = WIDTH, levels: int = 2, ranked: bool = False) -> DataFrame:
    """Add exclusive prefix aggregates: ``specs`` maps a new column to ``(sum|max|min, input)``.

    ``order`` must be an integer, unique within ``keys``. A sum before the first row is 0, a max
    or min is null. Blocks are cut by the rank of (keys, order), so sparse orders (hashes, time stamps) fill them as
    dense ones do; ``ranked`` says that ``order`` is dense already. The input is computed once, for the ranking.
    """
    made = {n: (F.col(c) if isinstance(c, str) else c) for n, (_, c) in specs.items()}
    src = df.select("*", *[c.alias(f"_in_{n}") for n, c in made.items()])
    if not ranked:
        src = range_rank(src, [*[F.col(k) for k in keys], F.col(order)], "_at")
    src = src.withColumn("_blk", F.floor(F.col(order if ranked else "_at") / F.lit(width)).cast("long"))
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    w = (Window.partitionBy(*keys, "_blk").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, -1))
    local = src.select("*", *[fns[k](f"_in_{n}").over(w).alias(f"_loc_{n}")
                              for n, (k, _) in specs.items()])
    totals = src.groupBy(*keys, "_blk").agg(
        *[fns[k](f"_in_{n}").alias(f"_tot_{n}") for n, (k, _) in specs.items()])
    if levels > 1:
        up = {f"_car_{n}": (k, f"_tot_{n}") for n, (k, _) in specs.items()}
        carried = prefix(totals.withColumnRenamed("_blk", "_up"), keys, "_up", up,
                         width=1 << 12, levels=levels - 1, ranked=True).withColumnRenamed("_up", "_blk")
    else:
        wt = (Window.partitionBy(*keys).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
        carried = totals.select("*", *[fns[k](f"_tot_{n}").over(wt).alias(f"_car_{n}")
                                       for n, (k, _) in specs.items()])
    carried = carried.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_cblk"),
        *[f"_car_{n}" for n in specs])
    on = F.col("_blk") == F.col("_cblk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = []
    for n, (kind, _) in specs.items():
        loc, car = F.col(f"_loc_{n}"), F.col(f"_car_{n}")
        if kind == "sum":
            out.append((F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))).alias(n))
        else:
            pick = F.greatest if kind == "max" else F.least
            out.append(pick(loc, car).alias(n))
    return local.join(carried, on).select(*[F.col(c) for c in df.columns], *out)


def row_index(df: DataFrame, keys: list[str], order: str, name: str = "rn",
              total: str | None = None, **kw) -> DataFrame:
    """Zero-based position of each row within ``keys`` by the unique integer ``order``."""
    out = prefix(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, **kw)
    if total is None:
        return out
    n = df.groupBy(*keys).agg(F.count("*").alias(total))
    return out.join(n, keys) if keys else out.crossJoin(F.broadcast(n))  # one row


def with_previous(df: DataFrame, keys: list[str], pos: str, cols: list[str],
                  width: int = WIDTH) -> DataFrame:
    """Add ``prev_<col>`` from the row at ``pos - 1`` of the same key; ``pos`` counts 0, 1, 2, ...

    The last row of each block is repeated at the head of the next block, so one shuffle does it
    and no task sees more than ``width + 1`` rows of a key.
    """
    blk = F.floor(F.col(pos) / F.lit(width)).cast("long")
    seam = (F.col(pos) % F.lit(width)) == F.lit(width - 1)
    rows = df.select("*", F.explode(
        F.when(seam, F.array(blk, blk + 1)).otherwise(F.array(blk))).alias("_blk"))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    return (rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols],
                        (F.col("_blk") == blk).alias("_own"))
            .filter("_own").drop("_own", "_blk"))


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
            rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. Spark limits each map partition before the shuffle, so a hot key
    sends at most ``k`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rank_index(df: DataFrame, value: str, order: str, name: str = "rn") -> DataFrame:
    """Zero-based global rank by (``value``, ``order``), both integers, ``order`` unique.

    Distinct values are counted and scanned first, then rows are placed within their value, so
    neither a common value nor the table as a whole is sorted in one task.
    """
    levels = df.groupBy(value).agg(F.count("*").alias("_n"))
    before = prefix(levels, [], value, {"_before": ("sum", "_n")}).select(value, "_before")
    inside = row_index(df, [value], order, "_in")
    return inside.join(before, value).withColumn(
        name, F.col("_before") + F.col("_in")).select(*df.columns, name)


def range_rank(df: DataFrame, order: list[Column], name: str = "rn", parts: int | None = None) -> DataFrame:
    """Zero-based global rank of each row by ``order``, whatever its values.

    Rows are cut into ranges by sampling, stored, and numbered within their range; the counts of the
    ranges before come from one number per range. Equal rows take neighbouring ranks in no fixed
    order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in cut.groupBy("_range").count().collect()}  # one row per range
    before, total = [], 0
    for i in range(parts):
        before.append(total)
        total += counts.get(i, 0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    offset = F.get(F.array(*map(F.lit, before)), F.col("_range")).cast("long")
    return cut.withColumn(name, offset + inside - 1).drop("_range")
