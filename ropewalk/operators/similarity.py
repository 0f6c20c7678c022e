"""Exact cosine joins without a cross join of rows.

Vectors are packed into tiles of bounded size, one stored row per tile. Pairs of tiles are formed by a cross product that reads
the stored tiles: a tile is never shuffled or written once per partner, so what is written grows with the vectors, not with the pairs.
A task multiplies two tiles with numpy, in single precision first; what can reach the threshold is computed again in double
precision. It emits only what is asked for: pairs over a threshold, the best k per row, or the first few partners of a row, cut over
all tiles that a task sees. Copies of the same vector are folded before this step by the callers.

Where a threshold is given, tiles hold vectors that lie close together, and pairs of tiles that cannot reach it are never
formed: the angle between two vectors is at least the difference of their angles to any third one, so a pair of tiles is
left out when, for one of a few pivots, the ranges of their angles lie further apart than the threshold's angle. The
number of copies of a vector is the number of tiles its own tile still has to meet, which depends on how the data clusters. The pivots
come from a bounded sample of ``SAMPLE`` rows; they decide speed, never results.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable, few_rows_at_once, scratch_path
from .ordered import range_rank

TILE = 2048
PLAIN = 256     # pairs of tiles up to which all are formed: ordering the vectors would cost more
MANY = 1 << 24  # pairs of rows from which on tasks are made for pairs of files
SAMPLE = 256    # rows the pivots are chosen from
PIVOTS = 8
STRIP = 256     # rows of a tile whose whole product is held in double precision
PARTS = 8       # column ranges per asked neighbour, whose largest values bound the k-th best from below
GROUP = 64      # tiles of a group; groups are compared before tiles
SLACK = 1e-4    # radians; sums of rounded products and sims rounded to six places stay inside


def _tiles(df: DataFrame, tile: int, in_order: bool) -> DataFrame:
    """``df`` with ``_tile``: consecutive by ``ord``, so that later tiles need not be met, or by hash."""
    if in_order:
        return range_rank(df, [F.col("ord"), F.col("id")], "_at").withColumn(
            "_tile", F.floor(F.col("_at") / tile).cast("int")).drop("_at")
    parts = max(1, -(-df.count() // tile))
    return df.withColumn("_tile", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def _pivots(vectors: DataFrame, dim: int) -> np.ndarray:
    """A few rows of a bounded sample, each far from those before it."""
    rows = _matrix(vectors.orderBy(F.xxhash64("id"), "ord").limit(SAMPLE).toPandas(), dim)  # at most SAMPLE rows
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(PIVOTS, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def _close_tiles(vectors: DataFrame, pivots: np.ndarray, cuts: np.ndarray, dim: int, tile: int) -> DataFrame:
    """``vectors`` with ``_tile`` and ``_angles``: rows are ordered by which side of each cut their angles to the pivots are
    on, then by the angle to the first pivot, and every ``tile`` consecutive ones are a tile."""
    bits = 1 << np.arange(len(pivots))[::-1]

    def measure(frames):
        for pdf in frames:
            cos = np.clip(_matrix(pdf, dim) @ pivots.T, -1, 1)
            angles = np.arccos(cos)
            yield pdf.assign(_angles=list(angles), _cell=((angles > cuts) * bits).sum(axis=1).astype(np.int64),
                             _a0=angles[:, 0])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.mapInPandas(measure, f"{schema}, _angles array<double>, _cell long, _a0 double")
    ranked = range_rank(placed, [F.col("_cell"), F.col("_a0"), F.col("ord")], "_at")
    return ranked.withColumn("_tile", F.floor(F.col("_at") / tile).cast("int")).drop("_at", "_cell", "_a0")


def _ranges(tiles: DataFrame, pivots: int, by: str = "_tile") -> DataFrame:
    """Per tile the range of angles to each pivot and of ``ord``."""
    angle = [F.get("_angles", F.lit(i)) for i in range(pivots)]
    return tiles.groupBy(by).agg(
        F.array(*[F.min(a) for a in angle]).alias("lo"), F.array(*[F.max(a) for a in angle]).alias("hi"),
        F.min("ord").alias("first"), F.max("ord").alias("last"))


def tile_pairs(left: DataFrame, right: DataFrame, pivots: int, threshold: float, earlier_only: bool) -> DataFrame:
    """(_lt, _rt): pairs of tiles that may hold a pair over the threshold. Groups of tiles are compared first."""
    reach = math.acos(min(max(threshold, -1.0), 1.0)) + SLACK

    def named(df: DataFrame, by: str, side: str) -> DataFrame:
        return df.select(F.col(by).alias(f"_{side}{by}"), *[F.col(c).alias(f"{side}_{c}") for c in ("lo", "hi", "first", "last")])

    def near():
        apart = F.exists(F.sequence(F.lit(0), F.lit(pivots - 1)), lambda i: (
            F.get("r_lo", i) - F.get("l_hi", i) > reach) | (F.get("l_lo", i) - F.get("r_hi", i) > reach))
        return ~apart & (F.col("r_first") < F.col("l_last")) if earlier_only else ~apart

    def grouped(df: DataFrame) -> DataFrame:
        ends = [F.array(*[fn(F.get(c, F.lit(i))) for i in range(pivots)]).alias(c) for fn, c in ((F.min, "lo"), (F.max, "hi"))]
        return df.withColumn("_group", F.floor(F.col("_tile") / GROUP).cast("int")).groupBy("_group").agg(
            *ends, F.min("first").alias("first"), F.max("last").alias("last"))

    l, r = durable(_ranges(left, pivots)), durable(_ranges(right, pivots))
    # one row per GROUP * TILE vectors on each side
    groups = named(grouped(l), "_group", "l").join(named(grouped(r), "_group", "r"), near()).select("_l_group", "_r_group")
    l = named(l, "_tile", "l").withColumn("_l_group", F.floor(F.col("_l_tile") / GROUP).cast("int"))
    r = named(r, "_tile", "r").withColumn("_r_group", F.floor(F.col("_r_tile") / GROUP).cast("int"))
    return groups.join(l, "_l_group").join(r, "_r_group").filter(near()).select(
        F.col("_l_tile").alias("_lt"), F.col("_r_tile").alias("_rt"))


def _dense(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    out = np.zeros((len(pdf), dim))
    if "buckets" in pdf.columns:
        for row, (idx, tf) in enumerate(zip(pdf["buckets"], pdf["tf"])):
            if idx is not None and len(idx):
                out[row, np.asarray(idx, dtype=np.int64)] = np.asarray(tf, dtype=np.float64)
    else:
        for row, v in enumerate(pdf["vec"]):
            if v is not None:
                out[row, :len(v)] = np.asarray(v, dtype=np.float64)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return _unit(_dense(pdf, dim)) if "buckets" in pdf.columns else _dense(pdf, dim)


def _packed(df: DataFrame, dim: int, side: str) -> DataFrame:
    """One stored row per tile: ``<side>_tile``, its ids and ords in ord order, the range of ords, and the vectors as bytes."""
    counts = "buckets" in df.columns
    single = not counts and df.schema["vec"].dataType.simpleString() == "array<float>"
    kind = df.schema["id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        m = _dense(pdf, dim)
        if counts:  # whole numbers, in as few bytes as hold them
            m = m.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not m.size or m.max() <= np.iinfo(t).max))
        elif single:  # what is given in single precision is stored in it, half as large
            m = m.astype(np.float32)
        ords = pdf["ord"].to_numpy(np.int64)
        return pd.DataFrame({"_tile": [int(pdf["_tile"].iloc[0])], "ids": [pdf["id"].tolist()], "ords": [ords.tobytes()],
                             "first": [int(ords[0])], "last": [int(ords[-1])], "kind": [m.dtype.str], "data": [m.tobytes()]})

    schema = f"_tile int, ids array<{kind}>, ords binary, first long, last long, kind string, data binary"
    # one file for a few tiles, so that reading them is spread over the cores whatever their size
    cores = df.sparkSession.sparkContext.defaultParallelism
    tiles = df.groupBy("_tile").applyInPandas(pack, schema).repartition(2 * cores, "_tile").sortWithinPartitions("_tile")
    path = scratch_path(df.sparkSession, "tiles")
    tiles.write.option("compression", "none").parquet(path)  # the size of a split is its size in memory
    stored = df.sparkSession.read.schema(tiles.schema).parquet(path)
    return stored.select(*[F.col(c).alias(f"{side}{c}") for c in stored.columns])


class _Side:
    """One tile in a task: ids, ords, vectors in double and single precision."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, dim: int, unit: bool):
        def value(name):
            return batch.column(f"{side}{name}")[row]
        self.tile = value("_tile").as_py()
        ids = value("ids").values
        self.ids = ids.take(pa.array(np.arange(len(ids)), pa.int64()))  # a copy: a slice would hold the whole batch
        self.ords = np.frombuffer(value("ords").as_buffer(), np.int64).copy()
        m = np.frombuffer(value("data").as_buffer(), np.dtype(value("kind").as_py())).reshape(-1, dim).astype(np.float64)
        self.full = _unit(m) if unit else m
        with np.errstate(over="ignore"):
            self.half = self.full.astype(np.float32)
        self.length = float(np.sqrt(np.einsum("ij,ij->i", self.full, self.full).max(initial=0.0)))
        self.found = None  # rows (i, ord, id, sim) kept so far, where a number per row is asked for
        self.least = None  # per row the similarity that a further one must reach
        self.last = None  # per row the ord that a further one must stay below


def _same(x: _Side, y: _Side) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of equal ords; both sides are in ord order."""
    lo, hi = np.searchsorted(y.ords, x.ords, "left"), np.searchsorted(y.ords, x.ords, "right")
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def _single(x: _Side, y: _Side, room: dict[int, np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """All products of two tiles (of some rows of the first) in single precision, in memory that the pairs of tiles of a task share."""
    left = x.half if rows is None or len(rows) == len(x.half) else x.half[rows]
    size = len(left) * len(y.half)
    if 0 not in room or len(room[0]) < size:
        room[0] = np.empty(size, np.float32)
    return np.matmul(left, y.half.T, out=room[0][:size].reshape(len(left), len(y.half)))


def _kth_bound(sims: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that the k-th largest reaches: the k-th largest of the largest values of column ranges."""
    parts = PARTS * k
    width = sims.shape[1] // parts
    tops = sims[:, :width * parts].reshape(len(sims), parts, width).max(axis=2)
    return np.partition(tops, parts - k, axis=1)[:, parts - k].astype(np.float64)


def _products(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    step = 1 << 15
    for at in range(0, len(i), step):
        cut = slice(at, at + step)
        out[cut] = np.einsum("ij,ij->i", a.full[i[cut]], b.full[j[cut]])
    return out


def similar(left: DataFrame, right: DataFrame, dim: int, threshold: float | None = None,
            k: int | None = None, earlier_only: bool = False, same_table: bool = False,
            tile: int | None = None, first: int | None = None) -> DataFrame:
    """Rows (left_id, right_id, right_ord, sim) with sim rounded to six places.

    Both inputs have ``id``, ``ord`` (long) and either ``vec`` or ``buckets`` + ``tf``.
    ``threshold`` keeps sim >= threshold. ``k`` keeps, per left row and task that meets it, the k best by
    (sim desc, right_ord asc), so the caller's final top-k sees k rows per task, not all pairs.
    ``first`` keeps, per left row and task, the first so many by right_ord instead.
    ``earlier_only`` keeps right_ord < left_ord. With ``same_table`` both sides are cuts of one table and a row does
    not meet itself (same ord); between different tables equal ords mean nothing.
    """
    payload = ["buckets", "tf"] if "buckets" in left.columns else ["vec"]
    cols = ["id", "ord", *payload]
    # toDF gives fresh column identities: the two sides are often cuts of one table
    left, right = durable(left.select(*cols).toDF(*cols)), durable(right.select(*cols).toDF(*cols))
    tile = tile or TILE
    ln, rn = (-(-df.count() // tile) for df in (left, right))
    pairs = None
    if threshold is not None and threshold > 0:
        # a side of one tile reads the other side once anyway
        pivots = _pivots(right, dim) if ln * rn > PLAIN and min(ln, rn) > 1 else np.zeros((0, dim))
        pivots = pivots[np.abs(pivots).sum(axis=1) > 0]
        if len(pivots):
            sample = _matrix(left.orderBy(F.xxhash64("id"), "ord").limit(SAMPLE).toPandas(), dim)  # at most SAMPLE rows
            cuts = np.median(np.arccos(np.clip(sample @ pivots.T, -1, 1)), axis=0) if len(sample) else np.zeros(len(pivots))
            lt, rt = (_close_tiles(df, pivots, cuts, dim, tile) for df in (left, right))
            lt, rt = durable(lt), durable(rt)
            pairs = durable(tile_pairs(lt, rt, len(pivots), threshold, earlier_only))
            if earlier_only and pairs.count() * 2 > ln * rn:
                pairs = None  # the order of the rows spares more
    if pairs is None:
        in_order = earlier_only and min(ln, rn) > 1
        lt, rt = _tiles(left, tile, in_order), _tiles(right, tile, in_order)
    a, b = _packed(lt.drop("_angles"), dim, "l"), _packed(rt.drop("_angles"), dim, "r")
    meets = F.lit(True)
    if earlier_only:
        meets = F.col("rfirst") < F.col("llast")
    if pairs is not None:
        partners = pairs.groupBy(F.col("_lt").alias("l_tile")).agg(F.collect_set("_rt").alias("_partners"))  # a number per tile
        a = a.join(partners, "l_tile")
        meets = meets & F.array_contains("_partners", F.col("r_tile"))
    if ln * rn * tile * tile > MANY:
        # a task per pair of files: with a broadcast side the tasks would be as few as the files of the other one
        b = b.hint("shuffle_replicate_nl")
    both = a.join(b, meets).drop("_partners", "lfirst", "llast", "rfirst", "rlast")
    id_type = left.schema["id"].dataType.simpleString()
    rid_type = right.schema["id"].dataType.simpleString()
    unit = "buckets" in payload
    most = k if k is not None else first

    def candidates(x: _Side, y: _Side, room: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, sim) of the pairs of two tiles that may be asked for."""
        # error of a sum of dim rounded products, and the rounding to six places
        slack = (dim + 8) * 1.2e-7 * x.length * y.length + 1e-6
        bounded = np.isfinite(slack) and slack <= 1e30
        if bounded and first is not None and threshold is not None:
            return firsts(x, y, room, slack)
        off = None
        if earlier_only and y.ords[-1] >= x.ords[0]:
            off = y.ords[None, :] >= x.ords[:, None]
        elif same_table and not earlier_only:
            off = _same(x, y)
        if not bounded:
            near = np.ones((len(x.ords), len(y.ords)), bool)
            if off is not None:
                near[off] = False
        else:
            sims = _single(x, y, room)
            if off is not None:
                sims[off] = -np.inf
            least = np.full(len(x.ords), -np.inf) if threshold is None else np.full(len(x.ords), threshold - slack)
            if k is not None:
                if x.least is not None:
                    least = np.maximum(least, x.least - slack)
                elif sims.shape[1] >= PARTS * k:
                    least = np.maximum(least, _kth_bound(sims, k) - 2 * slack)
            near = sims >= least[:, None].astype(np.float32)
            if least.min(initial=0.0) == -np.inf:
                near &= sims > -np.inf
        many = np.count_nonzero(near)
        if many > near.size // 16:
            parts = [strip(x, y, near, at) for at in range(0, len(near), STRIP)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        i, j = np.divmod(np.flatnonzero(near.ravel()), near.shape[1])
        sim = np.round(_products(x, y, i, j), 6)
        if threshold is not None:
            over = sim >= threshold
            i, j, sim = i[over], j[over], sim[over]
        return i, j, sim + 0.0

    def firsts(x: _Side, y: _Side, room: dict[int, np.ndarray], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``candidates`` of the rows that may still take one, and of each row only the first. What lies clearly over the threshold
        is not computed again to be counted."""
        may = np.ones(len(x.ords), bool) if x.last is None else x.last > y.ords[0]
        if earlier_only:
            may &= x.ords > y.ords[0]
        rows = np.flatnonzero(may)
        sims = _single(x, y, room, rows)
        near = sims >= np.float32(threshold - slack)
        if earlier_only and len(rows) and y.ords[-1] >= x.ords[rows[0]]:
            near &= y.ords[None, :] < x.ords[rows, None]
        i, j = np.divmod(np.flatnonzero(near.ravel()), max(1, len(y.ords)))
        if same_table and not earlier_only:
            other = x.ords[rows[i]] != y.ords[j]
            i, j = i[other], j[other]
        unsure = np.flatnonzero(sims[i, j] < threshold + slack)
        i, under = rows[i], np.zeros(len(i), bool)
        under[unsure] = ~(np.round(_products(x, y, i[unsure], j[unsure]), 6) >= threshold)
        i, j = i[~under], j[~under]
        starts = np.searchsorted(i, np.arange(len(x.ords) + 1))
        chosen = np.arange(len(i)) - starts[i] < first  # columns are in ord order
        i, j = i[chosen], j[chosen]
        return i, j, np.round(_products(x, y, i, j), 6) + 0.0

    def strip(x: _Side, y: _Side, near: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``candidates`` of a few rows with many partners, from the whole product."""
        exact = np.round(x.full[at:at + STRIP] @ y.full.T, 6)
        near = near[at:at + STRIP]
        if threshold is not None:
            near = near & (exact >= threshold)
        if k is not None and exact.shape[1] > k:
            # stable sort over columns in ord order: ties keep the smaller ord
            ranked = np.argsort(np.where(near, -exact, np.inf), axis=1, kind="stable")[:, :k]
            chosen = np.zeros_like(near)
            np.put_along_axis(chosen, ranked, True, axis=1)
            near = near & chosen
        if first is not None:
            near = near & (np.cumsum(near, axis=1) <= first)  # columns are in ord order
        i, j = np.nonzero(near)
        return i + at, j, exact[i, j] + 0.0

    def keep(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> None:
        """Add to what the rows of x have found and cut it to what is asked for."""
        ords, ids = y.ords[j], y.ids.take(pa.array(j, pa.int64()))
        if x.found is not None:
            i, ords = np.concatenate([x.found[0], i]), np.concatenate([x.found[1], ords])
            ids, sim = pa.concat_arrays([x.found[2], ids]), np.concatenate([x.found[3], sim])
        by = np.lexsort((ords, -sim, i) if k is not None else (ords, i))
        i = i[by]
        starts = np.searchsorted(i, np.arange(len(x.ords) + 1))
        place = np.arange(len(i)) - starts[i]
        by, i = by[place < most], i[place < most]
        x.found = i, ords[by], ids.take(pa.array(by, pa.int64())), sim[by]
        last = place[place < most] == most - 1
        if k is not None:
            x.least = np.full(len(x.ords), -np.inf)
            x.least[i[last]] = np.nan_to_num(x.found[3][last], nan=-np.inf)
        else:
            x.last = np.full(len(x.ords), np.iinfo(np.int64).max)
            x.last[i[last]] = x.found[1][last]

    def out(x: _Side, i: np.ndarray, ords: np.ndarray, ids: pa.Array, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [x.ids.take(pa.array(i[cut], pa.int64())), ids[cut], pa.array(ords[cut], pa.int64()), pa.array(sim[cut])],
                ["left_id", "right_id", "right_ord", "sim"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, room = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if x is None or x.tile != batch.column("l_tile")[row].as_py():
                    if x is not None and x.found is not None:
                        yield from out(x, *x.found)
                    x = _Side(batch, row, "l", dim, unit)
                y = _Side(batch, row, "r", dim, unit)
                i, j, sim = candidates(x, y, room)
                if not len(i):
                    continue
                if most is not None:
                    keep(x, y, i, j, sim)
                else:
                    yield from out(x, i, y.ords[j], y.ids.take(pa.array(j, pa.int64())), sim)
            del batch  # before the next one is read
        if x is not None and x.found is not None:
            yield from out(x, *x.found)

    found = both.mapInArrow(meet, f"left_id {id_type}, right_id {rid_type}, right_ord bigint, sim double")
    with few_rows_at_once(left.sparkSession, 8):  # a row is two tiles
        return durable(found)
