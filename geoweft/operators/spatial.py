"""Joins of nodes with nodes: all pairs, nearest neighbours by grid, and kernel sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweft.functions.decay import distance
from geoweft.operators.interpolated import interpolated_sums, tree_of
from geoweft.operators.shared import saved

#: Nodes that may be broadcast: with their coordinates about 24 bytes each.
BROADCAST_NODES = 200_000


def parallel(spark_df: DataFrame) -> DataFrame:
    """A small table over all cores: one input file is one task otherwise."""
    return spark_df.repartition(max(2, spark_df.sparkSession.sparkContext.defaultParallelism * 2))


def all_pairs(left: DataFrame, right: DataFrame, n: int, on: Column) -> DataFrame:
    """Rows of left with all rows of right that meet the condition; the right side is broadcast if ``n`` nodes may be."""
    right = F.broadcast(right) if n <= BROADCAST_NODES else right
    return parallel(left).join(right, on)


def knn_join(points: DataFrame, k: Column | int, allowed: Column | None = None, need: list[str] | tuple = (), by: list[str] | tuple = (), among: Column | None = None) -> DataFrame:
    """(node_pos, nbr, d, rank): the k nearest other points of each point of (node_pos, x, y), ties by node_pos.

    Points meet in grid cells. A point is done when its k-th distance is no more
    than the way to the rim of the cells searched, or when these hold all
    points; others search twice as far. Points of crowded cells search a finer
    grid, and of many points at one place only the first are looked at, as no
    more of them can be neighbours. ``k`` may be a column of ``points``; points
    with 0 don't search.

    ``allowed`` is a condition on columns u_<name> of a point and v_<name> of its
    neighbour, where ``need`` names the columns a_<name> of ``points``; only those that meet it count. If that takes equal values of some of
    them, which ``by`` names, each class of points has a grid of its own. ``among`` is a condition on ``points`` that neighbours must meet.
    """
    to = F.lit(True) if among is None else among
    p = points.withColumns({"k": k if isinstance(k, Column) else F.lit(k), "to": to}).select("node_pos", "x", "y", F.col("k").cast("long").alias("k"), "to", *(f"a_{c}" for c in need))
    stats = p.agg(F.count_if("to"), F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.avg(F.when(F.col("k") > 0, F.col("k"))), F.max("k")).first()
    n, x0, y0, x1, y1, mean_k, max_k = stats
    if among is not None:  # all of them may be another point's
        n += 1
    if not n or n < 2 or not max_k or max_k <= 0:
        return points.sparkSession.createDataFrame([], "node_pos long, nbr long, d double, rank long")
    own = [f"b_{c}" for c in by]
    p = p.withColumns({f"b_{c}": F.col(f"a_{c}") for c in by}).withColumnsRenamed({f"a_{c}": f"u_{c}" for c in need}).withColumn("most", F.lit(n - 1).cast("long"))
    parts = 1
    if by:
        sizes = p.groupBy(*own).agg((F.count_if("to") - (1 if among is None else 0)).alias("most")).persist()
        parts = max(1, sizes.count())
        p = p.drop("most").join(sizes, own)
    w, h = x1 - x0, y1 - y0
    want = max(1.0, mean_k) * min(parts, n)
    if w > 0 and h > 0:
        size = math.sqrt(w * h * want / n)
    else:
        size = max(w, h) * want / n or 1.0
    size = max(size, max(w, h) / 1e6)
    target, p = p.where("to"), p.drop("to")
    target = target.select(F.col("node_pos").alias("nbr"), F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(f"u_{c}").alias(f"v_{c}") for c in need), *own)
    todo, out, crowd = p.where("k > 0 and most > 0"), None, CROWD * (max(1.0, mean_k) + 1)
    at = Search(n, max_k, own, allowed, list(need))
    for _ in range(FINER):
        grid = Grid(size, x0, y0, math.floor(w / size) + 1, math.floor(h / size) + 1)
        cell = ["cx", "cy", *own]
        counts = grid.cells(target, "nx", "ny").groupBy(*cell).agg(F.count("*").alias("m")).where(F.col("m") > crowd).select(*cell)
        if counts.isEmpty() or size <= max(w, h) * 1e-9:
            break
        if out is None and allowed is None:  # of points at one place, the first ones
            place = W.partitionBy("nx", "ny", *own).orderBy("nbr")
            target = target.withColumn("r", F.row_number().over(place)).where(F.col("r") <= max_k + 1).drop("r").persist()
        todo = grid.cells(todo, "x", "y")
        thin = saved(todo.join(counts, cell, "left_anti").drop("cx", "cy"))
        todo = saved(todo.join(counts, cell, "left_semi").drop("cx", "cy"))
        if not thin.isEmpty():
            found = at.nearest(thin, target, grid)
            out = found if out is None else out.union(found)
        elif out is None:
            out = at.nearest(thin, target, grid)
        if todo.isEmpty():
            return out
        size /= 4
    found = at.nearest(todo, target, Grid(size, x0, y0, math.floor(w / size) + 1, math.floor(h / size) + 1))
    return found if out is None else out.union(found)


#: Times the expected number of points that a cell holds before a finer grid takes its points; quarterings of a cell's side.
CROWD, FINER = 16, 16


@dataclass(frozen=True)
class Grid:
    size: float
    x0: float
    y0: float
    columns: int
    rows: int

    def cells(self, df: DataFrame, x: str, y: str) -> DataFrame:
        at = lambda c, o: F.floor((F.col(c) - o) / self.size).cast("long")
        return df.withColumns({"cx": at(x, self.x0), "cy": at(y, self.y0)})


@dataclass(frozen=True)
class Search:
    """What all grids of a search have in common: points, the largest k, the columns of the classes, and the condition with its columns."""

    n: int
    max_k: int
    by: list[str]
    allowed: Column | None
    need: list[str]

    def nearest(self, todo: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
        """The nearest of ``points`` (nbr, nx, ny) to each row of ``todo`` (node_pos, x, y, k, most) by the cells of a grid, further and further out."""
        if self.allowed is None and not self.by:
            return self.by_tiles(todo, points, grid)
        cell, x0, y0, columns, rows = grid.size, grid.x0, grid.y0, grid.columns, grid.rows
        target, todo, ring, out = grid.cells(points, "nx", "ny"), grid.cells(todo, "x", "y"), 1, None
        while True:
            whole = ring >= max(columns, rows)
            if whole:
                left, right = todo.drop("cx", "cy"), target.drop("cx", "cy")
                pairs = left.join(right, self.by).where("node_pos <> nbr") if self.by else all_pairs(left, right, self.n, F.col("node_pos") != F.col("nbr"))
            else:
                span = lambda c, top: F.sequence(F.greatest(F.col(c) - ring, F.lit(0)), F.least(F.col(c) + ring, F.lit(top - 1).cast("long")))  # noqa: B023, E731
                spread = todo.withColumn("gx", F.explode(span("cx", columns))).withColumn("gy", F.explode(span("cy", rows)))
                spread = spread.drop("cx", "cy").withColumnsRenamed({"gx": "cx", "gy": "cy"})
                pairs = spread.join(target, ["cx", "cy", *self.by]).where("node_pos <> nbr")
            if self.allowed is not None:
                pairs = pairs.where(self.allowed)
            pairs = pairs.withColumn("d", distance("x", "y", "nx", "ny"))
            near = W.partitionBy("node_pos").orderBy("d", "nbr")
            best = pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= F.least(F.col("k"), F.lit(self.max_k)))
            best = best.select("node_pos", "nbr", "d", F.col("rank").cast("long").alias("rank"))
            if whole:
                return best if out is None else out.union(best)
            best = best.persist()
            # the way from a point to the rim of its cells; where the rim is beyond the bounds there is nothing more
            left = F.when(F.col("cx") - ring <= 0, F.lit(float("inf"))).otherwise(F.col("x") - x0 - (F.col("cx") - ring) * cell)
            right = F.when(F.col("cx") + ring >= columns - 1, F.lit(float("inf"))).otherwise((F.col("cx") + ring + 1) * cell + x0 - F.col("x"))
            down = F.when(F.col("cy") - ring <= 0, F.lit(float("inf"))).otherwise(F.col("y") - y0 - (F.col("cy") - ring) * cell)
            up = F.when(F.col("cy") + ring >= rows - 1, F.lit(float("inf"))).otherwise((F.col("cy") + ring + 1) * cell + y0 - F.col("y"))
            safe = F.least(left, right, down, up) * (1 - 1e-12)
            last = best.groupBy("node_pos").agg(F.max("rank").alias("got"), F.max("d").alias("far"))
            state = todo.join(last, "node_pos", "left")
            got = F.coalesce("got", F.lit(0))
            done = ((got >= F.least("k", "most")) & (F.col("far") < safe)) | (got >= F.col("most")) | (safe == F.lit(float("inf")))
            rest = state.where(~F.coalesce(done, F.lit(False))).drop("got", "far").persist()
            if rest.isEmpty():
                return best if out is None else out.union(best)
            settled = best.join(rest.select("node_pos"), "node_pos", "left_anti")
            out = settled if out is None else out.union(settled)
            todo, ring = rest, ring * 2


    def by_tiles(self, todo: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
        """The same without a condition: a task holds the points of a square of cells and of those about it; only neighbours leave it."""
        target, todo, ring, out = grid.cells(points, "nx", "ny"), grid.cells(todo, "x", "y"), 1, None
        cores = todo.sparkSession.sparkContext.defaultParallelism
        while ring < max(grid.columns, grid.rows):
            side = TILE_CELLS * ring
            tile = lambda c: F.floor(F.col(c) / side).cast("long")  # noqa: B023, E731
            own = todo.select(tile("cx").alias("tx"), tile("cy").alias("ty"), F.lit(False).alias("other"), F.col("node_pos").alias("id"), "x", "y", F.least("k", "most").alias("k"))
            span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - ring) / side).cast("long"), F.floor((F.col(c) + ring) / side).cast("long")))  # noqa: B023, E731
            other = target.withColumn("tx", span("cx")).withColumn("ty", span("cy"))
            if ring > 1:  # few points search on
                other = other.join(own.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
            other = other.select("tx", "ty", F.lit(True).alias("other"), F.col("nbr").alias("id"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.lit(0).cast("long").alias("k"))
            rows = own.union(other).repartition(max(2 * cores, self.n // TASK_NODES), "tx", "ty").sortWithinPartitions("tx", "ty", "other")
            # tables, not persisted frames: a round's plan would hold that of the one before twice
            found = saved(rows.mapInArrow(_nearest(grid, ring, self.n - 1), "node_pos long, nbr long, d double, rank long"))
            best, rest = found.where("rank > 0"), found.where("rank = 0").select("node_pos")
            out = best if out is None else out.union(best)
            if rest.isEmpty():
                return out
            todo, ring = saved(todo.join(rest, "node_pos", "left_semi")), ring * 2
        pairs = all_pairs(todo.drop("cx", "cy"), target.drop("cx", "cy"), self.n, F.col("node_pos") != F.col("nbr")).withColumn("d", distance("x", "y", "nx", "ny"))
        best = pairs.withColumn("rank", F.row_number().over(W.partitionBy("node_pos").orderBy("d", "nbr"))).where(F.col("rank") <= F.col("k"))
        best = best.select("node_pos", "nbr", "d", F.col("rank").cast("long").alias("rank"))
        return best if out is None else out.union(best)


#: Cells that a square of cells is wide, for each ring that is searched about a cell; points that a task searches for; pairs that it looks at in one go.
TILE_CELLS, TASK_NODES, TILE_PAIRS = 8, 20_000, 1 << 18


def _nearest(grid: Grid, ring: int, most: int) -> Callable:
    """The nearest points to those of each tile; a point whose nearest may lie outside the cells about its own gives one row of rank 0.

    Rows (tx, ty, other, id, x, y, k) are sorted: a tile's own points, then all that may be near.
    """

    def safe(x: np.ndarray, o: float, cells: int) -> np.ndarray:
        """The way to the rim of the cells about each point's own; there is nothing beyond the bounds."""
        c = np.floor((x - o) / grid.size)
        low = np.where(c - ring <= 0, np.inf, x - o - (c - ring) * grid.size)
        return np.minimum(low, np.where(c + ring >= cells - 1, np.inf, (c + ring + 1) * grid.size + o - x))

    def search(own: list, met: list) -> Iterator[pa.RecordBatch]:
        ids, x, y, k = own
        nbr, u, v = met
        rim = np.minimum(safe(x, grid.x0, grid.columns), safe(y, grid.y0, grid.rows)) * (1 - 1e-12)
        step = max(1, TILE_PAIRS // len(nbr))
        for a in range(0, len(ids), step):
            part = slice(a, a + step)
            dx, dy = x[part, None] - u, y[part, None] - v
            d = np.sqrt(dx * dx + dy * dy)
            d[ids[part, None] == nbr] = np.inf
            top = int(min(k[part].max(), len(nbr)))
            far = np.partition(d, top - 1, axis=1)[:, top - 1]
            r, c = np.nonzero((d <= far[:, None]) & (d < np.inf))
            order = np.lexsort((nbr[c], d[r, c], r))
            r, c = r[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            keep = rank <= k[part][r]
            r, c, rank = r[keep], c[keep], rank[keep]
            got, last = np.bincount(r, minlength=len(d)), np.zeros(len(d))
            np.maximum.at(last, r, d[r, c])
            done = ((got >= k[part]) & (last < rim[part])) | (got >= most) | np.isinf(rim[part])
            r, c, rank = (z[done[r]] for z in (r, c, rank))
            open_ = ids[part][~done]
            zero = np.zeros(len(open_), np.int64)
            columns = np.concatenate((ids[part][r], open_)), np.concatenate((nbr[c], zero)), np.concatenate((d[r, c], zero.astype(float))), np.concatenate((rank, zero))
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in columns], ["node_pos", "nbr", "d", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, met = None, [], []
        joined = lambda parts: [np.concatenate(z) for z in zip(*parts)]
        for batch in batches:
            tx, ty, other, ids, x, y, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = np.stack((tx, ty, other))
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(x)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (tx[a], ty[a]) != now:
                    if own:
                        yield from search(joined(own), joined(met))
                    now, own, met = (tx[a], ty[a]), [], []
                if other[a] and own:
                    met.append((ids[a:b], x[a:b], y[a:b]))
                elif not other[a]:
                    own.append((ids[a:b], x[a:b], y[a:b], k[a:b]))
        if own:
            yield from search(joined(own), joined(met))

    return run


def _within(t: np.ndarray, f: Callable) -> np.ndarray:
    near = t < 1
    np.minimum(t, 1.0, out=t)
    f(t)
    return np.multiply(t, near, out=t)


def _gaussian(t: np.ndarray) -> np.ndarray:
    t *= t
    t *= -0.5
    return np.exp(t, out=t)


# name -> (density of distances in bandwidths, written over them; the distance beyond which it is 0 or below a bound)
KERNELS = {
    "gaussian": (_gaussian, lambda least: math.sqrt(-2 * math.log(least))),
    "exponential": (lambda t: np.exp(np.negative(t, out=t), out=t), lambda least: -math.log(least)),
    "tophat": (lambda t: _within(t, lambda t: t.fill(1.0)), lambda least: 1.0),
    "epanechnikov": (lambda t: _within(t, lambda t: np.subtract(1.0, np.multiply(t, t, out=t), out=t)), lambda least: 1.0),
    "linear": (lambda t: _within(t, lambda t: np.subtract(1.0, t, out=t)), lambda least: 1.0),
    "cosine": (lambda t: _within(t, lambda t: np.cos(np.multiply(t, math.pi / 2, out=t), out=t)), lambda least: 1.0),
}
#: What all points together may add to a density by being left out: below what orders by density tell apart, as each density is 1 at least.
LEFT_OUT = 2.0**-46
#: Cells that the reach of a kernel is long.
REACH = 3
#: Places of a cell that a task sums up for at most and at least, those that it meets at a time, and pairs that it looks at in one go.
OWN, LEAST, MET, TILE = 16_384, 1_024, 4_096, 1 << 15
#: Tasks that all places are to make, if one cell holds them all.
TASKS = 64


def kernel_sums(points: DataFrame, bandwidth: float, kernel: str) -> DataFrame:
    """(node_pos, density): the unnormalised kernel density at each point, itself included.

    Points at one place count as one with their number. Places meet in grid cells as far as the kernel reaches; kernels without an end
    reach to where all points together would add no more than LEFT_OUT. A task holds places of one cell, which those of the cells about
    pass by; only sums leave it. Gaussian and exponential sums over many points go by interpolation, as exact as sums of doubles are.
    """
    if kernel not in KERNELS:
        raise ValueError(f"Unknown kernel: {kernel}. Use one of {', '.join(KERNELS)}.")
    if not bandwidth > 0:
        raise ValueError("bandwidth must be positive")
    value, end = KERNELS[kernel]
    n = max(1, points.count())
    reach = end(LEFT_OUT / n) * bandwidth
    size = reach / REACH * (1 + 1e-9)
    grid = lambda c: F.floor(F.col(c) / size).cast("long")
    places = points.groupBy("x", "y").agg(F.count("*").alias("m"))
    if (tree := tree_of(places, n, bandwidth, kernel)) is not None:
        sums = interpolated_sums(places, tree, float(bandwidth), kernel, reach, None if kernel == "gaussian" else _adding(value, float(bandwidth)))
        return points.select("node_pos", "x", "y").join(sums, ["x", "y"]).select("node_pos", "density")
    places = places.withColumns({"cx": grid("x"), "cy": grid("y")})
    # a cell of many places is dealt out to several tasks
    filled = places.groupBy("cx", "cy").agg(F.ceil(F.count("*") / min(OWN, max(LEAST, n // TASKS))).alias("parts"))
    own = places.join(filled, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")))
    around = lambda c: F.explode(F.sequence(F.col(c) - REACH, F.col(c) + REACH))
    near = places.select("cx", "cy").distinct().withColumn("ox", around("cx")).withColumn("oy", around("cy"))
    near = near.join(filled.withColumnsRenamed({"cx": "ox", "cy": "oy"}), ["ox", "oy"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = places.join(near, ["cx", "cy"])
    task = lambda x, y: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"), "part")
    rows = own.select(task("cx", "cy").alias("task"), F.lit(False).alias("passing"), "x", "y", "m").union(met.select(task("ox", "oy").alias("task"), F.lit(True).alias("passing"), "x", "y", "m"))
    cores = points.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(min(1024, max(4 * cores, n // 500)), "task").sortWithinPartitions("task", "passing").select("task.*", "passing", "x", "y", "m")
    sums = rows.mapInArrow(_summed(value, float(bandwidth)), "x double, y double, density double")
    return points.select("node_pos", "x", "y").join(sums, ["x", "y"]).select("node_pos", "density")


def _adding(value: Callable, bandwidth: float) -> Callable:
    def add(own: list | tuple, met: list, sums: np.ndarray) -> None:
        x, y = own
        u, v, m = (np.concatenate(c) for c in zip(*met))
        step = max(1, TILE // len(u))
        d, e = np.empty((2, min(step, len(x)), len(u)))
        for at in range(0, len(x), step):
            k = min(step, len(x) - at)
            dx, dy = np.subtract(x[at : at + k, None], u, out=d[:k]), np.subtract(y[at : at + k, None], v, out=e[:k])
            dx *= dx
            dy *= dy
            dx += dy
            np.sqrt(dx, out=dx)
            dx /= bandwidth
            sums[at : at + k] += value(dx) @ m

    return add


def _summed(value: Callable, bandwidth: float) -> Callable:
    """Sums the kernel at the places of each task over those that pass; rows are sorted by task, its own places first."""
    add = _adding(value, bandwidth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            if met:
                add(own, met, sums)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(sums)], ["x", "y", "density"])

        now, own, met, rows, sums = None, [], [], 0, None
        for batch in batches:
            cx, cy, part, passing, x, y, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = np.stack((cx, cy, part, passing))
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(x)]
            for a, b in zip(cuts, cuts[1:]):
                this = (cx[a], cy[a], part[a])
                if this != now:
                    yield from done()
                    now, own, met, rows, sums = this, [], [], 0, None
                if not passing[a]:
                    own = [np.concatenate((*own[k : k + 1], v[a:b])) for k, v in enumerate((x, y))]
                    continue
                if sums is None:
                    sums = np.zeros(len(own[0]))
                met.append((x[a:b], y[a:b], m[a:b].astype(float)))
                rows += b - a
                if rows >= MET:
                    add(own, met, sums)
                    met, rows = [], 0
        yield from done()

    return run
