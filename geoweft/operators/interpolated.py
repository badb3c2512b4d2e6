"""Kernel sums in time about linear in the points: what is far is summed by interpolation between cells of a quadtree.

A cell stands for its points by weights at Chebyshev nodes, such that sums of smooth kernels agree to double precision. The gaussian kernel is
smooth throughout, so cells of one bandwidth meet as far as it reaches, themselves included. The exponential one isn't where points are close:
leaves that touch are summed pair by pair, and other cells meet at the first level where they don't touch but their parents do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points from which on it is done so, points of a leaf on the mean, and the most that one may hold.
LEAST, LEAF, MOST = 30_000, 1000, 16_000
#: Nodes of a cell each way.
NODES = 20
#: Leaves of a block, which is summed in one go, and cells of a block that others of one level meet, each as a power of two.
BLOCK, MET = 2, 3

_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_SERIES = np.cos(np.arange(NODES)[:, None] * np.arccos(_AT)) * np.where(np.arange(NODES) == 0, 1.0, 2.0)[:, None] / NODES
CELLS = "level int, cx long, cy long, data binary"


def basis(t: np.ndarray) -> np.ndarray:
    """The polynomials that are 1 at one of the nodes and 0 at the others, at ``t`` from -1 to 1."""
    out = np.empty((len(t), NODES))
    out[:, 0], out[:, 1] = 1.0, t
    for k in range(2, NODES):
        out[:, k] = 2 * t * out[:, k - 1] - out[:, k - 2]
    return out @ _SERIES


@dataclass(frozen=True)
class Tree:
    """The square of the points and its finest level; ``top`` is the coarsest at which cells meet."""

    x0: float
    y0: float
    side: float
    depth: int
    top: int

    def cell(self, c: str, o: float) -> Column:
        return F.least(F.floor((F.col(c) - o) / (self.side / (1 << self.depth))).cast("long"), F.lit((1 << self.depth) - 1).cast("long"))

    def bases(self, x: np.ndarray, y: np.ndarray, cx: int, cy: int) -> tuple[np.ndarray, np.ndarray]:
        """The polynomials of a leaf at points in it."""
        half = self.side / (1 << self.depth) / 2
        return tuple(basis(np.clip((v - o) / half - (2 * c + 1), -1, 1)) for v, o, c in ((x, self.x0, cx), (y, self.y0, cy)))


def tree_of(places: DataFrame, n: int, bandwidth: float, kernel: str) -> Tree | None:
    """The quadtree for ``n`` points; None where sums over pairs are no more work, or points crowd."""
    if n < LEAST or kernel not in ("gaussian", "exponential"):
        return None
    x0, y0, x1, y1 = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    extent = max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0
    if kernel == "gaussian":
        depth = max(2, int(np.ceil(np.log2(extent / bandwidth))))
        tree = Tree(x0, y0, bandwidth * 2.0**depth, depth, depth)
        few = NODES**2 // 4  # no more than four of a cell's nodes for each point
        return tree if depth < 30 and places.select(tree.cell("x", x0), tree.cell("y", y0)).distinct().count() * few <= n else None
    depth = max(3, int(np.ceil(np.log2(n / LEAF) / 2)))
    tree = Tree(x0, y0, extent, depth, 2)
    most = places.groupBy(tree.cell("x", x0), tree.cell("y", y0)).count().agg(F.max("count")).first()[0]
    return tree if most <= MOST else None


def interpolated_sums(places: DataFrame, tree: Tree, bandwidth: float, kernel: str, reach: float, pairs: Callable | None) -> DataFrame:
    """(x, y, density) of places (x, y, m); ``pairs(own, met, sums)`` adds up what leaves that touch add to each other, where they don't go by nodes."""
    cores = places.sparkSession.sparkContext.defaultParallelism
    x = places.withColumns({"cx": tree.cell("x", tree.x0), "cy": tree.cell("y", tree.y0)})
    zigzag = sum((F.shiftleft(F.shiftright(F.col(c), k).bitwiseAND(1), 2 * k + o) for k in range(tree.depth) for c, o in (("cx", 1), ("cy", 0))), F.lit(0).cast("long"))
    rows = x.withColumn("z", zigzag).repartitionByRange(4 * cores, "z").sortWithinPartitions("z").select("cx", "cy", "x", "y", "m")
    cells = rows.mapInArrow(_weights(tree), CELLS)
    # cells go to the blocks of cells that they may meet
    shift, far = (MET, int(np.ceil((reach / (tree.side / (1 << tree.depth)) + 1) / (1 << MET)))) if kernel == "gaussian" else (1, 1)
    around = lambda c: F.explode(F.sequence(F.shiftright(c, shift) - far, F.shiftright(c, shift) + far))
    met = cells.withColumn("bx", around("cx")).withColumn("by", around("cy"))
    met = met.repartition(4 * cores, "level", "bx", "by").sortWithinPartitions("level", "bx", "by")
    meet = _smooth(tree, bandwidth, int(np.ceil(reach / (tree.side / (1 << tree.depth)))) + 1) if kernel == "gaussian" else _apart(tree, bandwidth)
    local = met.mapInPandas(_grouped(["level", "bx", "by"], meet, shift), CELLS)
    # what cells receive goes to the blocks of leaves below
    down, up = F.greatest(F.lit(tree.depth - BLOCK) - F.col("level"), F.lit(0)), F.greatest(F.col("level") - (tree.depth - BLOCK), F.lit(0))
    own = lambda c: F.call_function("shiftright", c, up)
    below = lambda c: F.explode(F.sequence(F.call_function("shiftleft", own(F.col(c)), down), F.call_function("shiftleft", own(F.col(c)) + 1, down) - 1))
    none = lambda t: F.lit(None).cast(t)
    received = local.withColumn("bx", below("cx")).withColumn("by", below("cy")).select("bx", "by", F.lit(0).alias("kind"), "level", "cx", "cy", "data", none("double").alias("x"), none("double").alias("y"), none("long").alias("m"))
    point = lambda df, kind: df.select("bx", "by", F.lit(kind).alias("kind"), none("int").alias("level"), "cx", "cy", none("binary").alias("data"), "x", "y", "m")
    here = x.withColumns({"bx": F.shiftright("cx", BLOCK), "by": F.shiftright("cy", BLOCK)})
    rows = received.union(point(here, 1))
    if pairs is not None:  # and those of the leaves around
        about = lambda c: F.explode(F.array_distinct(F.array(*(F.shiftright(F.col(c) + k, BLOCK) for k in (-1, 0, 1)))))
        ring = x.withColumn("bx", about("cx")).withColumn("by", about("cy")).where((F.col("bx") != F.shiftright("cx", BLOCK)) | (F.col("by") != F.shiftright("cy", BLOCK)))
        rows = rows.union(point(ring, 2))
    blocks = max(4 * cores, min(1024, 4 ** (tree.depth - BLOCK)))
    rows = rows.repartition(blocks, "bx", "by").sortWithinPartitions("bx", "by", "kind")
    return rows.mapInPandas(_grouped(["bx", "by"], _received(tree, pairs)), "x double, y double, density double")


def _grouped(key: list[str], each: Callable, *more: object) -> Callable:
    """``each`` of the rows of a key, which stand together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            values = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                this = tuple(values[a].tolist())
                if this != now and held:
                    yield each(now, pd.concat(held), *more)
                    held = []
                now = this
                held.append(batch.iloc[a:b])
        if held:
            yield each(now, pd.concat(held), *more)

    return run


def _weights(tree: Tree) -> Callable:
    """The weights of cells of all levels, from leaves along the zigzag; a cell that several tasks meet comes in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [basis((_AT + side) / 2) for side in (-1, 1)]
        open_: dict[int, tuple[int, int, np.ndarray]] = {}
        out: list[tuple[int, int, int, bytes]] = []

        def close(level: int) -> None:
            if level in open_:
                cx, cy, weights = open_.pop(level)
                out.append((level, cx, cy, weights.tobytes()))
                if level > tree.top:
                    put(level - 1, cx >> 1, cy >> 1, halves[cx & 1].T @ weights @ halves[cy & 1])

        def put(level: int, cx: int, cy: int, weights: np.ndarray) -> None:
            if level in open_ and open_[level][:2] != (cx, cy):
                close(level)
            open_[level] = (cx, cy, open_[level][2] + weights if level in open_ else weights)

        def made() -> pa.RecordBatch:
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["level", "cx", "cy", "data"])

        for batch in batches:
            cx, cy, x, y, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1).tolist(), len(x)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    u, v = tree.bases(x[a:b], y[a:b], int(cx[a]), int(cy[a]))
                    put(tree.depth, int(cx[a]), int(cy[a]), u.T @ (v * m[a:b, None]))
            if len(out) > 1000:
                yield made()
                out.clear()
        for level in range(tree.depth, tree.top - 1, -1):
            close(level)
        if out:
            yield made()

    return run


def _cells(part: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
    found: dict[tuple[int, int], np.ndarray] = {}
    for cx, cy, data in zip(part["cx"].tolist(), part["cy"].tolist(), part["data"]):
        values = np.frombuffer(data).reshape(NODES, NODES)
        found[cx, cy] = found[cx, cy] + values if (cx, cy) in found else values
    return found


def _table(level: int, found: dict) -> pd.DataFrame:
    return pd.DataFrame({"level": np.full(len(found), level, np.int32), "cx": [c[0] for c in found], "cy": [c[1] for c in found], "data": [v.tobytes() for v in found.values()]})


def _smooth(tree: Tree, bandwidth: float, far: int) -> Callable:
    """What the cells of a block receive from those as far as the gaussian kernel reaches, one axis after the other."""
    known: dict[int, np.ndarray] = {}

    def along(offset: int) -> np.ndarray:
        if offset not in known:
            d = (offset + (_AT[:, None] - _AT) / 2) * (tree.side / (1 << tree.depth)) / bandwidth
            known[offset] = np.exp(-0.5 * d * d)
        return known[offset]

    def run(key: tuple, part: pd.DataFrame, shift: int) -> pd.DataFrame:
        (level, bx, by), cells = key, _cells(part)
        own = [c for c in cells if c[0] >> shift == bx and c[1] >> shift == by]
        rows: dict[int, dict[int, np.ndarray]] = {}  # of each row of cells, what it adds up to at each column
        for (x, y), v in cells.items():
            for cx in {c[0] for c in own}:
                if abs(cx - x) <= far:
                    row = rows.setdefault(cx, {})
                    row[y] = row.get(y, 0) + along(cx - x) @ v
        out = {(cx, cy): sum((v @ along(cy - y).T for y, v in rows[cx].items() if abs(cy - y) <= far), np.zeros((NODES, NODES))) for cx, cy in own}
        return _table(level, out)

    return run


def _apart(tree: Tree, bandwidth: float) -> Callable:
    """What the children of a cell receive from those of the cells around it that they don't touch, by the exponential kernel."""
    known: dict[tuple[int, int, int], np.ndarray] = {}

    def between(level: int, ox: int, oy: int) -> np.ndarray:
        if (level, ox, oy) not in known:
            if len(known) >= 40:
                known.clear()
            dx, dy = ((o + (_AT[:, None] - _AT) / 2) * (tree.side / (1 << level) / bandwidth) for o in (ox, oy))
            d = np.sqrt((dx * dx)[:, None, :, None] + (dy * dy)[None, :, None, :])
            known[level, ox, oy] = np.exp(-d).reshape(NODES**2, NODES**2)
        return known[level, ox, oy]

    def run(key: tuple, part: pd.DataFrame, shift: int) -> pd.DataFrame:
        (level, bx, by), cells, out = key, _cells(part), {}
        for cx, cy in cells:
            if cx >> shift == bx and cy >> shift == by:
                met = [(x, y) for x, y in cells if max(abs(x - cx), abs(y - cy)) > 1]
                if met:
                    out[cx, cy] = sum(between(level, cx - x, cy - y) @ cells[x, y].ravel() for x, y in met).reshape(NODES, NODES)
        return _table(level, out)

    return run


def _received(tree: Tree, pairs: Callable | None) -> Callable:
    """The sums at the points of a block's leaves: what their cells of all levels have received, and what points of leaves that touch add."""
    known: dict[tuple[int, int], np.ndarray] = {}

    def inside(up: int, at: int) -> np.ndarray:
        """A leaf's nodes by the polynomials of the cell ``up`` levels above, in which it is the leaf ``at``."""
        if (up, at) not in known:
            known[up, at] = basis((2 * at + 1 + _AT) / (1 << up) - 1)
        return known[up, at]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        got, points = part[part["kind"] == 0], part[part["kind"] > 0].sort_values(["cx", "cy"], kind="stable")
        levels = {int(level): _cells(rows) for level, rows in got.groupby("level")}
        kind, cx, cy = (points[c].to_numpy(np.int64) for c in ("kind", "cx", "cy"))
        x, y, m = (points[c].to_numpy(float) for c in ("x", "y", "m"))
        cuts = [0, *(np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1).tolist(), len(x)]
        leaves = {(int(cx[a]), int(cy[a])): (a, b) for a, b in zip(cuts, cuts[1:]) if a < b}
        sums = np.zeros(len(x))
        for (u, v), (a, b) in leaves.items():
            if kind[a] != 1:
                continue
            values = np.zeros((NODES, NODES))
            for level, cells in levels.items():
                up = tree.depth - level
                if (u >> up, v >> up) in cells:
                    values += inside(up, u & ((1 << up) - 1)) @ cells[u >> up, v >> up] @ inside(up, v & ((1 << up) - 1)).T
            one, two = tree.bases(x[a:b], y[a:b], u, v)
            sums[a:b] = ((one @ values) * two).sum(axis=1)
            if pairs is not None:
                near = [leaves[c] for c in ((u + k, v + r) for k in (-1, 0, 1) for r in (-1, 0, 1)) if c in leaves]
                pairs((x[a:b], y[a:b]), [(x[p:q], y[p:q], m[p:q]) for p, q in near], sums[a:b])
        own = kind == 1
        return pd.DataFrame({"x": x[own], "y": y[own], "density": sums[own]})

    return run
