"""Nearest-neighbour graphs with rewiring by distance."""

from __future__ import annotations

import math
import secrets
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweft.functions.decay import decay, decay_array, distance
from geoweft.functions.hashing import fast_row, uniform
from geoweft.operators import constraint as C
from geoweft.operators import resolve
from geoweft.operators.frame import BROADCAST_IDS, GeoFrame, GeoGraph, as_nodes, find_scaling_factor, finished, numbered, report, warn_crs, warn_if_empty
from geoweft.operators.shared import Tables, saved
from geoweft.operators.spatial import all_pairs, knn_join, parallel

#: Pairs of rewired edges and nodes up to which every node gets a key; beyond, targets are drawn.
RACE_PAIRS = 50_000_000


# Messages that callers match.
NO_NUMBER = "k must be an integer, a float, or a string"
NO_DEGREE = "k must not be 0"
NO_SHARE = "p must be between 0 and 1"


def half_degrees(k: int | float | str, seed: int, names: list[str], fast: bool = True) -> Column:
    """Neighbours that each node picks: a column's half, rounded down; or k/2, mixed from its neighbours at random so that the mean is k/2."""
    if isinstance(k, str):
        if k not in names:
            raise KeyError(k)
        return F.floor(F.col(k) / 2).cast("long")
    if isinstance(k, bool) or not isinstance(k, (int, float)):
        raise ValueError("k must be an integer or a float.")
    half = k / 2
    low = int(half // 1)
    share = half - low
    if share == 0:
        return F.lit(low).cast("long")
    return F.when(uniform("k", seed, "node_pos", fast=fast) < F.lit(share), F.lit(low + 1)).otherwise(F.lit(low)).cast("long")


def nearest_nodes(nodes: DataFrame, k: Column, max_degree: int, query_factor: int, predicate: Column | None, need: list[str], ranked: bool = True) -> DataFrame:
    """(node_pos, nbr, d, rank, k): each node, in order, picks its nearest nodes that are allowed, have room and haven't picked it.

    Lists of query_factor * k allowed neighbours are tried first; nodes for which they don't suffice get longer ones, and only what hangs on
    these is decided again. Where lists would become far longer than the first, and where the cap is tight and ranks don't matter
    (not ``ranked``), picks are made by turns from nodes that have room.
    """
    spark = nodes.sparkSession
    with Tables(spark) as tables:
        own = tables.write(nodes.withColumn("k", F.least(F.greatest(k, F.lit(0)), F.lit(max_degree)).cast("long")))
        n, least, greatest = own.agg(F.count("*"), F.min("k"), F.max("k")).first()
        by = C.classes(predicate)
        search = lambda points, asked, among: knn_join(points.withColumn("asked", asked), F.col("asked"), predicate, need, by, among)
        if n and not ranked and max_degree < TIGHT * greatest:
            return _warned(own, resolve.picks_by_turns(own, max_degree, search))
        sizes = F.col("node_pos"), F.col("k")
        first = F.least(F.col("k") * max(2, int(query_factor)), F.lit(n - 1))
        asking, lists, found = own.select("node_pos", first.alias("asked")), None, None
        while True:
            # only nodes that ask for a list search
            points = own.join(asking, "node_pos", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
            full = knn_join(points, F.col("asked"), predicate, need, by)
            if found is None and n and least == greatest:  # all ask for the same
                full = full.withColumns({"k": F.lit(least), "nbr_k": F.lit(least), "asked": F.lit(min(least * max(2, int(query_factor)), n - 1))})
                full = full.withColumns({c: F.col(c).cast("long") for c in ("k", "nbr_k", "asked")})
            else:
                full = full.join(points.select(*sizes, "asked"), "node_pos").join(own.select(F.col("node_pos").alias("nbr"), F.col("k").alias("nbr_k")), "nbr")
            full = full.select("node_pos", "nbr", "d", "rank", "k", "nbr_k", "asked")
            if found is None:
                lists = tables.write(full)
                w = resolve.window_of(F.col("node_pos"), n, resolve.windows(lists.count()))
                found = resolve.picks(lists.withColumn("w", w), max_degree, tables)
            else:
                before, lists = lists, tables.write(lists.join(asking, "node_pos", "left_anti").union(full))
                tables.drop(before)
                found = resolve.picks(lists.withColumn("w", w), max_degree, tables, found, asking)
            got = own.select(*sizes).where("k > 0").join(found.results.groupBy("node_pos").agg(F.count("*").alias("got")), "node_pos", "left").where(F.coalesce("got", F.lit(0)) < F.col("k"))
            # a list that is as long as was asked for may go on
            tried = lists.groupBy("node_pos").agg(F.count("*").alias("tried"), F.max("asked").alias("asked"))
            got = tables.write(got.join(tried, "node_pos", "left").select("node_pos", F.when((F.col("tried") >= F.col("asked")) & (F.col("asked") < n - 1), F.least(F.col("asked") * 4, F.lit(n - 1))).alias("asked")))
            asking = got.where("asked is not null")
            longer = asking.agg(F.sum("asked")).first()[0]
            if longer is None:
                return _warned(own, tables.kept(found.results).select("node_pos", "nbr", "d", "rank", "k"))
            if longer > resolve.WINDOW_ROWS + LONGER * n * max(1, greatest):
                return _warned(own, resolve.picks_by_turns(own, max_degree, search))


#: The cap, in picks of a node, below which many nodes are full; rows of longer lists, in picks of all nodes, that are asked for at a time.
TIGHT, LONGER = 4, 16


def _warned(own: DataFrame, picks: DataFrame) -> DataFrame:
    """The picks; warns of nodes that have picked fewer than ``k``."""
    short = own.join(picks.groupBy("node_pos").agg(F.count("*").alias("got")), "node_pos", "left").where(F.coalesce("got", F.lit(0)) < F.col("k"))
    if m := short.count():
        some = [r[0] for r in short.orderBy("node_pos").select("node_pos").head(5)]
        warnings.warn(f"{m} nodes have fewer neighbors than expected, {some} among them. Consider reducing their expected degree.", UserWarning, stacklevel=4)
    return picks


def rewiring_choices(events: DataFrame, nodes: DataFrame, n: int, a: float, s: float, predicate: Column | None, need: list[str], seed: int, fast: bool, keep: int | None) -> DataFrame:
    """(i, rank, at, c): the targets of each event in the order in which draws in proportion to the decay would take them, without repeats.

    An exponential race: each target's time is -ln(1-u) over its decay; the first valid one is a draw from the valid ones. With ``keep``
    only about so many of the first.
    """
    e = events.join(nodes.select(F.col("node_pos").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), *(F.col(f"a_{c}").alias(f"u_{c}") for c in need)), "i")
    t = nodes.select(F.col("node_pos").alias("c"), F.col("x").alias("xc"), F.col("y").alias("yc"), *(F.col(f"a_{c}").alias(f"v_{c}") for c in need))

    def targets(of: DataFrame) -> DataFrame:
        pairs = all_pairs(of, t, n, F.col("i") != F.col("c"))
        if predicate is not None:
            pairs = pairs.where(predicate)
        return pairs.withColumn("q", decay(distance("xi", "yi", "xc", "yc"), a, s)).where("q > 0")

    if keep:
        # times at most late enough for ``keep`` targets and a margin: only these are sorted, and they are the first ones whatever their number
        rates = targets(e).groupBy("i", "rank").agg((F.lit(keep + 6 * keep**0.5) / F.sum("q")).alias("latest"))
        e = e.join(saved(rates), ["i", "rank"])
    pairs = targets(e).withColumn("key", -F.log(F.lit(1.0) - uniform("rw", seed, "i", "rank", "c", fast=fast)) / F.col("q"))
    if keep:
        pairs = pairs.where("key <= latest")
    w = W.partitionBy("i", "rank").orderBy("key", "c")
    return pairs.withColumn("at", F.row_number().over(w)).select("i", "rank", "at", "c")


#: Cells a side that draws choose a node's place from, and draws of an event at first for each target that is wanted.
DRAW_CELLS, DRAWS = 64, 1.7


def drawn_choices(events: DataFrame, nodes: DataFrame, n: int, a: float, s: float, predicate: Column | None, need: list[str], seed: int, fast: bool, keep: int) -> DataFrame:
    """The same law by draws, until ``keep`` targets are taken; only rows of draws are made, not of all pairs.

    A draw is a cell of a grid, by its number of nodes and the decay at its least distance, which bounds that of its nodes, and any node in
    it, which is taken with what its own distance leaves of that bound. So most draws are taken wherever the node stands, however many
    nodes there are.
    """
    x0, y0, x1, y1 = nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    size = max(x1 - x0, y1 - y0) * (1 + 1e-9) / DRAW_CELLS or 1.0
    cell = F.floor((F.col("y") - y0) / size) * DRAW_CELLS + F.floor((F.col("x") - x0) / size)
    fine = saved(numbered(nodes.withColumn("cell", cell), [F.col("cell"), F.col("node_pos")], "r"))
    cells = fine.groupBy("cell").agg(F.count("*").alias("m"), F.min("r").alias("start"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")))
    cells = cells.orderBy("cell").toPandas()  # DRAW_CELLS squared at most
    side = lambda key, x, pre, more: fine.select(F.col(key).alias(x), *more, *(F.col(f"a_{c}").alias(f"{pre}{c}") for c in need))
    place = lambda x: [F.col("x").alias(f"x{x}"), F.col("y").alias(f"y{x}")]
    wide = F.broadcast if n <= BROADCAST_IDS else lambda df: df
    e = saved(events.join(side("node_pos", "i", "u_", place("i")).select("i", "xi", "yi"), "i"))
    todo, start, count, out = e, 0, math.ceil(DRAWS * keep), None
    for _ in range(6):
        draws = parallel(todo.select("i", "rank", "xi", "yi")).mapInPandas(_drawn(cells, a, s, seed, start, count), "i long, rank long, xi double, yi double, at long, r long, bound double")
        draws = draws.join(wide(side("r", "r", "v_", [F.col("node_pos").alias("c"), *place("c")])), "r").where("i <> c").where(F.col("bound") < decay(distance("xi", "yi", "xc", "yc"), a, s))
        if predicate is not None:
            draws = draws.join(wide(side("node_pos", "i", "u_", [])), "i").where(predicate)
        taken = saved(draws.select("i", "rank", "at", "c"))
        out = taken if out is None else out.union(taken)
        have = out.groupBy("i", "rank").agg(F.count_distinct("c").alias("m")).where(F.col("m") >= keep)
        todo, start, count = saved(todo.join(have, ["i", "rank"], "left_anti")), start + count, count * 4
        if todo.isEmpty():
            return out
    # the condition leaves too few for draws: these few events look at all nodes
    return out.join(todo.select("i", "rank"), ["i", "rank"], "left_anti").union(
        rewiring_choices(todo.select("i", "j", "rank"), nodes, n, a, s, predicate, need, seed, fast, None)
    )


def _drawn(cells: pd.DataFrame, a: float, s: float, seed: int, start: int, count: int) -> Callable:
    """Draws for events (i, rank, xi, yi): numbered from ``start``, the rank r of a node along the cells, and the least decay with which it is taken."""
    m, begin = cells["m"].to_numpy(float), cells["start"].to_numpy()
    x1, y1, x2, y2 = (cells[c].to_numpy() for c in ("min_x", "min_y", "max_x", "max_y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part, found = batch.iloc[k : k + 1000], []
                for i, rank, x, y in part.itertuples(index=False):
                    dx, dy = np.maximum(np.maximum(x1 - x, x - x2), 0), np.maximum(np.maximum(y1 - y, y - y2), 0)
                    bound = decay_array(np.sqrt(dx * dx + dy * dy), a, s)
                    total = np.cumsum(m * bound)
                    if not total[-1] > 0:
                        continue
                    u, v, w = fast_row(f"rt|{i}|{rank}", seed, start, 3 * count).reshape(3, count)
                    at = np.minimum(np.searchsorted(total, u * total[-1], "right"), len(m) - 1)
                    r = begin[at] + np.minimum((v * m[at]).astype(np.int64), m[at].astype(np.int64) - 1)
                    found.append((np.full(count, i), np.full(count, rank), np.full(count, x), np.full(count, y), np.arange(start, start + count), r, w * bound[at]))
                if found:
                    yield pd.DataFrame(dict(zip(("i", "rank", "xi", "yi", "at", "r", "bound"), map(np.concatenate, zip(*found)))))

    return run


def rewire(picks: DataFrame, nodes: DataFrame, p: float, a: float, s: float, max_degree: int, predicate: Column | None, need: list[str], seed: int, fast: bool, keep: int = 24) -> tuple[DataFrame, DataFrame | None]:
    """(i, j, length) after each edge has been rewired with probability p, and the edges that moved; the number of edges stays."""
    edges = saved(picks.select(F.col("node_pos").alias("i"), F.col("nbr").alias("j"), "rank", F.col("d").alias("length")))
    if p <= 0:
        return edges.select("i", "j", "length"), None
    n = nodes.count()
    events = saved(edges.where(uniform("p", seed, "i", "rank", fast=fast) < F.lit(float(p))).select("i", "j", "rank"))
    m = events.count()
    if not m:
        return edges.select("i", "j", "length"), None
    args = (nodes, n, a, s, predicate, need, seed, fast)
    choices = rewiring_choices(events, *args, keep) if m * n <= RACE_PAIRS else drawn_choices(events, *args, keep)
    with Tables(nodes.sparkSession) as tables:
        wiring = resolve.Rewiring(edges, max_degree, n, tables)
        done = wiring.run(events, choices)
        if not done.where("short").isEmpty() and (m * n > RACE_PAIRS or keep < n):
            # some events have used their choices up: they get all of them
            done = wiring.resume(rewiring_choices(done.where("short").select("i", "j", "rank"), *args, None))
        tables.kept(done)
    stuck = done.where("short").count()
    if stuck:
        warnings.warn(f"{stuck} edges found no valid node to be rewired to and were kept.", UserWarning, stacklevel=3)
    done = edges.select("i", "j", "rank").join(done.select("i", "rank", "c"), ["i", "rank"], "left").select("i", F.coalesce("c", "j").alias("j"), F.col("j").alias("old"))
    at = lambda c: nodes.select(F.col("node_pos").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    out = done.join(at("i"), "i").join(at("j"), "j").select("i", "j", distance("xi", "yi", "xj", "yj").alias("length"))
    return out, done.where("j <> old")


def geo_watts_strogatz_network(
    frame: GeoFrame,
    k: int | float | str,
    p: float,
    *,
    a: float = 3,
    scaling_factor: float | None = None,
    max_degree: int = 150,
    id_col: str | None = None,
    query_factor: int = 2,
    node_attributes: bool | str | list[str] = True,
    constraint: Callable | None = None,
    random_state: int | None = None,
    verbose: bool = False,
    fast: bool = True,
) -> GeoGraph:
    """Ties each node to its nearest ones, with mean degree ``k`` (a number, or the column of expected degrees), and rewires ties with probability ``p``."""
    if isinstance(k, bool) or not isinstance(k, (int, float, str)):
        raise ValueError(NO_NUMBER)
    if not isinstance(k, str) and k == 0:
        raise ValueError(NO_DEGREE)
    if not 0 <= p <= 1:
        raise ValueError(NO_SHARE)
    warn_crs(frame.crs)
    nodes = as_nodes(frame, id_col).persist()
    s = find_scaling_factor(frame) if scaling_factor is None else float(scaling_factor)
    seed = secrets.randbits(31) if random_state is None else int(random_state)
    names = [c for c in frame.df.columns if c not in ("node_pos", "node_id")]
    predicate, need = C.resolve(constraint, names)
    own = nodes.select("node_pos", "x", "y", half_degrees(k, seed, names, fast).alias("k"), *(F.col(f"`{c}`").alias(f"a_{c}") for c in need))
    picks = nearest_nodes(own, F.col("k"), max_degree, query_factor, predicate, need, ranked=p > 0)
    edges, moved = rewire(picks, own, p, a, s, max_degree, predicate, need, seed, fast)
    warn_if_empty(edges)
    graph = finished(frame, nodes, edges, id_col, node_attributes, present="edges")
    return report(graph, verbose, (moved.count() if moved is not None else 0) if verbose else None)
