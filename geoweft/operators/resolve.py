"""Decisions in order, made in parallel: degree caps, picks, rewiring.

The order is cut into windows. A task decides one window in order, given what
matters of all windows before it: degrees of nodes that may reach the cap, ties
that earlier decisions have made or undone. At first nothing is known of these but
what stands from the beginning, so all windows are decided by a guess; then each
learns what those before it have decided, and the ones to which that is news decide
anew. When there is no news, all decisions are those of one pass in order: the
first window was right from the start, and each other one follows from right ones.

So there are at most as many rounds as windows, and as a rule few: a decision can
change only if a node at its cap, or a tie of the same two nodes, does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweft.operators.shared import Tables, saved

#: Rows that a window is to hold; windows that there are at least, and rows that each of those is to hold.
WINDOW_ROWS, WINDOWS, LEAST_ROWS = 250_000, 4, 250
#: What a window knows of others: v of the pair (a, b), or of node a where b is NODE.
NEWS = "w long, a long, b long, v long"
NODE = -1
#: Nodes whose numbers may be broadcast.
BROADCAST_NODES = 200_000


def windows(rows: int) -> int:
    return max(-(-rows // WINDOW_ROWS), min(WINDOWS, rows // LEAST_ROWS), 1)


def window_of(node: Column, n: int, count: int) -> Column:
    """The window of a node's turn: windows are runs of nodes."""
    return F.floor(node * F.lit(count) / F.lit(max(1, n))).cast("long")


@dataclass(frozen=True)
class Settled:
    """Decisions, and the news that they were taken with; tables both."""

    results: DataFrame
    known: DataFrame


def settled(items: DataFrame, decide: Callable, schema: str, news: Callable, tables: Tables, old: Settled | None = None, again: list[int] | None = None) -> Settled:
    """The decisions on ``items`` (with a column w) as of one pass over the windows in order.

    decide(items, news) -> decisions, with w, of one window. news(decisions or None) -> what each window is to know, without zeros. After
    ``old`` decisions, only the items of windows ``again`` have changed; what else has news is decided again too.
    """
    results, known = (old.results, tables.write(news(old.results))) if old else (None, tables.write(news(None)))
    active = sorted({*again, *_differing(known, old.known)}) if old else None
    if old:
        tables.drop(old.known)
    while active is None or active:
        some = (lambda df: df) if active is None else (lambda df, active=active: df.where(F.col("w").isin(active)))
        fresh = tables.write(some(items).groupBy("w").cogroup(some(known).groupBy("w")).applyInPandas(decide, schema))
        now = fresh
        if results is not None:
            now = tables.write(results.where(~F.col("w").isin(active)).union(fresh))
            tables.drop(fresh, results)
        results = now
        after = tables.write(news(results))
        active = _differing(after, known)
        tables.drop(known)
        known = after
    return Settled(results, known)


def _differing(one: DataFrame, other: DataFrame) -> list[int]:
    """The windows that don't know the same by both."""
    both = one.withColumnRenamed("v", "x").join(other.withColumnRenamed("v", "y"), ["w", "a", "b"], "full")
    return [r[0] for r in both.where(~F.col("x").eqNullSafe(F.col("y"))).select("w").distinct().collect()]


def before(counts: DataFrame, touched: DataFrame) -> DataFrame:
    """(w, a, v): for each node and window of ``touched`` (w, a) the sum over earlier windows of ``counts`` (w, a, v)."""
    each = touched.join(counts, ["w", "a"], "left")
    return each.select("w", "a", F.sum("v").over(W.partitionBy("a").orderBy("w").rowsBetween(W.unboundedPreceding, -1)).alias("v")).where("v <> 0")


# -- caps of random graphs ---------------------------------------------------------


def capped(edges: DataFrame, cap: int, n: int) -> DataFrame:
    """Of (i, j, length, p, q), the edges that greedy admission in order of (p, q) accepts: both ends must have fewer than ``cap`` edges.

    Nodes are 0 to n - 1. Edges between nodes of at most ``cap`` edges are accepted without further ado; only those with a contested end
    are decided in order.
    """
    names = ["i", "j", "length"]
    if cap <= 0:
        return edges.limit(0).select(*names)
    ends = F.explode(F.array("i", "j"))
    full = edges.select(ends.alias("n")).groupBy("n").agg(F.count("*").alias("c")).where(F.col("c") > cap).select("n")
    with Tables(edges.sparkSession) as tables:
        full = tables.write(full)
        if (m := full.count()) == 0:
            return edges.select(*names)
        some = F.broadcast(full) if m <= BROADCAST_NODES else full
        near = edges.join(some.select(F.col("n").alias("i"), F.lit(True).alias("x")), "i", "left").join(some.select(F.col("n").alias("j"), F.lit(True).alias("y")), "j", "left")
        near = tables.write(near.select(*names, "p", "q", "x", "y"))
        open_ = near.where("x or y")
        count = windows(open_.count())
        items = tables.write(open_.withColumn("w", window_of(F.col("p"), n, count)))
        touched = items.select("w", F.explode(F.filter(F.array(F.when(F.col("x"), F.col("i")), F.when(F.col("y"), F.col("j"))), lambda v: v.isNotNull())).alias("a")).distinct()
        touched = tables.write(touched)

        def news(found: DataFrame | None) -> DataFrame:
            if found is None:
                return edges.sparkSession.createDataFrame([], NEWS)
            counts = found.select("w", ends.alias("a")).groupBy("w", "a").agg(F.count("*").alias("v"))
            return before(counts, touched).select("w", "a", F.lit(NODE).cast("long").alias("b"), F.least("v", F.lit(cap)).alias("v"))

        taken = settled(items, _admitted(cap), "w long, i long, j long, length double", news, tables).results
        return saved(near.where("x is null and y is null").select(*names).union(taken.select(*names)))


def _admitted(cap: int) -> Callable:
    def run(items: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["p", "q"])
        nodes, at = np.unique(items[["i", "j"]].to_numpy(), return_inverse=True)
        degree = np.zeros(len(nodes), np.int64)
        degree[np.searchsorted(nodes, news["a"].to_numpy())] = news["v"].to_numpy()
        degree, ok = degree.tolist(), []
        for i, j in at.reshape(-1, 2).tolist():
            yes = degree[i] < cap and degree[j] < cap
            ok.append(yes)
            if yes:
                degree[i] += 1
                degree[j] += 1
        return items.loc[ok, ["w", "i", "j", "length"]]

    return run


#: Nodes whose turns are decided at a time where edges are made only as turns come, and open nodes beyond them that they look at, at first.
TURNS, AHEAD = 2048, 512
#: Pairs of nodes that are looked at at a time.
TURN_PAIRS = 1 << 24


def capped_by_turns(nodes: DataFrame, n: int, cap: int, make: Callable) -> DataFrame:
    """The edges (i, j, length) of the same admission where most hits find a full end: hits are made for some turns at a time, with open nodes only.

    make(nodes, start, span) -> hits (i, j, length, p, q) among some nodes, most of which have numbers from ``start`` to start + span. As a
    node takes its hits by their numbers, the first open nodes fill it as a rule. One that they don't fill ends the run of turns; it begins
    the next, which looks further ahead, in the end at all open nodes.
    """
    spark = nodes.sparkSession
    at, ahead, done = 0, AHEAD, []
    with Tables(spark) as tables:
        open_ = tables.write(nodes.withColumn("deg", F.lit(0).cast("long")))
        while at < n:
            size = max(1, min(TURNS, TURN_PAIRS // (TURNS + ahead)))
            to_come = open_.where(F.col("node_pos") >= at).orderBy("node_pos").limit(size + ahead).withColumn("r", F.row_number().over(W.orderBy("node_pos")))
            count, last, stop = to_come.agg(F.count("*"), F.max("node_pos"), F.max(F.when(F.col("r") <= size, F.col("node_pos")))).first()
            if not count:
                break
            some = open_.where(F.col("node_pos") <= last)
            known = some.select(F.lit(0).alias("w"), F.col("node_pos").alias("a"), F.col("deg").alias("v"))
            hits = make(some.drop("deg"), at, last - at + 1).where(F.col("p").between(at, stop)).select(F.lit(0).alias("w"), "i", "j", "length", "p", "q")
            whole = count < size + ahead
            taken = tables.write(hits.groupBy("w").cogroup(known.groupBy("w")).applyInPandas(_turns(cap, at, stop, whole), "i long, j long, length double"))
            cut = taken.where("i < 0").first()["j"]
            counts = taken.where("i >= 0").select(F.explode(F.array("i", "j")).alias("node_pos")).groupBy("node_pos").agg(F.count("*").alias("more"))
            counts = counts if whole else F.broadcast(counts)
            after = open_.join(counts, "node_pos", "left").withColumn("deg", F.col("deg") + F.coalesce("more", F.lit(0))).drop("more").where(F.col("deg") < cap)
            after = tables.write(after)
            tables.drop(open_)
            open_, at, ahead = after, cut, AHEAD if cut > stop else min(4 * ahead, n)
            done.append(taken)
        if not done:
            return spark.createDataFrame([], "i long, j long, length double")
        every = spark.read.schema("i long, j long, length double").parquet(*(tables.paths[id(t)][0] for t in done))
        return saved(every.where("i >= 0"))


def _turns(cap: int, at: int, stop: int, whole: bool) -> Callable:
    """Decides the turns of nodes from ``at`` to ``stop``; the last row, with i = -1, has as j the node with which the next turns begin."""

    def run(items: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known, items = known.sort_values("a"), items.sort_values(["p", "q"])
        nodes, degree = known["a"].to_numpy(), known["v"].tolist()
        turns = np.flatnonzero((nodes >= at) & (nodes <= stop))
        start, end = (np.searchsorted(items["p"].to_numpy(), nodes[turns], side).tolist() for side in ("left", "right"))
        other, ok, cut = np.searchsorted(nodes, items["q"].to_numpy()).tolist(), [], stop + 1
        for t, first, last in zip(turns.tolist(), start, end):
            got = []
            for r in range(first, last):
                if degree[t] + len(got) >= cap:
                    break
                if degree[other[r]] < cap:
                    got.append(r)
            if degree[t] + len(got) < cap and not whole:
                cut = int(nodes[t])
                break
            degree[t] += len(got)
            for r in got:
                degree[other[r]] += 1
            ok += got
        out = items.iloc[ok][["i", "j", "length"]]
        return pd.concat((out, pd.DataFrame({"i": [-1], "j": [cut], "length": [0.0]})))

    return run


# -- picks of nearest nodes ------------------------------------------------------


def picks(lists: DataFrame, max_degree: int, tables: Tables, old: Settled | None = None, longer: DataFrame | None = None) -> Settled:
    """Of ranked candidates (w, node_pos, nbr, d, rank, k, nbr_k), what each node, in order, picks: its first ``k`` that haven't picked it, that
    have room for their own picks and one more, and only while it has room itself. As (w, node_pos, nbr, d, rank, k).

    ``old`` are picks from before the lists of the nodes ``longer`` became longer.
    """
    items = tables.write(lists)
    again = None if longer is None else [r[0] for r in items.join(longer, "node_pos", "left_semi").select("w").distinct().collect()]
    # whether a candidate has picked the node matters across windows only where it lists the node and has its turn in an earlier one
    other = items.select(F.col("w").alias("earlier"), F.col("node_pos").alias("nbr"), F.col("nbr").alias("node_pos"))
    waits = tables.write(items.join(other, ["node_pos", "nbr"]).where("earlier < w").select("w", F.col("node_pos").alias("a"), F.col("nbr").alias("b")))
    # degrees matter only of nodes that may reach the cap
    listed = items.groupBy(F.col("nbr").alias("a")).agg(F.count("*").alias("m"), F.max("nbr_k").alias("k"))
    own = items.groupBy(F.col("node_pos").alias("a")).agg(F.max("k").alias("own"))
    tight = listed.join(own, "a", "full").where(F.coalesce("m", F.lit(0)) + 2 * F.coalesce("k", "own") >= max_degree).select("a")
    tight = tables.write(tight)
    some = F.broadcast(tight) if tight.count() <= BROADCAST_NODES else tight
    touched = items.select("w", F.explode(F.array("node_pos", "nbr")).alias("a")).join(some, "a", "left_semi").select("w", "a").distinct()
    touched = tables.write(touched)

    def news(found: DataFrame | None) -> DataFrame:
        if found is None:
            return lists.sparkSession.createDataFrame([], NEWS)
        back = found.select(F.col("nbr").alias("a"), F.col("node_pos").alias("b"))
        backs = waits.join(back, ["a", "b"]).select("w", "a", "b", F.lit(1).cast("long").alias("v"))
        counts = found.select("w", F.explode(F.array("node_pos", "nbr")).alias("a")).groupBy("w", "a").agg(F.count("*").alias("v"))
        degrees = before(counts, touched).select("w", "a", F.lit(NODE).cast("long").alias("b"), F.least("v", F.lit(max_degree)).alias("v"))
        return backs.union(degrees)

    return settled(items, _picked(max_degree), "w long, node_pos long, nbr long, d double, rank long, k long", news, tables, old, again)


def _picked(max_degree: int) -> Callable:
    def run(items: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["node_pos", "rank"])
        pairs = items[["node_pos", "nbr"]].to_numpy()
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        size = len(nodes)
        code, back = at[:, 0] * size + at[:, 1], at[:, 1] * size + at[:, 0]
        # the row in which the candidate lists the node, if it is here
        order = np.argsort(code)
        where = np.minimum(np.searchsorted(code, back, sorter=order), len(code) - 1)
        row = np.where(code[order[where]] == back, order[where], -1)
        degree = np.zeros(size, np.int64)
        alone = news["b"].to_numpy() == NODE
        degree[np.searchsorted(nodes, news["a"].to_numpy()[alone])] = news["v"].to_numpy()[alone]
        a, b = (np.searchsorted(nodes, news[c].to_numpy()[~alone]) for c in ("a", "b"))
        blocked = np.isin(code, a * size + b)
        degree, taken, got, now = degree.tolist(), bytearray(len(code)), 0, -1
        for r, (i, j, k, nbr_k, other, no) in enumerate(zip(at[:, 0].tolist(), at[:, 1].tolist(), items["k"].tolist(), items["nbr_k"].tolist(), row.tolist(), blocked.tolist())):
            if i != now:
                now, got = i, 0
            if got < k and not no and not (other >= 0 and taken[other]) and degree[i] < max_degree and degree[j] + nbr_k < max_degree:
                taken[r] = 1
                got += 1
                degree[i] += 1
                degree[j] += 1
        return items.loc[np.frombuffer(taken, np.uint8) == 1, ["w", "node_pos", "nbr", "d", "rank", "k"]]

    return run


#: Rows of lists that one run of turns decides at most where only nodes with room are listed, and nodes of a list at least.
LIST_ROWS, LISTED = 1_000_000, 16


def picks_by_turns(nodes: DataFrame, cap: int, search: Callable) -> DataFrame:
    """The same picks where many nodes have no room: lists are made for some turns at a time, of nodes that still have room when these begin.

    Of ``nodes`` (node_pos, k, ...). search(points, asked, among) -> (node_pos, nbr, d, rank), the nearest ``asked`` of the points that meet
    ``among``. As nodes only fill up, the first of a node's list that still has room is the first of all. A node whose list doesn't suffice
    ends the run of turns and begins the next, with a longer list if it was the first. Ranks count the nodes that had room.
    """
    spark, at, longer, done = nodes.sparkSession, 0, 1, []
    picked = "node_pos long, nbr long, d double, rank long, k long"
    room, turn = F.col("deg") + F.col("k") < cap, (F.col("k") > 0) & (F.col("deg") < cap)
    with Tables(spark) as tables:
        state = tables.write(nodes.withColumn("deg", F.lit(0).cast("long")))
        while True:
            now = turn & (F.col("node_pos") >= at)
            to_come, open_ = state.agg(F.count_if(now), F.count_if(room)).first()
            if not to_come or not open_:
                break
            asked = min(open_, longer * max(LISTED, LIST_ROWS // to_come))
            size = max(1, LIST_ROWS // asked)
            stop = state.agg(F.max("node_pos")).first()[0] if size >= to_come else state.where(now).orderBy("node_pos").limit(size).agg(F.max("node_pos")).first()[0]
            now = now & (F.col("node_pos") <= stop)
            lists = search(state.where(room | now), F.when(now, F.lit(asked)).otherwise(F.lit(0)), room)
            items = lists.join(state.select("node_pos", "k", "deg"), "node_pos").join(state.select(F.col("node_pos").alias("nbr"), F.col("k").alias("nbr_k"), F.col("deg").alias("nbr_deg")), "nbr")
            if done:  # those that have picked the node
                every = spark.read.schema(picked).parquet(*(tables.paths[id(t)][0] for t in done))
                items = items.join(every.select(F.col("nbr").alias("node_pos"), F.col("node_pos").alias("nbr"), F.lit(True).alias("no")), ["node_pos", "nbr"], "left")
            else:
                items = items.withColumn("no", F.lit(None).cast("boolean"))
            items = items.select(F.lit(0).alias("w"), "node_pos", "nbr", "d", "rank", "k", "deg", "nbr_k", "nbr_deg", F.coalesce("no", F.lit(False)).alias("no"))
            taken = tables.write(items.groupBy("w").applyInPandas(_turn_picks(cap, asked, asked >= open_), picked))
            done.append(taken)
            cut = taken.where("node_pos < 0").agg(F.max("nbr")).first()[0]
            cut = stop + 1 if cut is None else cut
            counts = taken.where("node_pos >= 0").select(F.explode(F.array("node_pos", "nbr")).alias("node_pos")).groupBy("node_pos").agg(F.count("*").alias("more"))
            after = state.join(counts, "node_pos", "left").withColumn("deg", F.col("deg") + F.coalesce("more", F.lit(0))).drop("more")
            after = tables.write(after.where(room | (turn & (F.col("node_pos") >= cut))))
            stuck = cut <= stop and taken.where("node_pos >= 0").isEmpty()
            tables.drop(state)
            state, at, longer = after, cut, 4 * longer if stuck else 1
        if not done:
            return spark.createDataFrame([], picked)
        return saved(spark.read.schema(picked).parquet(*(tables.paths[id(t)][0] for t in done)).where("node_pos >= 0"))


def _turn_picks(cap: int, asked: int, whole: bool) -> Callable:
    """Decides turns in order; a row with node_pos = -1 has as nbr the node whose list doesn't suffice, if there is one."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["node_pos", "rank"])
        nodes, at = np.unique(items[["node_pos", "nbr"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        degree = np.zeros(len(nodes), np.int64)
        degree[at[:, 0]], degree[at[:, 1]] = items["deg"].to_numpy(), items["nbr_deg"].to_numpy()
        starts = [*np.flatnonzero(np.diff(at[:, 0], prepend=-1)).tolist(), len(at)]
        degree, other, k = degree.tolist(), at[:, 1].tolist(), items["k"].tolist()
        most, no = (cap - items["nbr_k"].to_numpy()).tolist(), items["no"].tolist()
        ok, ties, cut = [], set(), None
        for first, end in zip(starts, starts[1:]):
            i, got = int(at[first, 0]), []
            for r in range(first, end):
                if len(got) >= k[first] or degree[i] + len(got) >= cap:
                    break
                if not no[r] and degree[other[r]] < most[r] and (other[r], i) not in ties:
                    got.append(r)
            if len(got) < k[first] and degree[i] + len(got) < cap and end - first >= asked and not whole:
                cut = int(nodes[i])
                break
            degree[i] += len(got)
            for r in got:
                degree[other[r]] += 1
                ties.add((i, other[r]))
            ok += got
        out = items.iloc[ok][["node_pos", "nbr", "d", "rank", "k"]]
        if cut is None:
            return out
        return pd.concat((out, pd.DataFrame({"node_pos": [-1], "nbr": [cut], "d": [0.0], "rank": [0], "k": [0]})))

    return run


# -- rewiring ----------------------------------------------------------------------


class Rewiring:
    """Edges (i, j, rank) after events in order of (i, rank) each take the first valid of their choices (i, rank, at, c).

    A choice is invalid if it is already tied to i or has reached the cap. An event without a valid choice keeps its edge and is ``short``.
    """

    def __init__(self, edges: DataFrame, max_degree: int, n: int, tables: Tables):
        self.edges, self.max_degree, self.n, self.tables = edges, max_degree, n, tables
        self.items = self.found = None

    def run(self, events: DataFrame, choices: DataFrame) -> DataFrame:
        """(w, i, rank, j, c, short) for each event (i, j, rank)."""
        lists = choices.groupBy("i", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("targets"))
        self.count = windows(events.count())
        w = window_of(F.col("i"), self.n, self.count)
        none = F.array().cast("array<long>")
        items = events.join(lists, ["i", "rank"], "left").select(w.alias("w"), "i", "j", "rank", F.coalesce("targets", none).alias("targets"))
        return self._settle(self.tables.write(items), None)

    def resume(self, choices: DataFrame) -> DataFrame:
        """The same with other choices for some events: only their windows, and what hangs on them, are decided again."""
        lists = choices.groupBy("i", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("other"))
        lists = self.tables.write(lists)
        again = [r[0] for r in self.items.join(lists, ["i", "rank"], "left_semi").select("w").distinct().collect()]
        items = self.items.join(lists, ["i", "rank"], "left").withColumn("targets", F.coalesce("other", "targets")).drop("other")
        return self._settle(self.tables.write(items.select("w", "i", "j", "rank", "targets")), again)

    def _settle(self, items: DataFrame, again: list[int] | None) -> DataFrame:
        low, high = F.least("i", "c").alias("u"), F.greatest("i", "c").alias("v")
        pairs = self.tables.write(items.select("w", "i", F.explode("targets").alias("c")).distinct().select("w", "i", "c", low, high))
        tied = self.edges.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
        first = self.tables.write(pairs.join(tied, ["u", "v"]).select("w", F.col("i").alias("a"), F.col("c").alias("b"), F.lit(1).cast("long").alias("v")))
        degree = self.edges.select(F.explode(F.array("i", "j")).alias("a")).groupBy("a").agg(F.count("*").alias("d"))
        asked = pairs.groupBy(F.col("c").alias("a")).agg(F.count("*").alias("m"))
        tight = asked.join(degree, "a", "left").where(F.coalesce("d", F.lit(0)) + F.col("m") >= self.max_degree).select("a", F.coalesce("d", F.lit(0)).alias("d"))
        sides = items.select("w", F.explode(F.concat("targets", F.array("j"))).alias("a")).distinct()
        touched = self.tables.write(sides.join(tight, "a").select("w", "a", "d"))

        def news(found: DataFrame | None) -> DataFrame:
            node = F.lit(NODE).cast("long").alias("b")
            if found is None:
                return first.union(touched.where("d <> 0").select("w", "a", node, F.col("d").alias("v")))
            moved = found.where("c is not null")
            each = F.explode(F.array(F.struct(F.col("c").alias("e"), F.lit(1).alias("x")), F.struct(F.col("j").alias("e"), F.lit(-1).alias("x"))))
            each = moved.select(F.col("w").alias("then"), "i", each.alias("t")).select("then", F.least("i", "t.e").alias("u"), F.greatest("i", "t.e").alias("v"), F.col("t.e").alias("e"), F.col("t.x").alias("x"))
            later = pairs.join(each.drop("e"), ["u", "v"]).where("then < w").select("w", F.col("i").alias("a"), F.col("c").alias("b"), F.col("x").cast("long").alias("v"))
            ties = first.union(later).groupBy("w", "a", "b").agg(F.sum("v").alias("v")).where("v <> 0")
            counts = each.groupBy(F.col("then").alias("w"), F.col("e").alias("a")).agg(F.sum("x").alias("v"))
            so_far = before(counts, touched.select("w", "a"))
            degrees = touched.join(so_far, ["w", "a"], "left").select("w", "a", node, (F.col("d") + F.coalesce("v", F.lit(0))).alias("v"))
            return ties.union(degrees.where("v <> 0"))

        self.items = items
        self.found = settled(items, _moved(self.max_degree), "w long, i long, rank long, j long, c long, short boolean", news, self.tables, self.found, again)
        return self.found.results


def _moved(max_degree: int) -> Callable:
    def run(items: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["i", "rank"])
        tied: dict[tuple[int, int], bool] = {}
        degree: dict[int, int] = {}
        for a, b, v in zip(news["a"].tolist(), news["b"].tolist(), news["v"].tolist()):
            if b == NODE:
                degree[a] = v
            else:
                tied[min(a, b), max(a, b)] = v > 0
        new, short = [], []
        for i, j, targets in zip(items["i"].tolist(), items["j"].tolist(), items["targets"]):
            for c in map(int, targets):
                e = (min(i, c), max(i, c))
                if c != i and not tied.get(e) and degree.get(c, 0) < max_degree:
                    tied[min(i, j), max(i, j)] = False
                    tied[e] = True
                    degree[j], degree[c] = degree.get(j, 0) - 1, degree.get(c, 0) + 1
                    new.append(c)
                    short.append(False)
                    break
            else:
                new.append(None)
                short.append(True)
        return items[["w", "i", "rank", "j"]].assign(c=pd.array(new, "Int64"), short=short)

    return run
