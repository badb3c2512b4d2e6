"""Which polygons cover which points, for polygons of any number of sides.

A side is filed under the dyadic intervals of y that make up its own, of which
there are two a level at most; a point asks for the one of each level that it lies
in. So a point meets only sides at about its height, and no side is filed more
often than the logarithm of their number, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geometry as G

#: Sides of a polygon up to which each point looks at all of them.
FEW_SIDES = 64


def sides(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, x1, y1, x2, y2): a row for each side of each ring."""
    ring = polygons.select(key, F.explode(rings).alias("ring"))
    return ring.select(key, F.explode(G.edges("ring")).alias("e")).select(key, *(F.col(f"e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


def covering(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings", own: bool = False) -> DataFrame:
    """``points`` (x, y, ...) with the ``key`` of each polygon (key, rings) that covers them, a row for each; with ``own``, only polygons whose key
    the points have. Boundaries belong to polygons, the insides of holes don't.
    """
    return within_sides(points, sides(polygons, key, rings), key, own)


def within_sides(points: DataFrame, every: DataFrame, key: str, own: bool = False) -> DataFrame:
    """The same for polygons given as tables of their sides (key, x1, y1, x2, y2), so that one polygon may have more than a row holds."""
    place = ["x", "y", *([key] if own else [])]
    p = points.select(*place).distinct()
    about = every.groupBy(key).agg(F.count("*").alias("m"), *(f(F.least("y1", "y2") if f is F.min else F.greatest("y1", "y2")).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))))
    # as many intervals as sides, to the next power of two
    about = about.select(key, "low", "high", F.greatest(F.ceil(F.log2(F.col("m").cast("double"))), F.lit(0)).cast("int").alias("depth"))
    cells = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
    height = F.greatest(F.col("high") - F.col("low"), F.lit(1e-300))
    at = lambda y: F.least(F.floor((y - F.col("low")) / height * cells), cells - 1).cast("long")
    filed = every.join(about, key).withColumns({"a": at(F.least("y1", "y2")), "b": at(F.greatest("y1", "y2")) + 1})
    filed = filed.select(key, "x1", "y1", "x2", "y2", F.explode(_intervals("a", "b", "depth")).alias("t")).select(key, "x1", "y1", "x2", "y2", "t.level", "t.cell")
    near = p.join(about, key) if own else p.join(F.broadcast(about), (F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high")))
    near = near.where("y >= low and y <= high").withColumn("cell0", at(F.col("y")))
    asked = near.select(key, "x", "y", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda v: F.struct(v.alias("level"), F.call_function("shiftright", F.col("cell0"), v).alias("cell")))).alias("t"))
    met = asked.select(key, "x", "y", "t.level", "t.cell").join(filed, [key, "level", "cell"])
    x, y = F.col("x"), F.col("y")
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    inside = met.groupBy("x", "y", key).agg(F.max(G.on_side(e, x, y)).alias("on"), F.sum(G.passes_side(e, x, y).cast("int")).alias("n")).where("on or n % 2 = 1").select("x", "y", key)
    return points.join(inside, place)


def _intervals(a: str, b: str, depth: str) -> Column:
    """The dyadic intervals (level, cell) that make up [a, b)."""

    def of(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")
        one = lambda ok, cell: F.when((low < high) & ok, F.struct(level.alias("level"), cell.alias("cell")))
        return F.array(one(low % 2 == 1, low), one(high % 2 == 1, high - 1))

    # the whole is one interval of the last level
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.col(depth)), of)), lambda t: t.isNotNull())
