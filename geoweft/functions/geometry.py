"""Planar geometry on columns and, for sampling domains, on the driver.

A point is struct<x,y>, a line an array of points. A polygon is an array of
rings, the shell first, and a ring an array of points; rings may be closed (first
point repeated) or not. Several polygons are an array of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
#: What a geometry is, by how deep its points lie in arrays.
SHAPES = ("point", "line", "polygon", "polygons")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often it is used: else expressions within expressions grow with each use."""
    return F.transform(F.array(value), of)[0]


def edges(ring: Column | str) -> Column:
    """(x1, y1, x2, y2) of a ring's sides; a closing side of no length does no harm."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _moments(ring: Column) -> Column:
    """Twice the signed area and six times the first moments, about the ring's first point."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        c = x1 * y2 - x2 * y1
        return F.struct((acc["a"] + c).alias("a"), (acc["mx"] + (x1 + x2) * c).alias("mx"), (acc["my"] + (y1 + y2) * c).alias("my"))

    return F.aggregate(edges(ring), zero, step)


def area(rings: Column) -> Column:
    """The shell's area less the holes'."""
    each = F.transform(rings, lambda r: F.abs(_moments(r)["a"]) / 2)
    return let(each, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s - x) + 2 * v[0])


def centroid(rings: Column) -> Column:
    """struct<x,y>; a polygon without area has its first point."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def of(rings: Column) -> Column:
        first = rings[0][0]

        def step(acc: Column, r: Column) -> Column:
            return let(F.struct(_moments(r).alias("m"), r[0].alias("o")), lambda v: let(_with_sign(acc, v), lambda w: _added(acc, v, w, first)))

        return let(F.aggregate(rings, zero, step), lambda t: F.struct(*(F.when(t["a"] == 0, first[c]).otherwise(first[c] + t[f"m{c}"] / (3 * F.nullif(t["a"], F.lit(0.0)))).alias(c) for c in "xy")))

    return let(rings, of)


def _with_sign(acc: Column, v: Column) -> Column:
    """A ring's area, negative for a hole, and what its moments are to be multiplied by."""
    m = v["m"]
    a = F.abs(m["a"]) * F.when(acc["a"] == 0, 1.0).otherwise(-1.0)
    return F.struct(a.alias("a"), F.when(m["a"] == 0, 0.0).otherwise(a / m["a"]).alias("s"))


def _added(acc: Column, v: Column, w: Column, first: Column) -> Column:
    """The sums with a ring's, whose moments are about its own first point, put about the shell's."""
    moved = lambda c: (acc[f"m{c}"] + w["s"] * v["m"][f"m{c}"] + 3 * w["a"] * (v["o"][c] - first[c])).alias(f"m{c}")
    return F.struct((acc["a"] + w["a"]).alias("a"), moved("x"), moved("y"))


def line_centroid(points: Column) -> Column:
    """struct<x,y>: the middle of a line's parts, weighted by their lengths; a line without length has its first point."""
    ends = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def step(acc: Column, e: Column) -> Column:
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        return let(F.sqrt(dx * dx + dy * dy), lambda n: F.struct((acc["n"] + n).alias("n"), *((acc[c] + n * (e["p"][c] + e["q"][c]) / 2).alias(c) for c in "xy")))

    sums = F.aggregate(ends, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), step)
    first = F.get(points, F.lit(0))
    return let(F.struct(sums.alias("t"), first.alias("first")), lambda v: _mean(v, "n"))


def _mean(v: Column, weight: str) -> Column:
    """The weighted mean of sums ``t``, or the first point where they have no weight."""
    return F.struct(*(F.coalesce(v["t"][c] / F.nullif(v["t"][weight], F.lit(0.0)), v["first"][c]).alias(c) for c in "xy"))


def polygons_centroid(polygons: Column) -> Column:
    """struct<x,y>: the polygons' centroids, weighted by their areas; without area the first one's."""

    def step(acc: Column, p: Column) -> Column:
        one = F.struct(area(p).alias("a"), centroid(p).alias("c"))
        return let(one, lambda v: F.struct((acc["a"] + v["a"]).alias("a"), *((acc[k] + v["a"] * v["c"][k]).alias(k) for k in "xy")))

    sums = F.aggregate(polygons, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), step)
    first = centroid(F.get(polygons, F.lit(0)))
    return let(F.struct(sums.alias("t"), first.alias("first")), lambda v: _mean(v, "a"))


def centre(geometry: Column, shape: str) -> Column:
    """struct<x,y> of a geometry of one of SHAPES."""
    return {"point": lambda g: g, "line": line_centroid, "polygon": centroid, "polygons": polygons_centroid}[shape](geometry)


def each_point(geometry: Column, shape: str, of: Callable[[Column], Column]) -> Column:
    """The geometry with each of its points replaced by ``of`` it."""

    def deep(g: Column, depth: int) -> Column:
        return F.transform(g, lambda x: deep(x, depth - 1)) if depth else of(g)

    return deep(geometry, SHAPES.index(shape))


def bounds(geometry: Column, shape: str = "polygon") -> Column:
    """struct<xmin,ymin,xmax,ymax> of all points of a line, a polygon or several."""
    points = geometry
    for _ in range(SHAPES.index(shape) - 1):
        points = F.flatten(points)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def on_side(e: Column | dict, x: Column, y: Column) -> Column:
    """Whether a point lies on a side (x1, y1, x2, y2)."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def passes_side(e: Column | dict, x: Column, y: Column) -> Column:
    """Whether a ray to the right from a point passes a side."""
    at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    return F.coalesce(((e["y1"] > y) != (e["y2"] > y)) & (x < at), F.lit(False))


def sides(rings: Column | str) -> Column:
    """The sides of all rings of a polygon."""
    return F.flatten(F.transform(rings, edges))


def covers_sides(every: Column, x: Column, y: Column) -> Column:
    """Whether a polygon, given by all its sides, covers a point."""
    return F.exists(every, lambda e: on_side(e, x, y)) | (F.size(F.filter(every, lambda e: passes_side(e, x, y))) % 2 == 1)


def covers(rings: Column, x: Column, y: Column) -> Column:
    """Whether a polygon of few sides covers a point: its boundary belongs to it, the inside of its holes doesn't."""
    return covers_sides(sides(rings), x, y)


def literal(polygon: Sequence) -> Column:
    """A driver-side polygon (rings of (x, y)) as a column."""
    rings = [F.array(*(F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y")) for p in r)) for r in polygon]
    return F.array(*rings)


# -- the driver's side -------------------------------------------------------


def as_polygons(polygon: object) -> list[list[list[tuple[float, float]]]]:
    """A polygon (rings) or several, as a list of polygons with float points; a ring alone counts as a shell."""
    bad = ValueError("polygon must be a Polygon or MultiPolygon: rings of (x, y) points, or a list of such.")
    if isinstance(polygon, (str, bytes)) or not isinstance(polygon, Sequence):
        raise bad
    if not len(polygon):
        raise ValueError("polygon must be non-empty.")

    def depth(v: object) -> int:
        if isinstance(v, (str, bytes)):
            raise bad
        return 1 + depth(v[0]) if isinstance(v, Sequence) and len(v) else 0

    k = depth(polygon)
    if k not in (2, 3, 4):
        raise bad
    many = [[polygon]] if k == 2 else [polygon] if k == 3 else polygon
    try:
        return [[[(float(x), float(y)) for x, y in ring] for ring in rings] for rings in many]
    except (TypeError, ValueError):
        raise bad from None


def ring_area(ring: Sequence[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]]))) / 2


def polygon_area(rings: Sequence) -> float:
    return ring_area(rings[0]) - sum(map(ring_area, rings[1:])) if rings else 0.0


def clip(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A ring cut to a rectangle, side by side."""
    for axis, bound, keep_above in ((0, box[0], True), (1, box[1], True), (0, box[2], False), (1, box[3], False)):
        inside = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound  # noqa: B023, E731
        out: list[tuple[float, float]] = []
        for p, q in zip(ring, [*ring[1:], *ring[:1]]):
            if inside(p):
                out.append(p)
            if inside(p) != inside(q):
                t = (bound - p[axis]) / (q[axis] - p[axis])
                cut = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                cut[axis] = bound
                out.append((cut[0], cut[1]))
        ring = out
    return ring


def finite(v: float) -> bool:
    return math.isfinite(v)
