"""Geometries as others write them, by column expressions: well-known binary and text, and GeoJSON.

A geometry is a point struct, or arrays of such, as in ``geometry``: a line, a
polygon (rings, the shell first) or several polygons. Rings are closed when
written; those read keep their closing point. Well-known binary is read in either
byte order, with or without a reference system (extended or ISO), with z and m left
out; it is written little-endian. A geometry of another kind, and what isn't a
geometry at all, reads as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweft.functions.geometry import POINT, SHAPES, let

# The codes and names of the kinds.
CODES = {"point": 1, "line": 2, "polygon": 3, "polygons": 6}
NAMES = {"point": "Point", "line": "LineString", "polygon": "Polygon", "polygons": "MultiPolygon"}


def _struct(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _closed(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (ring[0] != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def closed(geometry: Column, shape: str) -> Column:
    """The geometry with all rings closed."""
    if shape == "polygon":
        return F.transform(geometry, _closed)
    if shape == "polygons":
        return F.transform(geometry, lambda p: F.transform(p, _closed))
    return geometry


# -- GeoJSON -----------------------------------------------------------------------


def _pairs(geometry: Column, depth: int) -> Column:
    return F.transform(geometry, lambda g: _pairs(g, depth - 1)) if depth else F.array(geometry["x"], geometry["y"])


def _points(pairs: Column, depth: int) -> Column:
    return F.transform(pairs, lambda p: _points(p, depth - 1)) if depth else _struct(F.get(pairs, F.lit(0)), F.get(pairs, F.lit(1)))


def to_geojson(geometry: Column, shape: str) -> Column:
    """A GeoJSON geometry object as text."""
    made = F.struct(F.lit(NAMES[shape]).alias("type"), _pairs(closed(geometry, shape), SHAPES.index(shape)).alias("coordinates"))
    return F.when(geometry.isNotNull(), F.to_json(made))


def from_geojson(text: Column, shape: str) -> Column:
    """The geometry of a GeoJSON geometry or feature of this kind."""
    depth = SHAPES.index(shape)
    kind = "array<" * (depth + 1) + "double" + ">" * (depth + 1)
    plain = F.from_json(text, f"type string, coordinates {kind}")
    feature = F.from_json(text, f"type string, geometry struct<type string, coordinates {kind}>")["geometry"]
    read = lambda g: F.when(g["type"] == NAMES[shape], _points(g["coordinates"], depth))
    return F.coalesce(read(plain), read(feature))


# -- well-known text -------------------------------------------------------------


def to_wkt(geometry: Column, shape: str) -> Column:
    def text(g: Column, depth: int) -> Column:
        if not depth:
            return F.concat_ws(" ", g["x"].cast("string"), g["y"].cast("string"))
        return F.concat(F.lit("("), F.array_join(F.transform(g, lambda x: text(x, depth - 1)), ", "), F.lit(")"))

    g, depth = closed(geometry, shape), SHAPES.index(shape)
    body = text(g, depth) if depth else F.concat(F.lit("("), text(g, 0), F.lit(")"))
    some = F.size(g) > 0 if depth else g["x"].isNotNull()
    return F.when(geometry.isNotNull(), F.concat(F.lit(NAMES[shape].upper() + " "), F.when(some, body).otherwise("EMPTY")))


# -- well-known binary: as hexadecimal digits, two a byte ------------------------------


def _turned(digits: Column, n: int) -> Column:
    """The bytes of n bytes in hexadecimal, last first."""
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))))


def _double(digits: Column) -> Column:
    """The double of 16 big-endian hexadecimal digits."""
    number = lambda d, a, n: F.conv(F.substring(d, a, n), 16, 10).cast("long")
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))

    def of(v: Column) -> Column:
        head, tail = v["head"], v["tail"]
        exponent = head % 2048
        fraction = tail.cast("double") / F.lit(float(1 << 52))
        value = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise((1 + fraction) * power(exponent - 1023))
        value = F.when(exponent == 2047, F.when(tail == 0, float("inf")).otherwise(float("nan"))).otherwise(value)
        return F.when(head >= 2048, -value).otherwise(value)

    return let(digits, lambda d: let(F.struct(number(d, 1, 3).alias("head"), number(d, 4, 13).alias("tail")), of))


def _digits(value: Column) -> Column:
    """The 16 little-endian hexadecimal digits of a double; numbers below 2**-1022 become 0."""
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # the logarithm may be off by one next to a power of two
    exact = lambda s, g: F.when(s < power(g), g - 1).when(s / 2 >= power(g), g + 1).otherwise(g)

    def of(v: Column, e: Column) -> Column:
        tail = ((F.abs(v) / power(e) - 1) * F.lit(float(1 << 52))).cast("long")
        head = F.when(v < 0, 2048).otherwise(0) + (e + 1023)
        big = F.concat(F.lpad(F.hex(head.cast("long")), 3, "0"), F.lpad(F.hex(tail), 13, "0"))
        return let(big, lambda b: _turned(b, 8))

    some = lambda v: let(F.floor(F.log2(F.abs(v))), lambda g: let(exact(F.abs(v), g), lambda e: of(v, e)))
    return let(value, lambda v: F.when(F.abs(v) < F.lit(2.0**-1022), F.lit("0" * 16)).otherwise(some(v)))


def _count(n: Column) -> Column:
    return _turned(F.lpad(F.hex(n.cast("long")), 8, "0"), 4)


def to_wkb(geometry: Column, shape: str) -> Column:
    """Well-known binary; null for a null geometry."""

    def many(g: Column, of: object) -> Column:
        return F.concat(_count(F.size(g)), F.array_join(F.transform(g, of), ""))

    point = lambda p: F.concat(_digits(p["x"].cast("double")), _digits(p["y"].cast("double")))
    head = lambda s: F.lit("01" + CODES[s].to_bytes(4, "little").hex())
    polygon = lambda rings: F.concat(head("polygon"), many(rings, lambda r: many(r, point)))
    g = closed(geometry, shape)
    body = {"point": lambda: F.concat(head("point"), point(g)), "line": lambda: F.concat(head("line"), many(g, point)), "polygon": lambda: polygon(g), "polygons": lambda: F.concat(head("polygons"), many(g, polygon))}[shape]()
    return F.when(geometry.isNotNull(), F.unhex(body))


def from_wkb(data: Column, shape: str) -> Column:
    """The geometry of well-known binary of this kind."""

    def read(digits: Column) -> Column:
        piece = lambda at, n: F.substr(digits, (2 * at + 1).cast("int"), F.lit(2 * n))
        turned = lambda raw, little, n: let(raw, lambda r: F.when(little, _turned(r, n)).otherwise(r))
        number = lambda at, little: F.conv(turned(piece(at, 4), little, 4), 16, 10).cast("long")
        double = lambda at, little: _double(turned(piece(at, 8), little, 8))
        upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda k: k < n)

        def about(at: Column, of: Callable[[Column], Column]) -> Column:
            """``of`` what the head of the geometry at a byte says: little (endian), kind, width (bytes of a point), start (of its contents)."""

            def said(v: Column) -> Column:
                iso = F.floor(v["raw"] % F.lit(1 << 28) / 1000)
                flag = lambda bit: v["raw"].bitwiseAND(F.lit(bit)) > 0
                more = (flag(0x80000000) | iso.isin(1, 3)).cast("int") + (flag(0x40000000) | iso.isin(2, 3)).cast("int")
                start = v["at"] + 5 + F.when(flag(0x20000000), 4).otherwise(0)
                return F.struct(v["little"].alias("little"), (v["raw"] % F.lit(1 << 28) % 1000).alias("kind"), (16 + 8 * more).cast("long").alias("width"), start.cast("long").alias("start"))

            raw = lambda v: F.struct(v["at"].alias("at"), v["little"].alias("little"), number(v["at"] + 1, v["little"]).alias("raw"))
            first = F.struct(at.cast("long").alias("at"), (piece(at, 1) == "01").alias("little"))
            return let(first, lambda v: let(raw(v), lambda w: let(said(w), of)))

        point = lambda at, little: _struct(double(at, little), double(at + 8, little))
        points = lambda at, n, a: F.transform(upto(n), lambda k: point(at + k * a["width"], a["little"]))

        def ring(state: Column, a: Column) -> Column:
            next_ = lambda n: F.struct((state["at"] + 4 + n * a["width"]).alias("at"), F.concat(state["rings"], F.array(points(state["at"] + 4, n, a))).alias("rings"))
            return let(number(state["at"], a["little"]), next_)

        def polygon(at: Column) -> Column:
            """struct<at, rings>: the polygon that starts at a byte, and where it ends."""
            first = lambda a: F.struct((a["start"] + 4).alias("at"), F.array().cast(f"array<array<{POINT}>>").alias("rings"))
            return about(at, lambda a: F.aggregate(upto(number(a["start"], a["little"])), first(a), lambda s, _: ring(s, a)))

        def polygons(a: Column) -> Column:
            step = lambda s, _: let(polygon(s["at"]), lambda p: F.struct(p["at"].alias("at"), F.concat(s["many"], F.array(p["rings"])).alias("many")))
            first = F.struct((a["start"] + 4).alias("at"), F.array().cast(f"array<array<array<{POINT}>>>").alias("many"))
            return F.aggregate(upto(number(a["start"], a["little"])), first, step)["many"]

        contents = {
            "point": lambda a: point(a["start"], a["little"]),
            "line": lambda a: let(number(a["start"], a["little"]), lambda n: points(a["start"] + 4, n, a)),
            "polygon": lambda a: polygon(F.lit(0))["rings"],
            "polygons": polygons,
        }[shape]
        return about(F.lit(0), lambda a: F.when(a["kind"] == CODES[shape], contents(a)))

    return F.when(F.length(data) >= 9, let(F.hex(data), read))
