"""Geometries written and read again, held against bytes made by hand."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from geoweft.functions import formats

POINT = "struct<x:double,y:double>"
TYPES = {"point": POINT, "line": f"array<{POINT}>", "polygon": f"array<array<{POINT}>>", "polygons": f"array<array<array<{POINT}>>>"}
rng = random.Random(5)
NUMBERS = [0.0, 1.0, -1.0, 0.1, -1e300, 1e-300, 2.0**52 + 1, 1 / 3, -7.25, 2.0**-1022, math.nextafter(8.0, 0.0), math.nextafter(1.0, 2.0), 1e15 + 0.3]
NUMBERS += [rng.uniform(-1e7, 1e7) for _ in range(40)] + [rng.choice((-1, 1)) * 2.0 ** rng.uniform(-900, 900) for _ in range(60)]


def points(n):
    return [(rng.choice(NUMBERS), rng.choice(NUMBERS)) for _ in range(n)]


def ring(n):
    p = points(n)
    return [*p, p[0]]


GEOMETRIES = {
    "point": [*points(40), None],
    "line": [points(n) for n in (0, 1, 2, 30)] + [None],
    "polygon": [[ring(3)], [ring(4), ring(3), ring(20)], [], None],
    "polygons": [[[ring(3)]], [[ring(3), ring(4)], [ring(5)]], [], None],
}


def packed(g, shape, order="<", code=None, extra=()):
    """Well-known binary by struct, maybe with more coordinates a point."""
    flag = {"<": 1, ">": 0}[order]
    head = lambda s: struct.pack(order + "BI", flag, code or formats.CODES[s])
    number = lambda n: struct.pack(order + "I", n)
    point = lambda p: struct.pack(order + "d" * (2 + len(extra)), *p, *extra)
    line = lambda r: number(len(r)) + b"".join(map(point, r))
    polygon = lambda p: head("polygon") + number(len(p)) + b"".join(map(line, p))
    return {"point": lambda: head("point") + point(g), "line": lambda: head("line") + line(g), "polygon": lambda: polygon(g), "polygons": lambda: head("polygons") + number(len(g)) + b"".join(map(polygon, g))}[shape]()


def plain(g):
    if g is None:
        return None
    return (g["x"], g["y"]) if hasattr(g, "asDict") else [plain(x) for x in g]


@pytest.mark.parametrize("shape", list(TYPES))
def test_binary(spark, shape):
    rows = list(enumerate(GEOMETRIES[shape]))
    df = spark.createDataFrame(rows, f"id long, g {TYPES[shape]}").select("id", "g", formats.to_wkb(F.col("g"), shape).alias("b"))
    for r in df.withColumn("back", formats.from_wkb(F.col("b"), shape)).collect():
        want = rows[r["id"]][1]
        assert r["b"] == (None if want is None else packed(want, shape))
        assert plain(r["back"]) == want
    big = [(i, packed(g, shape, ">")) for i, g in rows if g is not None]
    extended = [(i, packed(g, shape, "<", 0x80000000 | formats.CODES[shape], (9.0,))) for i, g in rows if g is not None and shape in ("point", "line")]
    iso = [(i, packed(g, shape, ">", 3000 + formats.CODES[shape], (9.0, 8.0))) for i, g in rows if g is not None and shape in ("point", "line")]
    srid = [(i, struct.pack("<BII", 1, 0x20000000 | formats.CODES[shape], 4326) + packed(g, shape)[5:]) for i, g in rows if g is not None]
    for made in (big, extended, iso, srid):
        for r in spark.createDataFrame(made or [(0, b"")], "id long, b binary").select("id", formats.from_wkb(F.col("b"), shape).alias("g")).collect():
            assert not made or plain(r["g"]) == rows[r["id"]][1]
    other = packed((1.0, 2.0), "point") if shape != "point" else packed([(1.0, 2.0)], "line")
    odd = spark.createDataFrame([(other,), (b"",), (b"\x01",), (None,)], "b binary").select(formats.from_wkb(F.col("b"), shape).alias("g"))
    assert all(r["g"] is None for r in odd.collect())


@pytest.mark.parametrize("shape", list(TYPES))
def test_json_and_text(spark, shape):
    rows = list(enumerate(GEOMETRIES[shape]))
    df = spark.createDataFrame(rows, f"id long, g {TYPES[shape]}").select("id", formats.to_geojson(F.col("g"), shape).alias("j"), formats.to_wkt(F.col("g"), shape).alias("t"))
    deep = lambda g: [deep(x) for x in g] if isinstance(g, list) else list(g)
    for r in df.withColumn("back", formats.from_geojson(F.col("j"), shape)).collect():
        want = rows[r["id"]][1]
        assert (None if r["j"] is None else json.loads(r["j"])) == (None if want is None else {"type": formats.NAMES[shape], "coordinates": deep(want)})
        assert plain(r["back"]) == want
        assert (r["t"] is None) == (want is None) and (want is None or r["t"].startswith(formats.NAMES[shape].upper()))
    odd = ['{"type": "Feature", "properties": {}, "geometry": %s}' % json.dumps({"type": formats.NAMES[shape], "coordinates": deep(rows[0][1])}), '{"type": "Other"}', "x", None]
    got = [plain(r[0]) for r in spark.createDataFrame([(x,) for x in odd], "j string").select(formats.from_geojson(F.col("j"), shape)).collect()]
    assert got == [rows[0][1], None, None, None]


def test_rings_are_closed_when_written(spark):
    df = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]],)], f"g {TYPES['polygon']}")
    r = df.select(formats.to_wkt(F.col("g"), "polygon").alias("t"), formats.to_wkb(F.col("g"), "polygon").alias("b")).first()
    assert r["t"] == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))" and len(r["b"]) == 9 + 4 + 4 * 16
