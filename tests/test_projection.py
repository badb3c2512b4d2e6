"""Projections held against published control points and their own inverses."""

import math

import pytest
from pyspark.sql import functions as F

import geoweft as gw
from geoweft.functions.projection import Ellipsoid, Lambert, Mercator, TransverseMercator, system, transformed
from geoweft.operators.frame import GeoFrame

FOOT = 1200 / 3937
#: (projection, longitude, latitude, easting, northing, unit in metres): the worked examples of the EPSG's guidance note 7-2, and natural origins.
CONTROL = [
    (TransverseMercator(Ellipsoid(6377563.396, 299.32496), -2.0, 49.0, 0.9996012717, 400000.0, -100000.0), 0.5, 50.5, 577274.99, 69740.50, 1),
    (Lambert(Ellipsoid(6378206.4, 294.97869821), 27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2000000 * FOOT, 0.0), -96.0, 28.5, 2963503.91, 254759.80, FOOT),
    (Mercator(Ellipsoid(6377397.155, 299.15281), 110.0, 0.997, 3900000.0, 900000.0), 120.0, -3.0, 5009726.58, 569150.82, 1),
    (system(3857), -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, -11169055.58, 2800000.00, 1),
    (system("EPSG:2154"), 3.0, 46.5, 700000.0, 6600000.0, 1),
    (system("EPSG:3034"), 10.0, 52.0, 4000000.0, 2800000.0, 1),
    (system("EPSG:32633"), 15.0, 0.0, 500000.0, 0.0, 1),
    (system("urn:ogc:def:crs:EPSG::32733"), 15.0, 0.0, 500000.0, 1e7, 1),
]


@pytest.mark.parametrize("case", range(len(CONTROL)))
def test_control_points(spark, case):
    projection, lon, lat, east, north, unit = CONTROL[case]
    x, y = projection.forward(F.lit(lon), F.lit(lat))
    u, v = projection.inverse(F.lit(east * unit), F.lit(north * unit))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")).first()
    assert abs(r["x"] / unit - east) < 0.01 and abs(r["y"] / unit - north) < 0.01  # as many places as are published
    assert abs(r["u"] - lon) < 1e-7 and abs(r["v"] - lat) < 1e-7


@pytest.mark.parametrize(("crs", "lon", "span"), [("EPSG:32633", 15, 8), ("EPSG:25832", 9, 8), ("EPSG:32719", -69, 8), (3857, 0, 179), (3395, 0, 179), (2154, 3, 10), (3034, 10, 40), (3347, -92, 50), (9377, -73, 10), ("EPSG:26915", -93, 8)])
def test_round_trips(spark, crs, lon, span):
    lat = {"EPSG:32719": -40.0}.get(crs, 45.0)
    df = spark.range(400).select((lon + span * F.sin("id")).alias("x"), (lat + 30 * F.cos(F.col("id") * 7)).alias("y"))
    there = df.withColumn("p", transformed(F.struct("x", "y"), 4326, crs)).withColumn("q", transformed(F.col("p"), crs, 4326))
    worst = there.agg(F.max(F.abs(F.col("q.x") - F.col("x")) * 111320 * F.cos(F.radians("y"))), F.max(F.abs(F.col("q.y") - F.col("y")) * 111320)).first()
    assert max(worst) < 1e-3  # a millimetre


def test_transverse_mercator_keeps_small_lengths(spark):
    """On the central meridian the scale is k, and the length of the meridian from the equator to 45 degrees is known."""
    x, y = TransverseMercator(k=1.0).forward(F.lit(0.0), F.lit(45.0))
    assert abs(spark.range(1).select(y).first()[0] - 4984944.378) < 1e-3


def test_frames(spark):
    point = "struct<x:double,y:double>"
    f = GeoFrame(spark.createDataFrame([(1, 15.0, 0.0), (2, None, 1.0)], "id long, x double, y double"), order=("id",), crs="EPSG:4326")
    g = gw.to_crs(f, "EPSG:32633")
    assert g.crs == "EPSG:32633" and [tuple(r) for r in g.df.orderBy("id").select("x", "y").collect()][0] == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert g.df.where("id = 2").first()["x"] is None
    square = [[(15.0, 0.0), (16.0, 0.0), (16.0, 1.0)]]
    many = GeoFrame(spark.createDataFrame([(1, [square])], f"id long, geometry array<array<array<{point}>>>"), order=("id",), crs=4326)
    there = gw.to_crs(gw.to_crs(many, 32633), "OGC:CRS84").df.first()["geometry"]
    assert all(math.isclose(p["x"], q[0], abs_tol=1e-9) and math.isclose(p["y"], q[1], abs_tol=1e-9) for p, q in zip(there[0][0], square[0]))
    for crs in ("EPSG:27700", "nonsense", None, 4978):
        with pytest.raises(ValueError, match="reference system"):
            gw.to_crs(f, crs)
    with pytest.raises(ValueError, match="no CRS"):
        gw.to_crs(GeoFrame(f.df), 3857)
