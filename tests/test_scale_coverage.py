"""Polygons as tables of sides."""

import inspect

from geoweft.operators import coverage


def test_polygon_as_a_table_of_sides(spark):
    sides = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 0.0), (0, 4.0, 0.0, 4.0, 4.0), (0, 4.0, 4.0, 0.0, 4.0), (0, 0.0, 4.0, 0.0, 0.0)], "polygon int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0), (3, 4.0, 2.0)], "id long, x double, y double")
    assert sorted(r["id"] for r in coverage.within_sides(points, sides, "polygon").collect()) == [1, 3]


def test_outline_of_customers_is_no_single_row():
    from geoweft.plans import catalog

    assert "collect_list" not in inspect.getsource(catalog.outline)
