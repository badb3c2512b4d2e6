"""Picks under tight caps: lists hold only nodes that have room, for some turns at a time."""

import warnings

import numpy as np
import pytest

import geoweft as gw
from geoweft.operators import resolve, small_world


@pytest.mark.parametrize(("cap", "by_rows", "odd"), [(5, False, False), (5, True, True)])
def test_picks_by_turns_are_those_of_whole_lists(spark, monkeypatch, cap, by_rows, odd):
    xy = np.random.default_rng(4).uniform(0, 100, (160, 2)).round()
    df = spark.createDataFrame([(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(xy)], "id long, x double, y double, g long")
    f = gw.GeoFrame(df, order=("id",), crs="EPSG:3857")
    degree, picked, want = [0] * 160, set(), []
    for i in range(160):
        d = np.sqrt(((xy[i] - xy) ** 2).sum(axis=1))
        got = 0
        for j in np.lexsort((np.arange(160), d)).tolist():
            if got < 2 and degree[i] < cap and j != i and degree[j] + 2 < cap and (j, i) not in picked and (not odd or i % 3 != j % 3):
                picked.add((i, j))
                want.append((min(i, j), max(i, j)))
                degree[i], degree[j], got = degree[i] + 1, degree[j] + 1, got + 1
    asked, search = [], small_world.knn_join
    monkeypatch.setattr(resolve, "LIST_ROWS", 400, raising=False)
    monkeypatch.setattr(resolve, "LISTED", 4, raising=False)
    if by_rows:  # lists would be longer than these bounds
        monkeypatch.setattr(small_world, "LONGER", 0, raising=False)
        monkeypatch.setattr(resolve, "WINDOW_ROWS", 250)
        monkeypatch.setattr(small_world, "TIGHT", 0, raising=False)

    def seen(points, k, *args):
        out = search(points, k, *args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(small_world, "knn_join", seen)
    with warnings.catch_warnings(record=True):
        g = gw.geo_watts_strogatz_network(f, 4, 0.0, max_degree=cap, id_col="id", random_state=1, scaling_factor=0.1, constraint=(lambda u, v: u.g != v.g) if odd else None)
        assert sorted(map(tuple, g.edges.select("source", "target").collect())) == sorted(want)
    assert len(want) < 320 and max(asked) <= 2000  # whole lists of nodes without room are more
