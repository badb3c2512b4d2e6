"""Nearest points by tiles, whose pairs never leave a task."""

import numpy as np

from geoweft.operators import spatial


def test_pairs_of_tiles_stay_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE_CELLS", 2, raising=False)
    monkeypatch.setattr(spatial, "TILE_PAIRS", 900, raising=False)
    rng = np.random.default_rng(3)
    xy = np.round(np.concatenate((rng.uniform(0, 60, (300, 2)), [[400.0, 9.0], [402.0, 9.0], [5.0, 5.0], [5.0, 5.0]])))  # ties, and points far from all
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "node_pos long, x double, y double")
    seen, tiles = [], getattr(spatial, "_nearest", None)
    monkeypatch.setattr(spatial, "_nearest", lambda *args: seen.append(args) or tiles(*args), raising=False)
    found = spatial.knn_join(p, 4)
    want = []
    for i, at in enumerate(xy):
        d = np.sqrt(((at - xy) ** 2).sum(axis=1))
        want += [(i, int(j), float(d[j]), r + 1) for r, j in enumerate([j for j in np.lexsort((np.arange(len(xy)), d)) if j != i][:4])]
    assert sorted(map(tuple, found.select("node_pos", "nbr", "d", "rank").collect())) == sorted(want)
    assert len(seen) > 1
