"""Targets of rewiring by draws that go where the decay is."""

import numpy as np

from geoweft.operators import small_world
from pyspark.sql import functions as F


def test_draws_find_near_targets_among_many_far_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    xy = np.concatenate((rng.uniform(0, 10, (40, 2)), rng.uniform(9e5, 1e6, (3000, 2))))  # a uniform draw of the first 40 is one of 76
    nodes = spark.createDataFrame([(k, float(x), float(y), k % 2) for k, (x, y) in enumerate(xy)], "node_pos long, x double, y double, a_g long")
    events = spark.createDataFrame([(k % 2, 5, r) for r in range(1, 101) for k in range(2)], "i long, j long, rank long")
    monkeypatch.setattr(small_world, "rewiring_choices", None)
    rows, saved = [], small_world.saved
    monkeypatch.setattr(small_world, "saved", lambda df: rows.append(saved(df)) or rows[-1])
    found = small_world.drawn_choices(events, nodes, len(xy), 3, 1 / 4, F.col("u_g") != F.col("v_g"), ["g"], 7, True, 15).toPandas()
    assert len(found.groupby(["i", "rank"])) == 200 and found.groupby(["i", "rank"])["c"].nunique().min() >= 15
    assert ((found["i"] + found["c"]) % 2 == 1).all() and not found.duplicated(["i", "rank", "at"]).any()
    for i in (0, 1):
        d = np.sqrt(((xy[i] - xy) ** 2).sum(axis=1))
        q = np.where(d < 4, 1.0, 1 / np.maximum(d / 4, 1e-9) ** 3) * ((np.arange(len(xy)) + i) % 2)
        # draws with ``at`` below any stop are all there, so their law is that of the decay
        some = found[(found["i"] == i) & (found["at"] < 25)]["c"]
        assert len(some) > 400 and np.abs(np.bincount(some, minlength=len(xy)) / len(some) - q / q.sum()).max() < 0.04
    assert max(t.count() for t in rows) < 50_000
