"""Caps far below the number of hits: edges are made as turns come, not all of them."""

import numpy as np
import pytest

import geoweft as gw
from geoweft.operators import random_graph, resolve


@pytest.mark.parametrize(("fast", "cap", "scale"), [(False, 5, 100), (True, 3, 100), (False, 40, 15)])
def test_edges_by_turns_are_those_of_all_hits(spark, monkeypatch, fast, cap, scale):
    xy = np.random.default_rng(5).uniform(0, 1000, (230, 2))
    xy[:5] += 1e6  # nodes that hit hardly any others stay open
    df = spark.createDataFrame([(k, float(x), float(y), k % 7) for k, (x, y) in enumerate(xy)], "id long, x double, y double, g long")
    f = gw.GeoFrame(df, order=("id",), crs="EPSG:3857")
    made, hits = [], random_graph.hits
    monkeypatch.setattr(random_graph, "FEW_NODES", 100)
    monkeypatch.setattr(random_graph, "LEAST_RUN", 16)
    monkeypatch.setattr(resolve, "TURNS", 60, raising=False)
    monkeypatch.setattr(resolve, "AHEAD", 20, raising=False)
    monkeypatch.setattr(random_graph, "hits", lambda nodes, n, *args: made.append(n) or hits(nodes, n, *args))
    args = {"scaling_factor": 1 / scale, "id_col": "id", "random_state": 7, "fast": fast, "method": "exact", "constraint": lambda u, v: u.g <= v.g}
    edges = lambda g: sorted(map(tuple, g.edges.select("source", "target", "length").collect()))
    degree, want = [0] * 230, []
    own = random_graph.as_nodes(f, "id").select("node_pos", "x", "y", random_graph.F.col("g").alias("a_g"))
    predicate, need = random_graph.C.resolve(args["constraint"], ["id", "g"])
    for i, j, length, p, q in sorted(map(tuple, hits(own, 230, 3, 1 / scale, predicate, need, 7, fast).collect()), key=lambda r: r[3:]):
        if degree[i] < cap and degree[j] < cap:
            want.append((i, j, length))
            degree[i], degree[j] = degree[i] + 1, degree[j] + 1
    monkeypatch.setattr(random_graph, "CROWDED", 0, raising=False)
    made.clear()
    assert edges(gw.geo_erdos_renyi_network(f, max_degree=cap, **args)) == sorted(want)
    assert len(made) > 4
