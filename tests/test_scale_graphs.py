"""Random graphs whose pairs are hashed in tasks, and are made as they are read."""

import hashlib

import numpy as np
import pytest

import geoweft as gw
from geoweft.functions import hashing
from geoweft.operators import random_graph


@pytest.fixture()
def cloud(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1000, (700, 2)))], "id long, x double, y double")
    return gw.GeoFrame(df, order=("id",), crs="EPSG:3857")


@pytest.mark.parametrize("head, tail", [("er|7|5|", ""), ("er|-3|", "|99"), ("", ""), ("x" * 60, "")])
def test_uniforms_of_many_numbers_are_those_of_each(head, tail):
    numbers = np.array([0, 7, 9, 10, 99, *range(100, 900), 9_999, 10_000, 123_456_789, *range(10**9, 10**9 + 40_000)])
    want = [int(hashlib.md5(f"{head}{k}{tail}".encode()).hexdigest()[:13], 16) / 2**52 for k in numbers]
    some = hashing.Decimals(numbers)
    assert some.uniforms(head, tail).tolist() == want
    assert some.uniforms(head, tail, 500).tolist() == want[:500]
    bound = np.random.default_rng(1).random(len(numbers))
    assert some.below(head, tail, bound).tolist() == np.flatnonzero(want < bound).tolist()


def test_portable_random_graph_hashes_in_tasks_and_only_when_read(cloud, monkeypatch):
    monkeypatch.setattr(random_graph, "all_pairs", None)
    monkeypatch.setattr(random_graph, "LEAST_RUN", 50)
    g = gw.geo_erdos_renyi_network(cloud, scaling_factor=1 / 20, max_degree=1 << 30, id_col="id", random_state=7, fast=False, constraint=lambda u, v: u.x < v.x)
    xy = np.array([(r["x"], r["y"]) for r in cloud.df.orderBy("id").collect()])
    u, want = (lambda i, j: hashing.portable("er", 7, i, j)), set()
    for i in range(700):
        d = np.sqrt(((xy[i] - xy) ** 2).sum(axis=1))
        q = np.where(d < 20, 1.0, 1 / np.maximum(d / 20, 1e-9) ** 3)
        want |= {(i, j) for j in range(i + 1, 700) if (u(i, j) < q[j] and xy[i][0] < xy[j][0]) or (u(j, i) < q[j] and xy[j][0] < xy[i][0])}
    got = g.edges.select("source", "target").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    # nodes stand without edges being made
    assert "MapInArrow" not in g.nodes._jdf.queryExecution().toString()
    assert not g.edges.is_cached


def test_export_looks_for_missing_ends_only_where_there_may_be_any(cloud, monkeypatch):
    from geoweft.operators import export

    g = gw.geo_erdos_renyi_network(cloud, scaling_factor=1 / 20, id_col="id", random_state=7)
    asked = []
    monkeypatch.setattr(export, "_missing", lambda df, column, message: asked.append(column))
    gw.graph_to_tables(g, nodes=False)
    assert not asked
    gw.graph_to_tables(g.with_edges(g.edges), nodes=False)
    assert asked == ["source", "target"]


def test_trials_of_far_cells_are_placed_by_runs(spark, cloud, monkeypatch):
    monkeypatch.setattr(random_graph, "PLACED", 16, raising=False)
    made = random_graph._placed

    def placed(seed):
        run = made(seed)

        def checked(batches):
            for cells in batches:
                assert (cells["m"] * cells["k"]).max() <= 256  # two cells of a quarter of the width hold some 1,900 pairs
                yield from run(iter([cells]))

        return checked

    monkeypatch.setattr(random_graph, "_placed", placed)
    args = {"scaling_factor": 1 / 40, "max_degree": 1 << 30, "id_col": "id"}
    n = {m: [gw.geo_erdos_renyi_network(cloud, random_state=s, method=m, **args).edges.count() for s in range(3)] for m in ("exact", "thinned")}
    assert abs(sum(n["thinned"]) / sum(n["exact"]) - 1) < 0.05
    g = gw.geo_erdos_renyi_network(cloud, random_state=1, method="thinned", **args).edges
    assert g.count() == g.select("source", "target").distinct().count() == n["thinned"][1]
