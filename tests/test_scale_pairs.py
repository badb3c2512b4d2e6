"""All pairs of nodes in tasks."""

import numpy as np

import geoweft as gw
from geoweft.functions import hashing
from geoweft.operators import random_graph


def cloud(spark, n):
    xy = np.random.default_rng(8).uniform(0, 1000, (n, 2))
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    return gw.GeoFrame(df, order=("id",), crs="EPSG:3857")


def test_nodes_go_to_few_tasks_and_all_pairs_meet(spark, monkeypatch):
    for name, value in {"ROW": 50, "RUNS": 64, "LEAST_RUN": 1}.items():
        monkeypatch.setattr(random_graph, name, value)
    f, args = cloud(spark, 700), {"scaling_factor": 1 / 20, "max_degree": 1 << 30, "id_col": "id", "random_state": 7, "fast": False}
    got = set(map(tuple, gw.geo_erdos_renyi_network(f, **args).edges.select("source", "target").collect()))
    xy, want = np.array([(r["x"], r["y"]) for r in f.df.orderBy("id").collect()]), set()
    for i in range(700):
        d = np.sqrt(((xy[i] - xy) ** 2).sum(axis=1))
        q = np.where(d < 20, 1.0, 1 / np.maximum(d / 20, 1e-9) ** 3)
        want |= {(i, j) for j in range(i + 1, 700) if hashing.portable("er", 7, i, j) < q[j] or hashing.portable("er", 7, j, i) < q[j]}
    assert got == want

    def counted(*_, **__):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                zero, no = pa.array(np.zeros(b.num_rows, np.int64)), pa.array(np.zeros(b.num_rows, bool))
                yield pa.RecordBatch.from_arrays([zero, zero, zero.cast(pa.float64()), no, no], random_graph.HIT)

        return run

    monkeypatch.setattr(random_graph, "_tried", counted)
    own = gw.operators.frame.as_nodes(f, "id").select("node_pos", "x", "y")
    rows = random_graph.portable_hits(own, 700, 3, 1 / 20, None, [], 7).count()
    assert rows < 700 * 20  # with a run for each task a node went to 33 on the mean


def test_hashes_that_the_first_word_decides_go_no_further(monkeypatch):
    steps, stepped = [], hashing._stepped
    monkeypatch.setattr(hashing, "_stepped", lambda words, room, state, end: steps.append((len(room[0]), end)) or stepped(words, room, state, end))
    numbers = hashing.Decimals(np.arange(10_000, 20_000))
    found = numbers.below("er|7|", "|99", np.full(10_000, 0.01))
    assert found.tolist() == [k for k in range(10_000) if hashing.portable("er", 7, k + 10_000, 99) < 0.01]
    assert [e for n, e in steps if n == 10_000] == [61] and all(n < 200 for n, e in steps if e == 64)
