"""Growth that hashes rows at a time."""

import hashlib

import numpy as np

from geoweft.functions import hashing


def test_growth_hashes_rows_at_a_time(monkeypatch):
    import pandas as pd

    from geoweft.operators.attachment import grow

    rng, calls, md5 = np.random.default_rng(2), [], hashlib.md5
    part = pd.DataFrame({"t": range(1500), "pos": range(1500), "px": rng.uniform(0, 100, 1500), "py": rng.uniform(0, 100, 1500)})
    monkeypatch.setattr(hashlib, "md5", lambda b: calls.append(1) or md5(b))
    got = grow(part, 2, 3, 0.1, 150, 7, None, [], False)
    assert len(got) == 1 + 2 * 1498 and len(calls) < 1500 * 1499 // 3
    degree, x, y, want = np.zeros(1500), part["px"].to_numpy(), part["py"].to_numpy(), [(1, 0)]
    degree[:2] = 1
    for t in range(2, 1000):
        d = np.sqrt((x[:t] - x[t]) ** 2 + (y[:t] - y[t]) ** 2)
        key = -np.log(1 - np.array([hashing.portable("ba", 7, t, j) for j in range(t)])) / ((degree[:t] + 1) * np.where(d < 10, 1, 1 / np.maximum(d * 0.1, 1e-9) ** 3))
        for j in np.argsort(key, kind="stable")[:2].tolist():
            want.append((t, j))
            degree[[t, j]] += 1
    assert [tuple(sorted(e)) for e in got[["i", "j"]].to_numpy().tolist()][: len(want)] == [tuple(sorted(e)) for e in want]


def test_growth_by_rounds_is_that_of_one_pass(spark, monkeypatch):
    import geoweft as gw
    from geoweft.operators import attachment

    xy = np.random.default_rng(6).uniform(0, 100, (900, 2))
    df = spark.createDataFrame([(k, float(x), float(y), None if k % 3 == 2 else "ab"[k % 3] if k % 7 else "c") for k, (x, y) in enumerate(xy)], "id long, x double, y double, g string")
    f = gw.GeoFrame(df, order=("id",), crs="EPSG:3857")
    args = [{"group": "g", "fast": False, "node_order": "x"}, {"max_degree": 64}]
    edges = lambda more: sorted(map(tuple, gw.geo_barabasi_albert_network(f, 3, id_col="id", scaling_factor=0.1, random_state=7, **more).edges.select("source", "target", "length").collect()))
    want = [edges(more) for more in args]
    monkeypatch.setattr(attachment, "FIRST", 100, raising=False)
    monkeypatch.setattr(attachment, "LEAST_RUN", 40, raising=False)
    passes, grow, decide = [], attachment.grow, attachment._attached

    def few(part, *more):
        assert len(part) <= 100  # whole graphs are no longer one pass
        return grow(part, *more)

    monkeypatch.setattr(attachment, "grow", few)
    monkeypatch.setattr(attachment, "_attached", lambda *more: passes.append(more) or decide(*more))
    assert [edges(more) for more in args] == want and len(passes) > 6
    monkeypatch.setattr(attachment, "foreseen", lambda degree, m: degree + m + 2)  # too little: rounds are cut
    before = len(passes)
    assert edges(args[1]) == want[1] and len(passes) - before > 6


def test_targets_are_looked_for_under_a_bound(monkeypatch):
    import pandas as pd

    from geoweft.operators import attachment

    rng, whole, uniforms = np.random.default_rng(3), [], hashing.Decimals.uniforms
    met = pd.DataFrame({"g": 0, "own": False, "t": range(2000), "px": rng.uniform(0, 100, 2000), "py": rng.uniform(0, 100, 2000), "deg": np.minimum(3 + rng.geometric(0.2, 2000), 64)})
    part = pd.concat((met[met["t"] >= 1900].assign(own=True), met))
    monkeypatch.setattr(hashing.Decimals, "uniforms", lambda self, *args, **more: whole.append(1) or uniforms(self, *args, **more))
    run = attachment._targets(3, 3, 0.1, 64, 7, False)
    got = run(part)
    assert not whole  # rows of all uniforms
    monkeypatch.setattr(attachment, "LUCK", -3)  # a bound of 0: all rows are made
    want = attachment._targets(3, 3, 0.1, 64, 7, False)(part)
    assert len(whole) == 100 and got.equals(want) and len(got) > 300
