"""Kernel sums in tasks."""

import numpy as np
import pytest

from geoweft.operators import spatial


@pytest.mark.parametrize("kernel", sorted(spatial.KERNELS))
def test_kernel_sums_over_crowded_cells(spark, kernel, monkeypatch):
    monkeypatch.setattr(spatial, "OWN", 20)
    rng = np.random.default_rng(3)
    xy = np.concatenate((rng.normal(0, 1, (150, 2)), rng.uniform(-40, 40, (150, 2)), np.zeros((9, 2))))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "node_pos long, x double, y double")
    sums = spatial.kernel_sums(points, 2.0, kernel)
    assert "MapInArrow" in sums._jdf.queryExecution().toString()  # pairs don't leave the tasks
    t = np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2)) / 2.0
    want = spatial.KERNELS[kernel][0](t).sum(axis=1)
    got = dict(map(tuple, sums.collect()))
    assert np.allclose([got[k] for k in range(len(xy))], want, rtol=1e-12)


@pytest.mark.parametrize("kernel, bandwidth", [("gaussian", 6.0), ("exponential", 0.4), ("exponential", 6.0)])
def test_kernel_sums_of_many_points_by_interpolation(spark, kernel, bandwidth, monkeypatch):
    from geoweft.operators import interpolated

    monkeypatch.setattr(interpolated, "LEAST", 1000)
    monkeypatch.setattr(interpolated, "LEAF", 20)
    rng = np.random.default_rng(4)
    xy = np.concatenate((rng.normal(0, 2, (1500, 2)), rng.uniform(-10, 10, (1500, 2)), np.full((5, 2), 9.0), [[40.0, -7.0]]))
    if kernel == "gaussian":  # a cell's nodes are fewer than its points
        xy = np.concatenate((np.repeat(xy, 15, axis=0) + rng.normal(0, 1e-3, (15 * len(xy), 2)), xy))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "node_pos long, x double, y double")
    asked = []
    by_cells = spatial.interpolated_sums
    monkeypatch.setattr(spatial, "interpolated_sums", lambda *args: asked.append(args[1]) or by_cells(*args))
    got = dict(map(tuple, spatial.kernel_sums(points, bandwidth, kernel).collect()))
    assert len(asked) == 1 and len(got) == len(xy)
    some = range(len(xy) - 1, 0, -(len(xy) // 400))
    t = np.sqrt(((xy[some][:, None] - xy) ** 2).sum(axis=2)) / bandwidth
    want = spatial.KERNELS[kernel][0](t).sum(axis=1)
    assert np.abs(np.array([got[k] for k in some]) / want - 1).max() < 5e-14
