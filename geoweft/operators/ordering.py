"""Orders of nodes, as (rank, node_pos)."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions.hashing import uniform
from geoweft.operators.frame import GeoFrame, as_nodes, numbered
from geoweft.operators.spatial import kernel_sums, knn_join


def _ranked(df: DataFrame, *order: object) -> DataFrame:
    return numbered(df, list(order), "rank").select("rank", "node_pos")


def _steady(value: Column) -> Column:
    """A positive number to 40 binary places of its own size: sums of other orders of the same terms come out alike."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(value)) - 40)
    return F.when(value > 0, F.rint(value / unit) * unit).otherwise(value)


def random_order(frame: GeoFrame, random_state: int | None = None, *, fast: bool = True) -> DataFrame:
    """A uniform permutation, a function of the seed and the nodes' positions."""
    seed = secrets.randbits(31) if random_state is None else int(random_state)
    nodes = as_nodes(frame).select("node_pos")
    return _ranked(nodes.withColumn("u", uniform("order", seed, "node_pos", fast=fast)), F.col("u"), F.col("node_pos"))


def attribute_order(frame: GeoFrame, by: str | list[str], *, ascending: bool | list[bool] = True, na_position: str = "last") -> DataFrame:
    """A stable sort by one or more columns; missing values stand last, or first if asked for."""
    names = [by] if isinstance(by, str) else list(by)
    for name in names:
        if name not in frame.df.columns:
            raise KeyError(name)
    if na_position not in ("first", "last"):
        raise ValueError(f"invalid na_position: {na_position}")
    up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(up) != len(names):
        raise ValueError("ascending must have one value for each column")
    make = {(True, "last"): F.asc_nulls_last, (False, "last"): F.desc_nulls_last, (True, "first"): F.asc_nulls_first, (False, "first"): F.desc_nulls_first}
    return _ranked(as_nodes(frame), *(make[u, na_position](n) for n, u in zip(names, up)), F.col("node_pos"))


def density_order_knn(frame: GeoFrame, k: int = 5) -> DataFrame:
    """Densest first: by the mean distance to the k nearest others."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if (n := frame.df.count()) <= k:
        raise ValueError(f"The number of nodes ({n}) must be greater than k ({k})")
    mean = knn_join(as_nodes(frame).select("node_pos", "x", "y"), k).groupBy("node_pos").agg(_steady(F.avg("d")).alias("mean"))
    return _ranked(mean, F.col("mean"), F.col("node_pos"))


def scale_of(frame: GeoFrame, rule: str, n: int) -> float:
    """A bandwidth by rule of thumb for two dimensions."""
    if rule == "scott":
        return n ** (-1 / 6)
    if rule == "silverman":
        return (n * (2 + 2) / 4) ** (-1 / 6)
    raise ValueError(f"Unknown bandwidth: {rule}. Use a number, 'scott' or 'silverman'.")


def density_order_kde(frame: GeoFrame, bandwidth: float | str = 1.0, kernel: str = "gaussian") -> DataFrame:
    """Densest first: by kernel density."""
    nodes = as_nodes(frame).select("node_pos", "x", "y")
    if isinstance(bandwidth, str):
        bandwidth = scale_of(frame, bandwidth, max(1, frame.df.count()))
    sums = kernel_sums(nodes, bandwidth, kernel).select("node_pos", _steady(F.col("density")).alias("density"))
    return _ranked(sums, F.desc("density"), F.col("node_pos"))


def density_order(frame: GeoFrame, method: str = "kde", **kwargs: object) -> DataFrame:
    """density_order_kde or density_order_knn by name, in any case."""
    makers = {"knn": density_order_knn, "kde": density_order_kde}
    if str(method).lower() not in makers:
        raise ValueError(f"Unknown density ordering method: {method}. Use 'knn' or 'kde'.")
    return makers[str(method).lower()](frame, **kwargs)
