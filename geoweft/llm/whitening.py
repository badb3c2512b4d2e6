"""Embedding whitening by principal components.

An entry c of a vector counts as the whole number floor(64 c) + 1000000. The
covariance is that of the distinct vectors, each once: n of them with sums S. Their
exactly centred rows n x - S go into MLlib's RowMatrix as they are, whole numbers;
its Gramian over n, and over n twice more for the rows' factor, is the covariance.
Its eigenvectors are found on the driver, which holds sums and a matrix of the
dimension only, and are broadcast to project all rows in Arrow batches.

Rows without a vector, with an empty one, or with a null or non-finite entry or one
beyond 2**56 have no result, and neither do rows of another length than most
distinct vectors have (of equally frequent lengths the smallest counts). Repeated
rows each have theirs, with an id or without. Components whose variance isn't
above rounding have whitened null; of vectors that are all equal, explained and
identity_error are null too. A deviation beyond a long is null. Further columns are
ignored, and a table without such rows has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Scratch, ship

#: Entries are whole multiples of 1/STEPS; OFFSET is added to each.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond have no long.
MOST = float(1 << 56)


def whole(vectors: Column) -> Column:
    """The vector in whole numbers; null if it is missing, empty or has an entry that has none."""
    c = vectors.cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > MOST))
    return F.when((F.size(c) > 0) & ~bad, F.transform(c, lambda v: F.floor(v * STEPS).cast("long") + OFFSET))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and each of the first components."""
    spark = ship(table.sparkSession)
    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), whole(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    scratch = Scratch(spark)
    every = fit = scratch.write(rows.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        scratch.forget(every)
        return spark.createDataFrame([], rows.select("vec_id").schema.simpleString()[7:-1].replace(":", " ") + ", component int, n long, deviation long, whitened double, explained double, identity_error double")
    size, n = lengths
    fit = fit.where(F.size("x") == size)
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(19,0)"))).collect()
    total = [int(s) for _, s in sorted(sums)]
    middle, rest = [s // n for s in total], [s % n for s in total]
    # n x - S = n (x - middle) - rest, in numbers as small as the spread of the entries
    away = F.zip_with("x", F.array(*map(F.lit, middle)), lambda v, m: v - m)
    scaled = F.zip_with(away, F.array(*map(F.lit, rest)), lambda v, r: F.try_subtract(F.try_multiply(F.lit(n), v), r))
    centred = F.zip_with(away, F.array(*map(F.lit, rest)), lambda v, r: F.lit(float(n)) * v.cast("double") - r.cast("double"))
    values, vectors = principal(fit.select(centred.alias("v")), n)
    top = min(components, size)
    kept = values > values[0] * size * np.finfo(float).eps * 8 if values[0] > 0 else np.zeros(size, bool)
    scale = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), np.nan)[:top]
    whitener = spark.sparkContext.broadcast(vectors[:, :top] * scale / n)
    error = identity_error(project(fit.select(centred.alias("v")), whitener, top), n, int(kept[:top].sum()))
    scratch.forget(every)
    square = F.aggregate(scaled, F.lit(0).cast("long"), lambda acc, v: F.try_add(acc, F.try_multiply(v, v)))
    ready = rows.where(F.size("x") == size).select("vec_id", square.alias("deviation"), centred.alias("v"))
    share = [float(v / values.sum()) if values.sum() > 0 else None for v in values[:top]]
    out = project(ready, whitener, top).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"),
        F.element_at(F.array(*map(F.lit, share)).cast("array<double>"), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def principal(centred: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, in columns, of the covariance of rows n times as large as they are."""
    ml = centred.select(array_to_vector("v").alias("v"))
    gramian = RowMatrix(MLUtils.convertVectorColumnsFromML(ml, "v")).computeGramianMatrix().toArray()
    values, vectors = np.linalg.eigh(gramian / n / n / n)
    return np.maximum(values[::-1], 0.0), vectors[:, ::-1]


def project(rows: DataFrame, whitener: object, top: int) -> DataFrame:
    """The other columns, and the row ``v`` in whitened components ``w``."""
    others = [f for f in rows.schema.fields if f.name != "v"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others) + "w array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            w = np.stack(part["v"].to_numpy()) @ whitener.value if len(part) else np.empty((0, top))
            yield part.drop(columns="v").assign(w=list(w))

    return rows.mapInPandas(run, schema)


def identity_error(whitened: DataFrame, n: int, kept: int) -> float | None:
    """The largest entry by which the covariance of rows ``w`` is off the identity, over their first ``kept`` components: sums of each task meet by place."""
    if not kept:
        return None

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, mean = np.zeros((kept, kept)), np.zeros(kept)
        for part in batches:
            if len(part):
                w = np.stack(part["w"].to_numpy())[:, :kept]
                gram, mean = gram + w.T @ w, mean + w.sum(axis=0)
        every = np.vstack([gram, mean])
        i, j = np.indices(every.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": every.ravel()})

    found = np.zeros((kept + 1, kept))
    for i, j, v in whitened.mapInPandas(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        found[i, j] = v / n
    return float(np.abs(found[:kept] - np.outer(found[kept], found[kept]) - np.eye(kept)).max())
