"""Distance and its power-law decay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    x1, y1, x2, y2 = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2))
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def decay(d: Column, a: float, scaling_factor: float) -> Column:
    """1 below the least distance 1/s, (d*s)**-a from there on; whole exponents multiply, so that engines agree to the last bit."""
    d = d.cast("double")
    r = d * F.lit(float(scaling_factor))
    if float(a).is_integer() and 1 <= a <= 16:
        p = r
        for _ in range(int(a) - 1):
            p = p * r
        q = F.lit(1.0) / p
    else:
        q = F.pow(r, F.lit(-float(a)))
    return F.when(d < F.lit(1.0 / float(scaling_factor)), F.lit(1.0)).otherwise(q)


def decay_array(d: np.ndarray, a: float, scaling_factor: float) -> np.ndarray:
    d = np.asarray(d, float)
    r = d * scaling_factor
    with np.errstate(divide="ignore", over="ignore"):
        if float(a).is_integer() and 1 <= a <= 16:
            p = r.copy()
            for _ in range(int(a) - 1):
                p = p * r
            q = 1.0 / p
        else:
            q = r ** -float(a)
    return np.where(d < 1.0 / scaling_factor, 1.0, q)


def decay_sql(d: str, a: int, scaling_factor: float) -> str:
    """The same as DuckDB SQL, for whole exponents."""
    r = f"(({d}) * {scaling_factor!r}::DOUBLE)"
    return f"(CASE WHEN ({d}) < {1.0 / scaling_factor!r}::DOUBLE THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / ({' * '.join([r] * a)}) END)"
