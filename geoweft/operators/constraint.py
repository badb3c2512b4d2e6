"""User constraints on pairs of nodes.

A constraint's source is translated to a Column, which the optimizer places. Where
that can't be done, it is called once with two stand-ins for rows and may give a
Column itself; what has no column at all is run on rows in Arrow batches. As columns compare,
a missing value is neither equal to nor different from any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.operators.compiled import translated


class Side:
    """Stands for a row: ``side.name`` and ``side["name"]`` are columns with a prefix."""

    def __init__(self, prefix: str, names: list[str]):
        self._prefix, self._names, self.used = prefix, names, set()

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise KeyError(name)
        self.used.add(name)
        return F.col(f"{self._prefix}{name}")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


class Row:
    """A row's values under the same two spellings."""

    __slots__ = ("_v",)

    def __init__(self, values: dict):
        self._v = values

    def __getitem__(self, name: str) -> object:
        return self._v[name]

    def __getattr__(self, name: str) -> object:
        try:
            return self._v[name]
        except KeyError:
            raise AttributeError(name) from None


def classes(predicate: Column | None, this: str = "u_", that: str = "v_") -> list[str]:
    """The names in which two rows must agree by the predicate: its conjuncts that are an equality of the same column of both."""
    found, todo = [], [] if predicate is None else [str(predicate)[len("Column<'") : -len("'>")]]
    while todo:
        text = todo.pop()
        if text.startswith("coalesce(") and text.endswith(", false)"):
            todo.append(text[len("coalesce(") : -len(", false)")])
        elif text.startswith("and("):
            depth = 0
            for k, c in enumerate(text[4:-1], 4):
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    todo += [text[4:k], text[k + 2 : -1]]
                    break
        elif m := re.fullmatch(rf"=\((?:{this}(\w+), {that}\1|{that}(\w+), {this}\2)\)", text):
            found.append(m[1] or m[2])
    return sorted(set(found))


def resolve(constraint: Callable | None, names: list[str], this: str = "u_", that: str = "v_") -> tuple[Column | None, list[str]]:
    """The predicate over columns this+name and that+name, and the names it needs."""
    if constraint is None:
        return None, []
    u, v = Side(this, names), Side(that, names)
    found = translated(constraint, u, v)
    if found is None:
        u, v = Side(this, names), Side(that, names)
        try:
            found = constraint(u, v)
        except (PySparkException, TypeError, ValueError):
            found = None
    if isinstance(found, Column):
        return F.coalesce(found, F.lit(False)), sorted(u.used | v.used)
    if isinstance(found, bool) and not u.used | v.used:
        return F.lit(found), []
    need = sorted(u.used | v.used) or names

    def rows(batches):
        import pandas as pd

        for a, b in batches:
            yield pd.Series([bool(constraint(Row(x), Row(y))) for x, y in zip(a.to_dict("records"), b.to_dict("records"))])

    from collections.abc import Iterator

    import pandas as pd

    rows.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.DataFrame]], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(rows, T.BooleanType())
    side = lambda p, names: F.struct(*(F.col(f"{p}{n}").alias(n) for n in names))
    return udf(side(this, names), side(that, names)), names if need else names
