"""Constraints as columns, from their source.

A lambda or a function of one return statement may spell a condition on two rows
as Python does: ``and``, ``or``, ``not``, chained comparisons, ``in``, conditional
expressions, ``is None``. Those don't work on columns, so the syntax tree is read
and each construct is put as the column that means the same; names are those of
the function's own surroundings. What has no column, or whose value Python would
take for true or false by other rules than a column's, isn't translated.
"""

from __future__ import annotations

import ast
import inspect
import operator
import re
import textwrap
from collections.abc import Callable, Iterator
from functools import reduce
from types import CodeType

from pyspark.sql import Column
from pyspark.sql import functions as F


class Untranslatable(Exception):
    pass


COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
BITS = {ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
#: Methods of strings, and functions, by what they are for columns; whether they give a truth value.
METHODS = {"lower": (F.lower, False), "upper": (F.upper, False), "startswith": (F.startswith, True), "endswith": (F.endswith, True)}
FUNCTIONS = {"abs": (F.abs, False), "len": (F.char_length, False), "min": (F.least, False), "max": (F.greatest, False)}


def _codes(code: CodeType) -> tuple:
    """What a function does, without where it stands."""
    return code.co_code, code.co_names, tuple(_codes(c) if isinstance(c, CodeType) else (type(c).__name__, c) for c in code.co_consts)


def _inner(code: CodeType) -> CodeType:
    return next(c for c in code.co_consts if isinstance(c, CodeType))


def _trees(text: str) -> Iterator[ast.AST]:
    """What of a source can be parsed: all of it, or each lambda in it as far as it goes, since it may stand within a call or a list."""
    try:
        yield ast.parse(text)
        return
    except SyntaxError:
        pass
    for start in (m.start() for m in re.finditer(r"\blambda\b", text)):
        for end in range(len(text), start, -1):
            try:
                yield ast.parse(f"({text[start:end]})")
                break
            except SyntaxError:
                continue


def tree_of(function: Callable) -> tuple[list[str], ast.expr]:
    """Parameter names and the expression that a function returns."""
    try:
        text = textwrap.dedent(inspect.getsource(function))
    except (OSError, TypeError):
        raise Untranslatable from None
    found = []
    for node in (n for t in _trees(text) for n in ast.walk(t)):
        if isinstance(node, ast.Lambda):
            # compiled within a function of its free names, so that they are such again
            free = ast.arguments([], [ast.arg(n) for n in function.__code__.co_freevars], None, [], [], None, [])
            outer = compile(ast.fix_missing_locations(ast.Expression(ast.Lambda(free, node))), "<constraint>", "eval")
            inner = _inner(_inner(outer))
            if _codes(inner) == _codes(function.__code__):
                found.append((node.args, node.body))
        elif isinstance(node, ast.FunctionDef) and node.name == function.__name__:
            body = [n for n in node.body if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant))]
            if len(body) == 1 and isinstance(body[0], ast.Return) and body[0].value is not None:
                found.append((node.args, body[0].value))
    if len({ast.dump(body) for _, body in found}) != 1:
        raise Untranslatable
    args, body = found[0]
    if len(args.args) != 2 or args.vararg or args.kwarg or args.kwonlyargs or args.defaults:
        raise Untranslatable
    return [a.arg for a in args.args], body


class Reader:
    """Reads an expression as (value, whether it is a truth value); a value is a column or a plain Python value."""

    def __init__(self, sides: dict[str, object], names: dict[str, object]):
        self.sides, self.names = sides, names

    def read(self, node: ast.expr) -> tuple[object, bool]:
        method = getattr(self, f"of_{type(node).__name__}", None)
        if method is None:
            raise Untranslatable
        return method(node)

    def truth(self, node: ast.expr) -> Column:
        value, is_truth = self.read(node)
        if not is_truth:
            raise Untranslatable
        return value if isinstance(value, Column) else F.lit(value)

    def value(self, node: ast.expr) -> object:
        return self.read(node)[0]

    def of_Constant(self, node: ast.Constant) -> tuple[object, bool]:
        return node.value, isinstance(node.value, bool)

    def of_Name(self, node: ast.Name) -> tuple[object, bool]:
        if node.id not in self.names:
            raise Untranslatable
        value = self.names[node.id]
        if not isinstance(value, (bool, int, float, str, type(None), tuple, list, set, frozenset, dict)):
            raise Untranslatable
        return value, isinstance(value, bool)

    def _cell(self, node: ast.expr, name: object) -> tuple[object, bool]:
        if not isinstance(node, ast.Name) or node.id not in self.sides or not isinstance(name, str):
            raise Untranslatable
        return self.sides[node.id][name], False

    def of_Attribute(self, node: ast.Attribute) -> tuple[object, bool]:
        return self._cell(node.value, node.attr)

    def of_Subscript(self, node: ast.Subscript) -> tuple[object, bool]:
        if isinstance(node.value, ast.Name) and node.value.id in self.sides:
            return self._cell(node.value, self.value(node.slice))
        held, at = self.value(node.value), self.value(node.slice)
        if isinstance(held, Column) or isinstance(at, Column):
            raise Untranslatable
        return held[at], isinstance(held[at], bool)

    def _list(self, node: ast.List) -> tuple[object, bool]:
        return [self.value(e) for e in node.elts], False

    of_List = of_Tuple = of_Set = _list

    def of_BoolOp(self, node: ast.BoolOp) -> tuple[object, bool]:
        join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        return reduce(join, map(self.truth, node.values)), True

    def of_UnaryOp(self, node: ast.UnaryOp) -> tuple[object, bool]:
        if isinstance(node.op, ast.Not):
            return ~self.truth(node.operand), True
        if isinstance(node.op, ast.USub):
            return -self.value(node.operand), False
        raise Untranslatable

    def of_BinOp(self, node: ast.BinOp) -> tuple[object, bool]:
        kind = type(node.op)
        if kind in BITS:
            return BITS[kind](self.truth(node.left), self.truth(node.right)), True
        if kind not in ARITHMETIC:
            raise Untranslatable
        return ARITHMETIC[kind](self.value(node.left), self.value(node.right)), False

    def of_Compare(self, node: ast.Compare) -> tuple[object, bool]:
        out, left = [], self.value(node.left)
        for op, right_node in zip(node.ops, node.comparators):
            right = self.value(right_node)
            out.append(self._compared(op, left, right))
            left = right
        return reduce(operator.and_, out), True

    def _compared(self, op: ast.cmpop, left: object, right: object) -> object:
        kind = type(op)
        if kind in (ast.Is, ast.IsNot):
            if right is not None or not isinstance(left, Column):
                raise Untranslatable
            return left.isNull() if kind is ast.Is else left.isNotNull()
        if kind in (ast.In, ast.NotIn):
            if isinstance(right, (Column, str)):
                raise Untranslatable
            among = list(right)
            if isinstance(left, Column):
                found = left.isin(among) if among else F.lit(False)
            else:
                found = reduce(operator.or_, [F.lit(left) == x for x in among], F.lit(False))
            return found if kind is ast.In else ~found
        if (left is None or right is None) or kind not in COMPARE:
            raise Untranslatable
        found = COMPARE[kind](left, right)
        return found if isinstance(found, Column) else F.lit(bool(found))

    def of_IfExp(self, node: ast.IfExp) -> tuple[object, bool]:
        (a, x), (b, y) = self.read(node.body), self.read(node.orelse)
        return F.when(F.coalesce(self.truth(node.test), F.lit(False)), a).otherwise(b), x and y

    def of_Call(self, node: ast.Call) -> tuple[object, bool]:
        args = [self.value(a) for a in node.args]
        if node.keywords:
            raise Untranslatable
        if isinstance(node.func, ast.Attribute) and node.func.attr in METHODS:
            call, truth = METHODS[node.func.attr]
            held = self.value(node.func.value)
            if not isinstance(held, Column):
                raise Untranslatable
            args = [held, *args]
        elif isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and node.func.id not in self.names:
            call, truth = FUNCTIONS[node.func.id]
        else:
            raise Untranslatable
        return call(*(a if isinstance(a, Column) else F.lit(a) for a in args)), truth


def translated(function: Callable, this: object, that: object) -> Column | None:
    """The condition of a function of two rows as a column of ``this`` and ``that``; None if it isn't one that can be put so."""
    try:
        (u, v), body = tree_of(function)
        around = inspect.getclosurevars(function)
        names = {**around.globals, **around.nonlocals}
        return Reader({u: this, v: that}, names).truth(body)
    except (Untranslatable, TypeError, ValueError, KeyError, AttributeError, IndexError):
        return None
