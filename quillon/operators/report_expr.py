"""Report expressions: arithmetic, comparisons, c ? a : b, functions and scope aggregates.

An expression is parsed into a small tree. Its scope aggregates (Sum, Avg, Min, Max, Count, First,
Last over the rows of a group, or of the whole table) are computed by aggregation and joined back, so
``revenue / Sum(revenue)`` gathers no group in one task; the rest is a built-in column expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|'((?:[^']|'')*)'|([A-Za-z_]\w*)|(&&|\|\||==|!=|<>|<=|>=|.))", re.DOTALL)
_LEVELS = (("||",), ("&&",), ("==", "=", "!=", "<>"), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last}


class Bad(ValueError):
    """An expression that can't be read."""


class _Parser:
    def __init__(self, text: str):
        self.found = [m.groups() for m in _TOKEN.finditer(text.strip())]
        self.at = 0

    def sign(self, *signs: str) -> str | None:
        if self.at < len(self.found) and self.found[self.at][3] in signs:
            self.at += 1
            return self.found[self.at - 1][3]
        return None

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.found):
            raise Bad(f"unexpected {next(x for x in self.found[self.at] if x)}")
        return tree

    def choice(self) -> tuple:
        test = self.binary(0)
        if self.sign("?"):
            yes = self.choice()
            if not self.sign(":"):
                raise Bad("a ? without its :")
            return ("?", test, yes, self.choice())
        return test

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.sign(*_LEVELS[level]):
            left = (op, left, self.binary(level + 1))
        return left

    def unary(self) -> tuple:
        if op := self.sign("-", "!"):
            return ("neg" if op == "-" else "not", self.unary())
        if self.sign("("):
            inner = self.choice()
            if not self.sign(")"):
                raise Bad("a ( without its )")
            return inner
        if self.at >= len(self.found):
            raise Bad("the expression ends too soon")
        number, text, name, other = self.found[self.at]
        self.at += 1
        if number:
            return ("lit", float(number) if "." in number else int(number))
        if name is None and other is None:
            return ("lit", (text or "").replace("''", "'"))
        if name is None:
            raise Bad(f"unexpected {other}")
        if not self.sign("("):
            return ("col", name)
        args = []
        while not self.sign(")"):
            args.append(self.choice())
            if not self.sign(",") and not (self.at < len(self.found) and self.found[self.at][3] == ")"):
                raise Bad(f"{name}( without its )")
        return ("call", name.lower(), args)


def _aggregates(tree) -> list[tuple]:
    if not isinstance(tree, tuple):
        return [a for x in tree for a in _aggregates(x)] if isinstance(tree, list) else []
    if tree[0] == "call" and tree[1] in _AGGREGATES:
        return [tree]
    return [a for x in tree[1:] for a in _aggregates(x)]


def _column(tree: tuple, names: dict[str, str]) -> Column:
    op = tree[0]
    if op == "lit":
        return F.lit(tree[1])
    if op == "col":
        return F.col(tree[1])
    if op == "call":
        if repr(tree) in names:
            return F.col(names[repr(tree)])
        return _function(tree[1], [_column(a, names) for a in tree[2]], tree[2])
    x = [_column(a, names) for a in tree[1:]]
    if op == "?":
        return F.when(x[0], x[1]).otherwise(x[2])
    if op == "neg":
        return -x[0]
    if op == "not":
        return ~x[0]
    return {
        "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "%": lambda a, b: F.try_mod(a, b),
        "==": lambda a, b: a == b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "&&": lambda a, b: a & b, "||": lambda a, b: a | b,
    }[op](*x)


def _function(name: str, x: list[Column], trees: list[tuple]) -> Column:
    if name == "format":
        digits = len(str(trees[1][1]).partition(".")[2]) if len(trees) > 1 and trees[1][0] == "lit" else 0
        return F.format_number(x[0], digits)
    simple = {
        "upper": F.upper, "lower": F.lower, "trim": F.trim, "len": F.length, "abs": F.abs, "coalesce": F.coalesce, "iif": lambda c, a, b: F.when(c, a).otherwise(b),
        "round": lambda v, d=None: F.round(v, trees[1][1] if len(trees) > 1 else 0), "substring": lambda s, p, n: F.call_function("substring", s, p, n),
    }
    if name not in simple:
        raise Bad(f"no such function: {name}")
    return simple[name](*x)


def with_expression(df: DataFrame, name: str, text: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds a report expression's value; its aggregates are over ``scope`` (nothing: the whole table)."""
    tree = _Parser(text).whole()
    found = {repr(a): a for a in _aggregates(tree)}
    if not found:
        return df.withColumn(name, _column(tree, {}))
    names = {key: f"__agg{i}" for i, key in enumerate(found)}
    measures = [_AGGREGATES[a[1]](_column(a[2][0], {}) if a[2] else F.lit(1)).alias(names[key]) for key, a in found.items()]
    if scope:
        sums = df.groupBy(*(F.col(c).alias(f"__{i}") for i, c in enumerate(scope))).agg(*measures)
        both = df.join(sums, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(scope)])
    else:
        both = df.join(F.broadcast(df.agg(*measures)))  # an ungrouped aggregate is one row
    return both.withColumn(name, _column(tree, names)).select(*(c for c in df.columns if c != name), name)
