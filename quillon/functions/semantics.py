"""Operators of the embedded SQL dialect as Column builders.

Columns are statically typed; a builder says which operand types it takes. Results follow the
dialect: division by zero is NULL, integer division truncates, integer overflow becomes REAL, text
meets numbers through its numeric prefix, predicates are three-valued.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INT_MIN = -(1 << 63)
_NUMBER = r"^[ \t\n\x0b\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_INTEGER = r"^[ \t\n\x0b\f\r]*([+-]?[0-9]+)"


def as_int(flag: Column) -> Column:
    """A predicate as the dialect shows it: 1, 0 or NULL."""
    return flag.cast("int")


def truth(number: Column) -> Column:
    """Whether a number counts as true."""
    return number != 0


def real_prefix(text: Column) -> Column:
    """The REAL that a text begins with, 0.0 if none."""
    found = F.regexp_extract(text, _NUMBER, 1)
    return F.when(text.isNotNull(), F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(0.0)))


def integer_prefix(text: Column) -> Column:
    """The INTEGER that a text begins with, 0 if none; clamped to 64 bits."""
    found = F.regexp_extract(text, _INTEGER, 1)
    clamped = F.when(found.startswith("-"), F.lit(INT_MIN)).otherwise(F.lit(-(INT_MIN + 1)))
    return F.when(text.isNotNull(), F.when(found == "", F.lit(0).cast("long")).otherwise(F.coalesce(found.try_cast("long"), clamped)))


def truth_text(text: Column) -> Column:
    """Whether a text counts as true: by its numeric prefix."""
    return real_prefix(text) != 0


# Arithmetic. Integers: *_exact gives NULL on overflow and stays BIGINT; the plain form gives a REAL.
def add_exact(a: Column, b: Column) -> Column:
    return F.try_add(a.cast("long"), b.cast("long"))


def subtract_exact(a: Column, b: Column) -> Column:
    return F.try_subtract(a.cast("long"), b.cast("long"))


def multiply_exact(a: Column, b: Column) -> Column:
    return F.try_multiply(a.cast("long"), b.cast("long"))


def add(a: Column, b: Column) -> Column:
    """a + b of integers as a REAL: exact while it fits 64 bits, by doubles beyond."""
    return F.coalesce(add_exact(a, b).cast("double"), a.cast("double") + b.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(subtract_exact(a, b).cast("double"), a.cast("double") - b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(multiply_exact(a, b).cast("double"), a.cast("double") * b.cast("double"))


def no_nan(x: Column) -> Column:
    """NaN is NULL."""
    return F.when(~F.isnan(x), x)


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated; NULL for b = 0 and for the one quotient that doesn't fit."""
    a, b = a.cast("long"), b.cast("long")
    fits = (b != 0) & ~((a == F.lit(INT_MIN)) & (b == -1))
    safe = F.when(fits, b)
    # a less its remainder divides evenly; decimals hold the operands beyond 2^53.
    return F.when(fits, ((a - F.try_mod(a, safe)).cast("decimal(20,0)") / safe.cast("decimal(20,0)")).cast("long"))


def real_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Both operands truncated to integers; NULL for b = 0."""
    b = b.cast("long")
    return F.when(b == -1, F.lit(0).cast("long")).otherwise(F.try_mod(a.cast("long"), b))


def negate(a: Column) -> Column:
    """-a as a REAL, so that the least integer has one."""
    return -a.cast("double")


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a.cast("long"))


def shift_left(a: Column, n: Column) -> Column:
    """Shifts by 64 and more give 0 (-1 for negative numbers moved right); negative counts reverse."""
    a, n = a.cast("long"), n.cast("int")
    left = lambda k: F.when(k >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, k))
    right = lambda k: F.when(k >= 64, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")).otherwise(F.call_function("shiftright", a, k))
    return F.when(n >= 0, left(n)).when(n < 0, right(-n))


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n.cast("int"))


@F.pandas_udf(StringType())
def real_text(x: pd.Series) -> pd.Series:
    """A REAL as text: 15 significant digits, always with a point."""
    return x.map(lambda v: None if v is None or v != v else format_real(v))


def format_real(v: float) -> str:
    if v in (float("inf"), float("-inf")):
        return "Inf" if v > 0 else "-Inf"
    text = f"{v:.15g}"
    mantissa, e, exponent = text.partition("e")
    return (mantissa if "." in mantissa else mantissa + ".0") + (e + exponent)


def concat_text(*parts: Column) -> Column:
    """The || operator on text: NULL if any part is."""
    return F.concat(*parts)


# Casts never fail.
def cast_integer(text: Column) -> Column:
    return integer_prefix(text)


def cast_real(text: Column) -> Column:
    return real_prefix(text)


def real_to_integer(x: Column) -> Column:
    """A REAL truncated towards zero and clamped to 64 bits."""
    return F.when(x >= 9.223372036854775e18, F.lit(-(INT_MIN + 1))).when(x <= -9.223372036854775e18, F.lit(INT_MIN)).otherwise(x.try_cast("long"))


# The fragments of declared types that decide an affinity, in order.
_AFFINITY = (("INTEGER", ("INT",)), ("TEXT", ("CHAR", "CLOB", "TEXT")), ("BLOB", ("BLOB",)), ("REAL", ("REAL", "FLOA", "DOUB")))


def affinity(declared: str | None) -> str:
    """The affinity of a column's declared type."""
    name = (declared or "").upper()
    return next((a for a, parts in _AFFINITY if any(p in name for p in parts)), "NUMERIC" if name else "BLOB")


def apply_affinity(text: Column, kind: str) -> Column:
    """Text stored into a column of an affinity, as the Spark type of that affinity; text that isn't
    wholly a number becomes NULL in a numeric column of static type."""
    whole = F.regexp_like(text, F.lit(_NUMBER[:-1] + r")[ \t\n\x0b\f\r]*$"))
    if kind == "INTEGER":
        return F.when(whole, real_to_integer(real_prefix(text)))
    if kind in ("REAL", "NUMERIC"):
        return F.when(whole, real_prefix(text))
    return text.cast("binary") if kind == "BLOB" else text


# Comparison.
def nocase(text: Column) -> Column:
    """The key of the NOCASE collation: ASCII letters fold."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def rtrimmed(text: Column) -> Column:
    """The key of the RTRIM collation: trailing spaces don't count."""
    return F.rtrim(text)


def is_(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def is_not(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def in_list(x: Column, members: Sequence) -> Column:
    """x IN (...): false for an empty list even if x is NULL."""
    return x.isin(*members) if len(members) else F.lit(False)


def row_equal(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """(a, ...) = (b, ...), three-valued."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (x == y)
    return out


def row_less(a: Sequence[Column], b: Sequence[Column], or_equal: bool = False) -> Column:
    """(a, ...) < (b, ...), lexicographic and three-valued."""
    out = F.lit(or_equal)
    for x, y in reversed(list(zip(a, b, strict=True))):
        out = (x < y) | ((x == y) & out)
    return out


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE with a constant pattern: ASCII letters match in either case."""
    out, chars = [], iter(pattern)
    for c in chars:
        if escape and c == escape:
            out.append(_literal(next(chars, "")))
        else:
            out.append({"%": "(?s:.*)", "_": "(?s:.)"}.get(c) or _literal(c))
    return F.regexp_like(nocase(text), F.lit("^" + "".join(out).replace("\x00", "") + r"\z"))


def _literal(c: str) -> str:
    c = c.lower() if c.isascii() else c
    return "\\" + c if c and not c.isalnum() and c.isascii() else c


def glob(text: Column, pattern: str) -> Column:
    """GLOB with a constant pattern: *, ?, [set], [^set]; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[":
            negated = pattern[i + 1 : i + 2] == "^"
            start = i + 1 + negated
            end = pattern.find("]", start + 1)
            if end < 0:
                return F.when(text.isNotNull(), F.lit(False))
            body = "".join("\\" + x if x in "\\[]^&~" else x for x in pattern[start:end])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
        i += 1
    return F.regexp_like(text, F.lit("^" + "".join(out) + r"\z"))


# Dynamic values: a column that holds several storage classes, ordered across classes.
def dynamic(integer: Column | None = None, real: Column | None = None, text: Column | None = None, blob: Column | None = None) -> Column:
    """A struct whose plain comparison is the dialect's order NULL < numbers < text < blob. At most
    one argument may be non-NULL in a row."""
    integer, real = (F.lit(None).cast("long") if integer is None else integer), (F.lit(None).cast("double") if real is None else real)
    text, blob = (F.lit(None).cast("string") if text is None else text), (F.lit(None).cast("binary") if blob is None else blob)
    cls = F.when(integer.isNotNull() | real.isNotNull(), 1).when(text.isNotNull(), 3).when(blob.isNotNull(), 4).otherwise(0)
    return F.struct(
        cls.cast("tinyint").alias("cls"), F.coalesce(real, integer.cast("double")).alias("num"), integer.cast("long").alias("i"), text.alias("t"), blob.alias("b")
    )
