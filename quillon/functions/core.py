"""String, blob and miscellaneous scalar functions of the dialect as Column builders.

NULL in gives NULL out unless a docstring says otherwise. Case folding touches ASCII letters only.
"""

from __future__ import annotations

import string
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, IntegralType, NullType, StringType, TimestampNTZType, TimestampType

from quillon.functions import semantics as S

VERSION = "3.45.1"


def abs_(x: Column) -> Column:
    return F.abs(x)


def abs_text(x: Column) -> Column:
    """abs of a text: of its numeric prefix, 0.0 if none."""
    return F.abs(S.real_prefix(x))


@F.pandas_udf(StringType())
def _chars(points: pd.Series) -> pd.Series:
    return points.map(lambda ps: None if ps is None else "".join(chr(p) if 0 <= p <= 0x10FFFF and not 0xD800 <= p < 0xE000 else "�" for p in (0 if q is None or q != q else int(q) for q in ps)))


def char(*points: Column) -> Column:
    """Text of code points; those out of range become U+FFFD, NULL counts as 0."""
    return _chars(F.array(*(F.coalesce(p.cast("long"), F.lit(0)) for p in points)))


def coalesce(*xs: Column) -> Column:
    return F.coalesce(*xs)


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def concat(*xs: Column) -> Column:
    """Joins texts, skipping NULLs."""
    return F.concat_ws("", *xs)


def concat_ws(separator: Column, *xs: Column) -> Column:
    """Joins non-NULL texts; a NULL separator gives NULL."""
    return F.when(separator.isNotNull(), F.call_function("concat_ws", separator, *xs))


def glob(pattern: str, text: Column) -> Column:
    return S.as_int(S.glob(text, pattern))


def like(pattern: str, text: Column, escape: str | None = None) -> Column:
    return S.as_int(S.like(text, pattern, escape))


def hex_(x: Column) -> Column:
    """Hex of the text's bytes, also of a number's; NULL gives the empty text."""
    return F.coalesce(F.hex(x.cast("string")), F.lit(""))


def hex_blob(x: Column) -> Column:
    return F.coalesce(F.hex(x), F.lit(""))


def iif(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def instr(haystack: Column, needle: Column) -> Column:
    return F.call_function("instr", haystack, needle)


def length(x: Column) -> Column:
    """Characters up to the first NUL."""
    return F.length(F.substring_index(x, "\x00", 1))


def octet_length(x: Column) -> Column:
    return F.octet_length(x.cast("string"))


def likely(x: Column) -> Column:
    return x


unlikely = likely


def likelihood(x: Column, p: float) -> Column:
    if not 0.0 <= p <= 1.0:
        raise ValueError("second argument to likelihood() must be a constant between 0.0 and 1.0")
    return x


def lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def upper(x: Column) -> Column:
    return F.translate(x, string.ascii_lowercase, string.ascii_uppercase)


def trim(x: Column, chars: str = " ") -> Column:
    return F.trim(x, F.lit(chars)) if chars else x


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars)) if chars else x


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars)) if chars else x


def _any_null(xs: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a | b, (x.isNull() for x in xs))


def max_(*xs: Column) -> Column:
    """The largest argument, NULL if any is NULL."""
    return F.when(~_any_null(xs), F.greatest(*xs))


def min_(*xs: Column) -> Column:
    """The smallest argument, NULL if any is NULL."""
    return F.when(~_any_null(xs), F.least(*xs))


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


@F.pandas_udf(StringType())
def quote_text(x: pd.Series) -> pd.Series:
    """A text as an SQL literal; NULL gives NULL's literal."""
    return x.map(lambda v: "NULL" if v is None else "'" + v.split("\x00", 1)[0].replace("'", "''") + "'")


@F.pandas_udf(StringType())
def quote_real(x: pd.Series) -> pd.Series:
    """A REAL as an SQL literal that reads back to the same value."""
    return x.map(lambda v: "NULL" if v is None or v != v else S.format_real(v) if float(S.format_real(v).replace("Inf", "inf")) == v and abs(v) != float("inf") else "9.0e+999" if v == float("inf") else "-9.0e+999" if v == float("-inf") else f"{v:.20e}")


def quote_integer(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("NULL"))


def quote_blob(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("X'"), F.hex(x), F.lit("'")), F.lit("NULL"))


def random() -> Column:
    """A random INTEGER in each row."""
    return F.xxhash64(F.rand(), F.rand())


@F.pandas_udf(BinaryType())
def _random_bytes(n: pd.Series) -> pd.Series:
    import os

    return n.map(lambda k: os.urandom(max(1, int(k))))


def randomblob(n: Column) -> Column:
    """Random bytes, one at least."""
    return _random_bytes(n.cast("long")) if n is not None else F.lit(None)


def zeroblob(n: Column) -> Column:
    return F.unhex(F.call_function("repeat", F.lit("00"), F.greatest(n.cast("int"), F.lit(0))))


def replace(text: Column, old: Column, new: Column) -> Column:
    """Replaces every occurrence; an empty pattern changes nothing."""
    return F.when(old == "", F.when(new.isNotNull(), text)).otherwise(F.call_function("replace", text, old, new))


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero, always REAL; digits are clamped to 0..30."""
    return F.round(x.cast("double"), min(30, max(0, digits)))


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def sign_text(x: Column) -> Column:
    """sign of a text that is wholly a number, else NULL."""
    return F.signum(S.apply_affinity(x, "REAL")).cast("long")


def soundex(x: Column) -> Column:
    """Soundex of the letters; ?000 without any, also for NULL."""
    letters = F.regexp_replace(F.coalesce(x, F.lit("")), "^[^A-Za-z]+", "")
    return F.when(letters == "", F.lit("?000")).otherwise(F.soundex(letters))


def substr(text: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """Substring by characters: a negative start counts from the end, start 0 lies before the first
    character, a negative count takes the characters before the start."""
    p = (F.lit(start) if isinstance(start, int) else start).cast("long")
    n = F.length(text).cast("long")
    everything = F.lit(1 << 40)
    k = everything if count is None else (F.lit(count) if isinstance(count, int) else count).cast("long")
    at = F.when(p < 0, n + p).when(p > 0, p - 1).otherwise(F.lit(-1))
    if count is None:
        at = F.when(p == 0, F.lit(0)).otherwise(at)
    low = F.when(k < 0, at + k + (F.when(p == 0, 1).otherwise(0))).otherwise(at)
    high = F.when(k < 0, at + (F.when(p == 0, 1).otherwise(0))).otherwise(at + k)
    low, high = F.greatest(low, F.lit(0)), F.least(F.greatest(high, F.lit(0)), n)
    ready = text.isNotNull() & p.isNotNull() & k.isNotNull()
    return F.when(ready, F.substring(text, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")))


def typeof(x: Column, kind: DataType) -> Column:
    """The storage class of a column's values, from its type."""
    names = ((IntegralType, "integer"), (DoubleType, "real"), (FloatType, "real"), (StringType, "text"), (BinaryType, "blob"), (TimestampType, "datetime"), (TimestampNTZType, "datetime"), (NullType, "null"))
    name = next((n for t, n in names if isinstance(kind, t)), "integer")
    return F.when(x.isNull(), F.lit("null")).otherwise(F.lit(name))


def unhex(text: Column, ignore: str = "") -> Column:
    """Bytes of hex digits, NULL if the text is no whole number of pairs; ``ignore`` may stand between pairs."""
    if ignore:
        spare = "[" + "".join("\\" + c if not c.isalnum() else c for c in ignore) + "]*"
        valid = F.regexp_like(text, F.lit(f"^{spare}([0-9A-Fa-f]{{2}}{spare})*$"))
        text = F.translate(text, "".join(c for c in ignore if c not in string.hexdigits), "")
    else:
        valid = F.regexp_like(text, F.lit("^([0-9A-Fa-f]{2})*$"))
    return F.when(valid, F.unhex(F.when(valid, text)))


def unicode(x: Column) -> Column:
    """The first code point, NULL for the empty text."""
    return F.when(F.length(x) > 0, F.ascii(x))


def version() -> Column:
    """The dialect's version."""
    return F.lit(VERSION)


def load_extension(*_: object) -> Column:
    raise PermissionError("not authorized")


# Mathematics. A domain error is NULL.
def _math(name: str):
    def call(x: Column) -> Column:
        return S.no_nan(F.call_function(name, x.cast("double")))

    call.__name__ = name
    call.__doc__ = f"{name}(x) as a REAL; NULL outside its domain."
    return call


acos, acosh, asin, asinh, atan, atanh = (_math(n) for n in ("acos", "acosh", "asin", "asinh", "atan", "atanh"))
cos, cosh, sin, sinh, tan, tanh = (_math(n) for n in ("cos", "cosh", "sin", "sinh", "tan", "tanh"))
exp, sqrt, degrees, radians = (_math(n) for n in ("exp", "sqrt", "degrees", "radians"))


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y.cast("double"), x.cast("double"))


def pi() -> Column:
    return F.pi()


def _whole(x: Column, kind: DataType, real) -> Column:
    return x if isinstance(kind, IntegralType) else real(x)


def ceil(x: Column, kind: DataType) -> Column:
    """Integers stay as they are, REALs stay REAL."""
    return _whole(x, kind, lambda v: F.ceil(v).cast("double"))


def floor(x: Column, kind: DataType) -> Column:
    return _whole(x, kind, lambda v: F.floor(v).cast("double"))


def trunc(x: Column, kind: DataType) -> Column:
    return _whole(x, kind, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"))


def ln(x: Column) -> Column:
    """Natural logarithm: of 0 minus infinity, of negative numbers NULL."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.log(x))


def log10(x: Column) -> Column:
    """Base 10, NULL for x <= 0."""
    return F.log10(x.cast("double"))


log = log10


def log2(x: Column) -> Column:
    return F.log2(x.cast("double"))


def log_base(base: Column, x: Column) -> Column:
    """log(base, x): NULL unless both are positive and the base isn't 1."""
    base, x = base.cast("double"), x.cast("double")
    return F.when((base > 0) & (x > 0) & (F.log(base) != 0), F.log(x) / F.log(base))


def mod(a: Column, b: Column) -> Column:
    """Floating remainder, NULL for b = 0."""
    return F.try_mod(a.cast("double"), b.cast("double"))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))
