"""printf of the dialect: common constant formats become built-in columns, the rest an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import semantics as S

_CONVERSION = re.compile(r"%([-+ #!0,]*)(\*|\d+)?(?:\.(\*|\d+))?(?:ll|l)?(.)", re.DOTALL)


def _number(x, real: bool = False):
    if x is None or x != x:
        return 0.0 if real else 0
    if isinstance(x, str):
        found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", x)
        x = float(found[1]) if found else 0.0
    return float(x) if real else int(x)


def _grouped(digits: str) -> str:
    head, dot, tail = digits.partition(".")
    return f"{int(head or 0):,}".rjust(len(head)) + dot + tail if head.isdigit() else digits


def format_value(code: str, flags: str, precision: int | None, x) -> str | None:
    """One conversion's text without padding; None for an unknown one."""
    if code in "diuxXo":
        n = _number(x)
        if code == "u":
            n &= (1 << 64) - 1
        if code in "xXo":
            body = format(n & (1 << 64) - 1, code)
            body = {"x": "0x", "X": "0X", "o": "0"}[code] + body if "#" in flags and n else body
            return body.rjust(precision or 0, "0")
        body = str(abs(n)).rjust(precision or 0, "0")
        body = f"{abs(n):,}" if "," in flags else body
        return ("-" if n < 0 else "+" if "+" in flags else " " if " " in flags else "") + body
    if code in "feEgG":
        v = _number(x, True)
        if v in (float("inf"), float("-inf")):
            return ("-" if v < 0 else "+" if "+" in flags else "") + "Inf"
        body = format(abs(v), f"{'#' if '#' in flags else ''}.{6 if precision is None else precision}{code}")
        if "!" in flags and code in "gG" and "." not in body and "e" not in body.lower():
            body += ".0"
        elif "!" in flags and code == "f" and "." not in body:
            body += ".0"
        body = _grouped(body) if "," in flags else body
        return ("-" if v < 0 else "+" if "+" in flags else " " if " " in flags else "") + body
    if code == "c":
        text = "" if x is None else str(x)[:1]
        return text * max(1, precision or 1)
    text = None if x is None or x != x else x if isinstance(x, str) else S.format_real(x) if isinstance(x, float) else str(x)
    if code in "sz":
        return (text or "")[:precision]
    if code == "q":
        return (text if text is not None else "(NULL)")[:precision].replace("'", "''")
    if code == "Q":
        return "NULL" if text is None else "'" + text[:precision].replace("'", "''") + "'"
    if code == "w":
        return (text if text is not None else "(NULL)")[:precision].replace('"', '""')
    return None


def format_text(form: str, args: list) -> str:
    """The whole format; a conversion it doesn't know ends the text."""
    out, at, left = [], 0, iter(args)
    for m in _CONVERSION.finditer(form):
        out.append(form[at : m.start()])
        at = m.end()
        flags, width, precision, code = m.groups()
        if code == "%":
            out.append("%")
            continue
        if code == "n":
            continue
        wide = _number(next(left, None)) if width == "*" else int(width or 0)
        if wide < 0:
            flags, wide = flags + "-", -wide
        exact = _number(next(left, None)) if precision == "*" else None if precision is None else int(precision)
        if exact is not None and exact < 0:
            exact = -exact
        text = format_value(code, flags, exact, next(left, None))
        if text is None:
            return "".join(out)
        if "-" in flags:
            text = text.ljust(wide)
        elif "0" in flags and code in "diuxXofeEgG":
            sign = text[:1] if text[:1] in "+- " else ""
            text = sign + text[len(sign) :].rjust(wide - len(sign), "0")
        else:
            text = text.rjust(wide)
        out.append(text)
    rest = form[at:]
    return "".join(out) + (rest[: rest.index("%")] + "%" if "%" in rest else rest)


def printf(form: str, *args: Column) -> Column:
    """printf / format with a constant format. Missing arguments are NULL or 0."""
    if args and re.fullmatch(r"(?:[^%]|%%|%0?\d*d|%-?\d*s)*", form):
        # Built-in: integers and plain strings, where the two formats agree.
        kinds = re.findall(r"%0?-?\d*([ds])", form.replace("%%", ""))
        if len(kinds) == len(args):
            cast = [F.coalesce(a.cast("long"), F.lit(0)) if k == "d" else F.coalesce(a.cast("string"), F.lit("")) for k, a in zip(kinds, args, strict=True)]
            return F.format_string(form, *cast)

    @F.pandas_udf("string")
    def run(columns: pd.DataFrame) -> pd.Series:
        return pd.Series([format_text(form, [None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row]) for row in columns.itertuples(index=False)], dtype=object)

    return run(F.struct(*(a.alias(f"a{i}") for i, a in enumerate(args)) if args else [F.lit(1).alias("none")]))
