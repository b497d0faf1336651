"""Date and time functions of the dialect as Column builders.

A time value is held as milliseconds since 1970 (UTC) in a BIGINT column; the session's time zone
must be UTC. Modifiers are constants, compiled into the plan.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DAY = 86_400_000
JULIAN_EPOCH = 2440587.5
_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY}
_DATE = r"^(\d{4})-(\d\d)-(\d\d)"
_TIME = r"(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?"
_ZONE = r"\s*(Z|z|[+-]\d\d:\d\d)?\s*$"


class Invalid(ValueError):
    """A modifier the dialect doesn't know: the function is NULL."""


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a date; days past the month's end run into the next month."""
    return F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1


def from_timestamp(ts: Column) -> Column:
    """Milliseconds of a timestamp column."""
    return F.unix_millis(ts.cast("timestamp"))


def from_julian(day: Column) -> Column:
    """Milliseconds of a Julian day number; NULL outside 0000..9999."""
    ok = (day >= 0) & (day < 5373484.5)
    return F.when(ok, F.floor((day.cast("double") - JULIAN_EPOCH) * DAY + 0.5).cast("long"))


def from_epoch(seconds: Column) -> Column:
    """Milliseconds of seconds since 1970."""
    return F.floor(seconds.cast("double") * 1000 + 0.5).cast("long")


def from_auto(number: Column) -> Column:
    """A number as a Julian day if it may be one, else as seconds since 1970."""
    return F.when((number >= 0) & (number < 5373484.5), from_julian(number)).otherwise(from_epoch(number))


def from_text(text: Column) -> Column:
    """Milliseconds of YYYY-MM-DD, with a time, or of a time alone (then on 2000-01-01), with an
    optional zone; NULL if the text is none of these."""
    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(text, pattern, k)

    def number(x: Column) -> Column:
        return F.coalesce(x.try_cast("int"), F.lit(0))

    def clock(pattern: str, k: int) -> tuple[Column, Column]:
        h, m, s, fraction, zone = (part(pattern, k + i) for i in range(5))
        ms = number(h) * 3_600_000 + number(m) * 60_000 + number(s) * 1000
        ms = ms + F.coalesce(F.floor(F.concat(F.lit("0"), fraction).try_cast("double") * 1000 + 0.5), F.lit(0))
        sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        offset = F.when(F.length(zone) == 6, sign * (number(F.substring(zone, 2, 2)) * 60 + number(F.substring(zone, 5, 2))) * 60_000).otherwise(0)
        return (ms - offset).cast("long"), (number(h) <= 24) & (number(m) <= 59) & (number(s) <= 59)

    plain, full, alone = _DATE + r"\s*$", _DATE + r"[ T]+" + _TIME + _ZONE, "^" + _TIME + _ZONE
    month, day = number(part(_DATE, 2)), number(part(_DATE, 3))
    valid = month.between(1, 12) & day.between(1, 31)
    date_ms = _days(number(part(_DATE, 1)), F.when(valid, month).otherwise(1), day).cast("long") * DAY
    full_ms, full_ok = clock(full, 4)
    alone_ms, alone_ok = clock(alone, 1)
    matches = lambda p: F.regexp_like(text, F.lit(p))
    return (
        F.when(matches(plain), F.when(valid, date_ms))
        .when(matches(full), F.when(valid & full_ok, date_ms + full_ms))
        .when(matches(alone), F.when(alone_ok, F.lit(10957 * DAY) + alone_ms))
    )


def now() -> Column:
    """The statement's time."""
    return F.unix_millis(F.current_timestamp())


def _timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def _add_months(ms: Column, months: int) -> Column:
    """Moves by months; a day that the month doesn't have runs into the next one."""
    date = F.to_date(_timestamp(ms))
    first = F.add_months(F.trunc(date, "month"), months)
    return (F.unix_date(first) + F.dayofmonth(date) - 1).cast("long") * DAY + F.pmod(ms, F.lit(DAY))


def _midnight(date: Column) -> Column:
    return F.unix_date(date).cast("long") * DAY


def modify(ms: Column, modifier: str, zone: str = "UTC") -> Column:
    """Applies one modifier."""
    m = modifier.strip().lower()
    if m in ("subsec", "subsecond"):
        return ms
    if m == "localtime":
        return F.unix_millis(F.from_utc_timestamp(_timestamp(ms), zone))
    if m == "utc":
        return F.unix_millis(F.to_utc_timestamp(_timestamp(ms), zone))
    if m in ("start of month", "start of year", "start of day"):
        return _midnight(F.to_date(F.date_trunc(m.split()[-1], _timestamp(ms))))
    if (found := re.fullmatch(r"weekday\s+([0-6])(?:\.0*)?", m)) is not None:
        day = F.dayofweek(_timestamp(ms)) - 1
        return ms + F.pmod(F.lit(int(found[1])) - day, F.lit(7)).cast("long") * DAY
    if (found := re.fullmatch(r"([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)\s+(second|minute|hour|day|month|year)s?", m)) is not None:
        amount, unit = float(found[1]), found[2]
        if unit in _UNITS:
            return ms + F.lit(round(amount * _UNITS[unit])).cast("long")
        whole = int(amount)
        rest = (amount - whole) * (30 if unit == "month" else 365) * DAY
        return _add_months(ms, whole * (12 if unit == "year" else 1)) + F.lit(round(rest)).cast("long")
    if (found := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?", m)) is not None:
        span = int(found[2]) * 3_600_000 + int(found[3]) * 60_000 + int(found[4] or 0) * 1000 + round(float(found[5] or 0) * 1000)
        return ms + F.lit(span if found[1] == "+" else -span).cast("long")
    if (found := re.fullmatch(r"([+-])(\d{4})-(\d\d)-(\d\d)(?: (\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?)?", m)) is not None:
        sign = 1 if found[1] == "+" else -1
        span = int(found[4]) * DAY + int(found[5] or 0) * 3_600_000 + int(found[6] or 0) * 60_000 + int(found[7] or 0) * 1000 + round(float(found[8] or 0) * 1000)
        return _add_months(ms, sign * (int(found[2]) * 12 + int(found[3]))) + F.lit(sign * span).cast("long")
    raise Invalid(f"unknown modifier: {modifier}")


def time_value(value: Column, modifiers: tuple[str, ...] = (), kind: str = "text", zone: str = "UTC") -> Column:
    """A time value after its modifiers. kind: text, number (a Julian day unless the first modifier
    says unixepoch, julianday or auto), timestamp or ms."""
    first = modifiers[0].strip().lower() if modifiers else ""
    if kind == "number":
        readers = {"unixepoch": from_epoch, "auto": from_auto, "julianday": from_julian}
        ms = readers.get(first, from_julian)(value)
        modifiers = modifiers[1:] if first in readers else modifiers
    else:
        ms = {"text": from_text, "timestamp": from_timestamp, "ms": lambda c: c}[kind](value)
        if first == "auto":
            modifiers = modifiers[1:]
    for m in modifiers:
        ms = modify(ms, m, zone)
    return ms


def _subsec(modifiers: tuple[str, ...]) -> bool:
    return any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)


def _safe(build):
    def call(value: Column, *modifiers: str, kind: str = "text", zone: str = "UTC") -> Column:
        try:
            return build(time_value(value, modifiers, kind, zone), _subsec(modifiers))
        except Invalid:
            return F.lit(None).cast("string")

    call.__doc__ = build.__doc__
    call.__name__ = build.__name__.lstrip("_")
    return call


@_safe
def date(ms: Column, subsec: bool) -> Column:
    """YYYY-MM-DD."""
    return F.date_format(_timestamp(ms), "yyyy-MM-dd")


@_safe
def time(ms: Column, subsec: bool) -> Column:
    """HH:MM:SS, with .SSS after subsec."""
    return F.date_format(_timestamp(ms), "HH:mm:ss.SSS" if subsec else "HH:mm:ss")


@_safe
def datetime(ms: Column, subsec: bool) -> Column:
    """YYYY-MM-DD HH:MM:SS, with .SSS after subsec."""
    return F.date_format(_timestamp(ms), "yyyy-MM-dd HH:mm:ss.SSS" if subsec else "yyyy-MM-dd HH:mm:ss")


@_safe
def julianday(ms: Column, subsec: bool) -> Column:
    """The Julian day number as a REAL."""
    return (ms + F.lit(210866760000000)).cast("double") / F.lit(float(DAY))


@_safe
def unixepoch(ms: Column, subsec: bool) -> Column:
    """Seconds since 1970: an INTEGER, or a REAL with milliseconds after subsec."""
    return ms.cast("double") / 1000.0 if subsec else F.floor(ms / F.lit(1000)).cast("long")


def strftime(form: str, value: Column, *modifiers: str, kind: str = "text", zone: str = "UTC") -> Column:
    """Formats a time value; an unknown conversion gives NULL."""
    try:
        ms = time_value(value, modifiers, kind, zone)
    except Invalid:
        return F.lit(None).cast("string")
    ts = _timestamp(ms)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    blank = lambda x: F.lpad(x.cast("string"), 2, " ")
    hour12 = F.pmod(F.hour(ts) + 11, F.lit(12)) + 1
    yday = F.dayofyear(ts) - 1
    monday = F.weekday(ts)
    parts = {
        "d": lambda: F.date_format(ts, "dd"), "e": lambda: blank(F.dayofmonth(ts)), "f": lambda: F.date_format(ts, "ss.SSS"),
        "F": lambda: F.date_format(ts, "yyyy-MM-dd"), "H": lambda: F.date_format(ts, "HH"), "k": lambda: blank(F.hour(ts)),
        "I": lambda: two(hour12), "l": lambda: blank(hour12), "j": lambda: F.lpad((yday + 1).cast("string"), 3, "0"),
        "J": lambda: ((ms + F.lit(210866760000000)).cast("double") / F.lit(float(DAY))).cast("decimal(20,9)").cast("double").cast("string"),
        "m": lambda: F.date_format(ts, "MM"), "M": lambda: F.date_format(ts, "mm"), "p": lambda: F.when(F.hour(ts) >= 12, "PM").otherwise("AM"),
        "P": lambda: F.when(F.hour(ts) >= 12, "pm").otherwise("am"), "R": lambda: F.date_format(ts, "HH:mm"),
        "s": lambda: F.floor(ms / F.lit(1000)).cast("long").cast("string"), "S": lambda: F.date_format(ts, "ss"), "T": lambda: F.date_format(ts, "HH:mm:ss"),
        "u": lambda: (monday + 1).cast("string"), "w": lambda: (F.dayofweek(ts) - 1).cast("string"),
        "W": lambda: two(F.floor((yday + 7 - monday) / 7).cast("int")), "Y": lambda: F.date_format(ts, "yyyy"), "%": lambda: F.lit("%"),
    }
    out: list[Column] = []
    for literal, code in re.findall(r"([^%]+)|%(.?)", form, re.DOTALL):
        if literal:
            out.append(F.lit(literal))
        elif code in parts:
            out.append(parts[code]())
        else:
            return F.lit(None).cast("string")
    return F.when(ms.isNotNull(), F.concat(*out)) if out else F.when(ms.isNotNull(), F.lit(""))


def span_text(a_ms: int, b_ms: int) -> str:
    """The span from b to a as (+|-)YYYY-MM-DD HH:MM:SS.SSS: whole months first, then days and time."""
    import datetime as dt

    epoch = dt.datetime(1970, 1, 1)
    at = lambda ms: epoch + dt.timedelta(milliseconds=ms)
    sign, low, high = ("+", at(b_ms), at(a_ms)) if a_ms >= b_ms else ("-", at(a_ms), at(b_ms))

    def moved(x: dt.datetime, months: int) -> dt.datetime:
        k = x.year * 12 + x.month - 1 + months
        return dt.datetime(k // 12, k % 12 + 1, 1, x.hour, x.minute, x.second, x.microsecond) + dt.timedelta(days=x.day - 1)

    # The earlier time plus the span is the later one for +; the later one minus it for -.
    months = (high.year - low.year) * 12 + high.month - low.month
    while months and (moved(low, months) > high if sign == "+" else moved(high, -months) < low):
        months -= 1
    rest = high - moved(low, months) if sign == "+" else moved(high, -months) - low
    seconds, ms = rest.seconds, rest.microseconds // 1000
    return f"{sign}{months // 12:04d}-{months % 12:02d}-{rest.days:02d} {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{ms:03d}"


@F.pandas_udf(StringType())
def _timediff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x != x or y != y or x is None or y is None else span_text(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype=object)


def timediff(a: Column, b: Column, kind: str = "text") -> Column:
    """The span from b to a as text."""
    return _timediff(time_value(a, kind=kind), time_value(b, kind=kind))


def current_date() -> Column:
    return date(now(), kind="ms")


def current_time() -> Column:
    return time(now(), kind="ms")


def current_timestamp() -> Column:
    return datetime(now(), kind="ms")


# The same rules on single Python values, for queries whose modifiers are data.
def python_ms(value: str | None, modifiers: list[str | None]) -> int | None:
    """Milliseconds of a time value given as text (a number as text is a Julian day unless a modifier
    says otherwise) after its modifiers; None for anything invalid."""
    import datetime as dt

    if value is None or any(m is None for m in modifiers):
        return None
    text, mods = value.strip(), [m.strip().lower() for m in modifiers]
    first = mods[0] if mods else ""
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        number = float(text)
        as_day = first not in ("unixepoch",) and not (first == "auto" and not 0 <= number < 5373484.5)
        if as_day and not 0 <= number < 5373484.5:
            return None
        ms = math.floor((number - JULIAN_EPOCH) * DAY + 0.5) if as_day else math.floor(number * 1000 + 0.5)
        mods = mods[1:] if first in ("unixepoch", "auto", "julianday") else mods
    elif text.lower() == "now":
        ms = int(dt.datetime.now(dt.UTC).timestamp() * 1000)
    else:
        m = re.fullmatch(r"(?:(\d{4})-(\d\d)-(\d\d))?(?:(?<=\d)[ T]+)?(?:(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?\s*(Z|z|[+-]\d\d:\d\d)?)?", text)
        if not text or m is None or (m[1] is None and m[4] is None):
            return None
        year, month, day = (int(m[1]), int(m[2]), int(m[3])) if m[1] else (2000, 1, 1)
        hour, minute, second = int(m[4] or 0), int(m[5] or 0), int(m[6] or 0)
        if not (1 <= month <= 12 and 1 <= day <= 31 and hour <= 24 and minute <= 59 and second <= 59):
            return None
        zone = m[8] or "Z"
        offset = 0 if zone in "Zz" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[4:6])) * 60_000
        ms = _python_days(year, month, day) * DAY + hour * 3_600_000 + minute * 60_000 + second * 1000 + math.floor(float("0" + (m[7] or ".0")) * 1000 + 0.5) - offset
    for m in mods:
        ms = _python_modify(ms, m)
        if ms is None:
            return None
    return ms


def _python_days(year: int, month: int, day: int) -> int:
    import datetime as dt

    return dt.date(year, month, 1).toordinal() - 719163 + day - 1


def _python_modify(ms: int, m: str) -> int | None:
    import datetime as dt

    at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)

    def months(n: int) -> int:
        k = at.year * 12 + at.month - 1 + n
        return _python_days(k // 12, k % 12 + 1, at.day) * DAY + ms % DAY

    if m in ("subsec", "subsecond", "utc", "localtime"):
        return ms
    if m.startswith("start of "):
        parts = {"day": (at.year, at.month, at.day), "month": (at.year, at.month, 1), "year": (at.year, 1, 1)}.get(m[9:])
        return None if parts is None else _python_days(*parts) * DAY
    if found := re.fullmatch(r"weekday\s+([0-6])(?:\.0*)?", m):
        return ms + (int(found[1]) - at.isoweekday() % 7) % 7 * DAY
    if found := re.fullmatch(r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s+(second|minute|hour|day|month|year)s?", m):
        amount, unit = float(found[1]), found[2]
        if unit in _UNITS:
            return ms + round(amount * _UNITS[unit])
        whole = int(amount)
        return months(whole * (12 if unit == "year" else 1)) + round((amount - whole) * (30 if unit == "month" else 365) * DAY)
    if found := re.fullmatch(r"([+-])(?:(\d{4})-(\d\d)-(\d\d))?\s*(?:(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?)?", m):
        sign = 1 if found[1] == "+" else -1
        span = int(found[4] or 0) * DAY + int(found[5] or 0) * 3_600_000 + int(found[6] or 0) * 60_000 + int(found[7] or 0) * 1000 + round(float(found[8] or 0) * 1000)
        return months(sign * (int(found[2] or 0) * 12 + int(found[3] or 0))) + sign * span
    return None


def python_format(form: str, ms: int) -> str | None:
    """strftime of one value."""
    import datetime as dt

    at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    yday, hour = at.timetuple().tm_yday, at.hour % 12 or 12
    parts = {
        "d": f"{at.day:02d}", "e": f"{at.day:2d}", "f": f"{at.second:02d}.{at.microsecond // 1000:03d}", "F": at.strftime("%Y-%m-%d"), "H": f"{at.hour:02d}", "k": f"{at.hour:2d}", "I": f"{hour:02d}", "l": f"{hour:2d}",
        "j": f"{yday:03d}", "J": repr(round((ms + 210866760000000) / DAY, 9)), "m": f"{at.month:02d}", "M": f"{at.minute:02d}", "p": "PM" if at.hour >= 12 else "AM", "P": "pm" if at.hour >= 12 else "am", "R": at.strftime("%H:%M"),
        "s": str(ms // 1000), "S": f"{at.second:02d}", "T": at.strftime("%H:%M:%S"), "u": str(at.isoweekday()), "w": str(at.isoweekday() % 7), "W": f"{(yday + 6 - at.weekday()) // 7:02d}", "Y": f"{at.year:04d}", "%": "%",
    }
    out = []
    for plain, code in re.findall(r"([^%]+)|%(.?)", form, re.DOTALL):
        if not plain and code not in parts:
            return None
        out.append(plain or parts[code])
    return "".join(out)
