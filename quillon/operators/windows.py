"""Window functions: a specification builder with the dialect's frames.

ROWS and RANGE frames are Spark's own. GROUPS frames become RANGE frames over the peer group's number,
EXCLUDE is done by taking the excluded rows' part out again (sum, count, total, avg), and FILTER by a
conditional argument. Named windows are specifications that others extend.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = None


@dataclass(frozen=True)
class Over:
    """PARTITION BY, ORDER BY and frame of a window. Frame offsets: negative is PRECEDING, 0 the
    current row, positive FOLLOWING, None unbounded on that side. A RANGE offset beyond 32 bits needs a
    BIGINT order column: Spark refuses to cast it to a narrower one."""

    partition: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    unit: str | None = None
    start: int | float | None = None
    end: int | float | None = 0
    exclude: str = "no others"

    def extend(self, order: tuple[Column, ...] = (), unit: str | None = None, start=None, end=0, exclude: str = "no others") -> Over:
        """OVER (base ...): adds an ORDER BY or a frame that the base doesn't have."""
        if self.unit:
            raise ValueError("cannot override frame specification of window")
        if order and self.order:
            raise ValueError("cannot override ORDER BY clause of window")
        return replace(self, order=order or self.order, unit=unit, start=start, end=end, exclude=exclude)

    def spec(self) -> WindowSpec:
        """Spark's specification; GROUPS needs ``prepared`` first."""
        spec = Window.partitionBy(*self.partition)
        if self.order:
            spec = spec.orderBy(*self.order)
        if self.unit:
            bound = clamp if self.unit == "rows" else lambda offset: offset
            low = Window.unboundedPreceding if self.start is None else bound(self.start)
            high = Window.unboundedFollowing if self.end is None else bound(self.end)
            spec = spec.rowsBetween(low, high) if self.unit == "rows" else spec.rangeBetween(low, high)
        return spec


def clamp(offset: int | float) -> int | float:
    """Row and group offsets beyond 32 bits reach past any partition all the same."""
    return max(-(1 << 31) + 1, min((1 << 31) - 1, offset))


def ordered(spec: Over) -> WindowSpec:
    """The window of ranking functions, which know no frame."""
    return Window.partitionBy(*spec.partition).orderBy(*spec.order)


def prepared(df: DataFrame, spec: Over, group: str = "__group") -> tuple[DataFrame, Over]:
    """For a GROUPS frame: numbers the peer groups and gives the equal RANGE frame over them."""
    if spec.unit != "groups":
        return df, spec
    df = df.withColumn(group, F.dense_rank().over(ordered(spec)))
    start, end = (None if x is None else clamp(x) for x in (spec.start, spec.end))
    return df, replace(spec, order=(F.col(group),), unit="range", start=start, end=end)


def excluded_sum(value: Column, spec: Over) -> Column:
    """sum(value) over a frame less the rows its EXCLUDE names, NULL if no value is left.

    RANGE and GROUPS frames (prepared) hold all peers of the current row or none. In ROWS frames
    CURRENT ROW may be excluded; GROUP and TIES cut peers at the frame's ends, so they are refused.
    """
    return _excluded(value, spec)[0]


def excluded_count(value: Column, spec: Over) -> Column:
    """count(value) over a frame less the rows its EXCLUDE names."""
    return _excluded(value, spec)[1]


def _excluded(value: Column, spec: Over) -> tuple[Column, Column]:
    whole = spec.spec()
    total, n = F.coalesce(F.sum(value).over(whole), F.lit(0)), F.count(value).over(whole)
    inside = (spec.start is None or spec.start <= 0) and (spec.end is None or spec.end >= 0)
    if spec.exclude == "no others" or not inside:
        gone, gone_n = F.lit(0), F.lit(0)
    elif spec.exclude == "current row":
        gone, gone_n = F.coalesce(value, F.lit(0)), value.isNotNull().cast("long")
    else:
        if spec.unit == "rows":
            raise ValueError("EXCLUDE GROUP and TIES need a RANGE or GROUPS frame")
        peers = Window.partitionBy(*spec.partition).orderBy(*spec.order).rangeBetween(Window.currentRow, Window.currentRow)
        gone, gone_n = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
        if spec.exclude == "ties":
            gone, gone_n = gone - F.coalesce(value, F.lit(0)), gone_n - value.isNotNull().cast("long")
    left = n - gone_n
    return F.when(left > 0, total - gone), left


def filtered(aggregate, value: Column, where: Column, spec: Over) -> Column:
    """aggregate(value) FILTER (WHERE ...) OVER spec."""
    return aggregate(F.when(where, value)).over(spec.spec())


def group_concat_over(value: Column, separator: str, spec: Over) -> Column:
    """group_concat over a frame, in the window's order."""
    return F.array_join(F.collect_list(value).over(spec.spec()), separator)


def lag_by(df: DataFrame, value: Column, offset: Column, spec: Over, out: str, default: Column | None = None) -> DataFrame:
    """Adds ``out``: lag with an offset of its own in every row (negative: lead), by position in the partition. Rows
    are numbered and joined with the row at the number wanted, so a partition is never held as a whole. The window's
    order must tell all rows of a partition apart."""
    parts = [f"__p{i}" for i in range(len(spec.partition))]
    rows = df.select("*", *(c.alias(p) for c, p in zip(spec.partition, parts, strict=True)), F.row_number().over(ordered(spec)).alias("__at"), value.alias("__value"), offset.alias("__offset"))
    there = rows.select(*(F.col(p).alias(f"{p}_there") for p in parts), F.col("__at").alias("__there"), F.col("__value").alias("__got"))
    on = [F.col(p).eqNullSafe(F.col(f"{p}_there")) for p in parts] + [F.col("__at") - F.col("__offset") == F.col("__there")]
    got = F.when(F.col("__there").isNotNull(), F.col("__got"))
    if default is not None:
        got = got.when(F.col("__offset").isNotNull(), default)
    return rows.join(there, on, "left").select(*(df.columns), got.alias(out))
