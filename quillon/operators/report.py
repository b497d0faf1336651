"""Report operators: cross-tabs, grouped tables with subtotals, shares of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def matrix(df: DataFrame, rows: list[str], column: str, value: str, aggregate: str = "sum", values: list | None = None, totals: bool = True, subtotals: bool = False) -> DataFrame:
    """A cross-tab: one row for each row heading, one column for each value of ``column``, a total
    column, and total rows (heading NULL, level = number of headings summed away). Give ``values`` to
    fix the columns without a pass over the data; the totals are then of these columns, else of all rows.
    A NULL heading is a column named null."""
    agg = _AGGREGATES[aggregate]
    summed = F.col(value)
    if values is None:
        values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    else:
        null = F.col(column).isNull() if None in values else F.lit(False)
        summed = F.when(null | F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(False)), summed)
    cells = [agg(F.when(F.col(column).eqNullSafe(v), F.col(value))).alias("null" if v is None else str(v)) for v in values]
    whole = [agg(summed).alias("total")] if totals else []
    if not totals:
        return df.groupBy(*rows).agg(*cells)
    out = df.rollup(*rows).agg(*cells, *whole, F.grouping_id().alias("__id"))
    level = F.length(F.regexp_replace(F.bin("__id"), "0", "")).cast("int")
    out = out.withColumn("level", level).drop("__id")
    return out if subtotals or len(rows) == 1 else out.where(F.col("level").isin(0, len(rows)))


def grouped(df: DataFrame, groups: list[str], measures: dict[str, Column]) -> DataFrame:
    """A grouped table with subtotals and a grand total: ``level`` counts the groups summed away."""
    out = df.rollup(*groups).agg(*(m.alias(n) for n, m in measures.items()), F.grouping_id().alias("__id"))
    return out.withColumn("level", F.length(F.regexp_replace(F.bin("__id"), "0", "")).cast("int")).drop("__id")


def share(value: Column, *scope: str) -> Column:
    """value / Sum(value) within a scope of at least one column (see with_share for the whole table)."""
    if not scope:
        raise ValueError("a share of the whole table needs with_share")
    return value / F.sum(value).over(Window.partitionBy(*scope))


def with_share(df: DataFrame, value: Column, name: str, *scope: str) -> DataFrame:
    """Adds value / Sum(value) within a scope. Sums are aggregated and joined back (for the whole table
    a single row), so no scope gathers its rows in one task."""
    if not scope:
        return df.join(F.broadcast(df.agg(F.sum(value).alias("__sum")))).withColumn(name, value / F.col("__sum")).drop("__sum")
    sums = df.groupBy(*(F.col(c).alias(f"__{i}") for i, c in enumerate(scope))).agg(F.sum(value).alias("__sum"))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(scope)]
    return df.join(sums, same).withColumn(name, value / F.col("__sum")).select(*df.columns, name)


def scoped(aggregate: str, value: Column, *scope: str) -> Column:
    """A scope aggregate of a report expression."""
    return _AGGREGATES[aggregate.lower()](value).over(Window.partitionBy(*scope))


def optional_filter(df: DataFrame, column: str, parameter: object | None) -> DataFrame:
    """The blank-means-all filter of a report parameter."""
    return df if parameter is None else df.where(F.col(column) == F.lit(parameter))
