"""Aggregates beyond Spark's own names and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """sum as a REAL, 0.0 for no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def where(aggregate, x: Column, condition: Column) -> Column:
    """aggregate(x) FILTER (WHERE condition)."""
    return aggregate(F.when(condition, x))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def group_concat(x: Column, separator: str = ",", order: tuple[Column, ...] = (), distinct: bool = False) -> Column:
    """Joins the group's non-NULL values. ``order`` gives their order (its last key should make it
    total); without it the order is that of arrival. NULL if there is no value. The text of a group
    is held in one row, as its result is."""
    text = x.cast("string")
    if distinct:
        values = F.array_sort(F.collect_set(text))
    elif order:
        items = F.collect_list(F.when(text.isNotNull(), F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), text.alias("v"))))
        values = F.transform(F.array_sort(items), lambda e: e["v"])
    else:
        values = F.collect_list(text)
    return F.when(F.size(values) > 0, F.array_join(values, separator))


def bare(column: Column, at_least: Column | None = None, at_most: Column | None = None) -> Column:
    """A bare column beside aggregates: of the row with the group's min(at_least) or max(at_most),
    else of any row of the group."""
    if at_least is not None:
        return F.min_by(column, at_least)
    return F.max_by(column, at_most) if at_most is not None else F.first(column)


def salted_groups(df: DataFrame, keys: list[str], partial: list[Column], final: list[Column], salts: int = 32) -> DataFrame:
    """Aggregates in two steps, first by keys and a random-free salt of the row, then by keys: for
    aggregates that map-side combining can't shrink when one key holds much of the table.

    ``partial`` names its outputs; ``final`` aggregates those names.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    return df.groupBy(*keys, salt.alias("__salt")).agg(*partial).groupBy(*keys).agg(*final)
