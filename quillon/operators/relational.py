"""Joins, set operations and recursion."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: equality on all common columns, each shown once; no common one is a cross join."""
    common = [c for c in left.columns if c.lower() in {x.lower() for x in right.columns}]
    return left.join(right, common, how) if common else left.crossJoin(right)


def using_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: an error if a column is missing on either side."""
    for c in columns:
        if c not in left.columns or c not in right.columns:
            raise ValueError(f"cannot join using column {c} - column not present in both tables")
    return left.join(right, columns, how)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """points with low <= point < high, as an equi-join on bins of ``width``: each range emits the bins
    it crosses, so no pair outside a shared bin is looked at."""
    by_bin = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    binned = points.withColumn("__bin", F.floor(F.col(point) / width).cast("long"))
    return binned.join(by_bin, "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")


def not_in(df: DataFrame, column: Column, members: DataFrame, member: str) -> DataFrame:
    """x NOT IN (SELECT ...) with its NULL rules: nothing qualifies if a member is NULL, a NULL x only
    if there are no members. The members' flags are one row; matches go by an anti-join."""
    flags = members.agg(F.count("*").alias("__n"), F.count(F.when(F.col(member).isNull(), 1)).alias("__nulls"))
    kept = df.join(members.select(F.col(member).alias("__member")).distinct(), column == F.col("__member"), "left_anti")
    # One row by construction, so this product only adds two columns.
    return kept.join(F.broadcast(flags)).where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & column.isNotNull())).drop("__n", "__nulls")


_SET_OPERATIONS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "union all": lambda a, b: a.unionAll(b),
    "union": lambda a, b: a.union(b).distinct(),
    "intersect": lambda a, b: a.intersect(b),
    "except": lambda a, b: a.subtract(b),
}


def compound(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """A compound SELECT: operations apply from left to right, none binds tighter. Columns take the
    names of the first part; all parts must have as many."""
    out = first
    for operation, part in rest:
        if len(part.columns) != len(first.columns):
            raise ValueError(f"SELECTs to the left and right of {operation.upper()} do not have the same number of result columns")
        out = _SET_OPERATIONS[operation.lower()](out, part)
    return out


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the context's checkpoint folder where none is set: to spark.checkpoint.dir, or in local mode
    to a temporary folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quillon-recursive-")
        spark.sparkContext.setCheckpointDir(folder)


#: Rounds after which the rows found so far are checkpointed as one, so that plans stay small.
MERGE_ROUNDS = 64


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_rounds: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """WITH RECURSIVE: ``step`` maps the rows of one round to the next's; with ``distinct`` (UNION) rows
    that were met before don't recur, so cycles end. Each round is checkpointed to the shared folder
    (spark.checkpoint.dir), and only its new rows go into the next. Rounds go on until one brings no new
    rows, or ``offset`` + ``limit`` rows are found; RecursionError after ``max_rounds``, if given. Of the
    rows, round by round and within a round by their columns, ``offset`` are left out and ``limit`` taken."""
    checkpoint_folder(seed.sparkSession)
    fresh = (seed.distinct() if distinct else seed).checkpoint()
    found, out, rounds, seen = fresh, None, 0, 0
    while max_rounds is None or rounds < max_rounds:
        if limit is not None or offset:
            n = fresh.count()
            low, high = max(0, offset - seen), n if limit is None else min(n, offset + limit - seen)
            seen += n
            part = fresh if (low, high) == (0, n) else fresh.orderBy(*fresh.columns).limit(max(low, high)).offset(low)
            out = part if out is None else out.union(part)
            if limit is not None and seen >= offset + limit:
                return out
        new = step(fresh)
        if distinct:
            new = new.distinct().join(found, [new[a].eqNullSafe(found[b]) for a, b in zip(new.columns, found.columns, strict=True)], "left_anti")
        fresh = new.toDF(*seed.columns).checkpoint()
        if fresh.isEmpty():
            return found if out is None else out
        rounds += 1
        if distinct or out is None:  # what later rounds are held against, or the result
            found = found.union(fresh)
        if rounds % MERGE_ROUNDS == 0:
            found, out = (x and x.coalesce(max(1, seed.sparkSession.sparkContext.defaultParallelism)).checkpoint() for x in (found, out))
    raise RecursionError(f"no end after {max_rounds} rounds")


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """The column names of a CTE or view."""
    return df.toDF(*names)


def fresh_name(prefix: str = "q") -> str:
    """A temp view name that nothing else uses."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
