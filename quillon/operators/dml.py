"""Row changes as table algebra: each statement maps a table to the new table.

Parquet tables are immutable, so a change is a new DataFrame; ``Catalog`` (quillon.engine) keeps the
current version of every table. Constraint checks return the violating rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matches(left: DataFrame, right: DataFrame, keys: list[str]) -> list[Column]:
    return [left[k] == right[k] for k in keys]


def conform(rows: DataFrame, table: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """New rows with the table's columns and types: missing ones take their default, else NULL."""
    defaults = defaults or {}
    return rows.select(*(
        (F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields
    ))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def insert(table: DataFrame, rows: DataFrame, keys: list[str] | None = None, conflict: str = "abort", order: list[Column] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT OR conflict. Without keys nothing conflicts. ignore keeps the table's row, and of new rows
    with one key the first in ``order``; replace takes the last new one. abort (also fail and rollback,
    which differ in what they undo only) raises when the result is computed. NULL keys never conflict."""
    rows = conform(rows, table, defaults)
    if not keys:
        return table.unionByName(rows)
    order = order or [F.col(k) for k in keys]
    free = rows.where(" or ".join(f"{k} is null" for k in keys))
    keyed = rows.where(" and ".join(f"{k} is not null" for k in keys))
    if conflict == "ignore":
        first = latest(keyed, keys, order)
        return table.unionByName(first.join(table, keys, "left_anti").select(*table.columns)).unionByName(free)
    if conflict == "replace":
        last = final(keyed, keys, order)
        return table.join(last, keys, "left_anti").select(*table.columns).unionByName(last).unionByName(free)
    met = table.select(*keys).unionByName(keyed.select(*keys)).groupBy(*keys).agg(F.count("*").alias("__n"))
    said = "UNIQUE constraint failed: " + ", ".join(keys)
    checked = keyed.join(met, keys).where(F.when(F.col("__n") > 1, F.raise_error(F.lit(said)).cast("boolean")).otherwise(F.lit(True)))
    return table.unionByName(checked.select(*table.columns)).unionByName(free)


def final(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    within = Window.partitionBy(*keys)
    ranked = rows.withColumn("__n", F.row_number().over(within.orderBy(*order))).withColumn("__of", F.count("*").over(within))
    return ranked.where("__n = __of").drop("__n", "__of")


def numbered(rows: DataFrame, column: str, start: int) -> DataFrame:
    """Rows whose ``column`` is NULL get consecutive numbers after ``start``, in the rows' order, without gathering
    them: a number within the partition plus the rows of the partitions before. Rows must come in the same order
    each time they are computed."""
    at = rows.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    missing = at.where(F.col(column).isNull())
    counts = sorted((r["__part"], r["n"]) for r in missing.groupBy("__part").agg(F.count("*").alias("n")).collect())
    if not counts:
        return rows
    before, so_far = [], start
    for part, n in counts:
        before.append((part, so_far))
        so_far += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__part int, __before long"))
    rank = F.row_number().over(Window.partitionBy("__part", F.col(column).isNull()).orderBy("__id"))
    placed = at.join(offsets, "__part", "left").withColumn("__rank", rank)
    kind = rows.schema[column].dataType
    return placed.withColumn(column, F.coalesce(column, (F.col("__before") + F.col("__rank")).cast(kind))).select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT(keys) DO UPDATE SET update WHERE where (DO NOTHING if update is None). In the
    expressions columns of the table are old.c and those of the new row excluded.c. New rows must
    have distinct keys."""
    rows = conform(rows, table)
    old, new = table.withColumn("__old", F.lit(True)).alias("old"), rows.withColumn("__new", F.lit(True)).alias("excluded")
    both = old.join(new, [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in keys], "full")
    hit = F.col("__old").isNotNull() & F.col("__new").isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    out = []
    for f in table.schema.fields:
        kept = F.when(F.col("__old").isNotNull(), F.col(f"old.{f.name}")).otherwise(F.col(f"excluded.{f.name}"))
        changed = (update or {}).get(f.name)
        out.append((kept if changed is None else F.when(hit, changed).otherwise(kept)).cast(f.dataType).alias(f.name))
    return both.select(*out)


def update(table: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... SET ... WHERE: all assignments see the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, assignments[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in assignments else F.col(f.name) for f in table.schema.fields))


def update_from(table: DataFrame, source: DataFrame, keys: list[str], assignments: dict[str, Column], order: list[Column] | None = None) -> DataFrame:
    """UPDATE ... FROM source: each row once, by the first matching source row in ``order``. Columns
    are old.c and source.c."""
    one = latest(source.where(" and ".join(f"{k} is not null" for k in keys)), keys, order or [F.col(k) for k in keys]).withColumn("__hit", F.lit(True)).alias("source")
    both = table.alias("old").join(one, [F.col(f"old.{k}") == F.col(f"source.{k}") for k in keys], "left")
    hit = F.col("source.__hit").isNotNull()
    return both.select(*(
        (F.when(hit, assignments[f.name]).otherwise(F.col(f"old.{f.name}")) if f.name in assignments else F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name) for f in table.schema.fields
    ))


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """DELETE ... WHERE: rows whose predicate is NULL stay."""
    return table.where(~F.coalesce(where, F.lit(False))) if where is not None else table.limit(0)


def delete_limited(table: DataFrame, where: Column, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """DELETE ... ORDER BY ... LIMIT: the first ``count`` qualifying rows by a unique key."""
    return table.join(table.where(where).orderBy(*order).limit(count).select(*keys), keys, "left_anti").select(*table.columns)


def returning(before: DataFrame, after: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """RETURNING: the new state of the rows that a change inserted or altered, found by a unique key."""
    old = before.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.struct(*after.columns).alias("__old"))
    both = after.withColumn("__new", F.struct(*after.columns)).join(old, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left")
    return both.where(~F.col("__new").eqNullSafe(F.col("__old"))).select(*(columns or after.columns))


# Constraints: the rows that violate them.
def not_null_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.where(" or ".join(f"{c} is null" for c in columns))


def check_violations(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose CHECK is false; NULL passes."""
    return table.where(~predicate)


def unique_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a NULL never does."""
    return table.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent; a NULL in the reference satisfies it."""
    refers = child.where(" and ".join(f"{c} is not null" for c in columns))
    return refers.join(parent, [refers[c] == parent[k] for c, k in zip(columns, keys, strict=True)], "left_anti")


def on_delete(child: DataFrame, columns: list[str], gone: DataFrame, keys: list[str], action: str = "cascade", default: dict[str, Column] | None = None) -> DataFrame:
    """The child table after parent rows ``gone`` are deleted: cascade, set null, set default, restrict."""
    on = [child[c] == gone[k] for c, k in zip(columns, keys, strict=True)]
    if action == "cascade":
        return child.join(gone, on, "left_anti")
    marked = child.join(gone.select(*keys).distinct().withColumn("__gone", F.lit(True)), on, "left")
    hit = F.col("__gone").isNotNull()
    if action in ("restrict", "no action"):
        stop = F.when(hit, F.raise_error(F.lit("FOREIGN KEY constraint failed")).cast("boolean")).otherwise(F.lit(True))
        return marked.where(stop).select(*(child[c] for c in child.columns))
    new = lambda c: (default or {}).get(c, F.lit(None)) if action == "set default" else F.lit(None)
    return marked.select(*(F.when(hit, new(c)).otherwise(child[c]).cast(child.schema[c].dataType).alias(c) if c in columns else child[c] for c in child.columns))


# Shape of a table.
def add_column(table: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    return table.withColumn(name, (F.lit(None) if default is None else default).cast(kind))


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)


def drop_column(table: DataFrame, name: str) -> DataFrame:
    if len(table.columns) == 1:
        raise ValueError(f'cannot drop column "{name}": no other columns exist')
    return table.drop(name)


def generated(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Generated columns computed from the row."""
    return table.withColumns(columns)


def index_statistics(table: DataFrame, name: str, index: str, columns: list[str]) -> DataFrame:
    """The ANALYZE row of an index: rows, then rows for each distinct value of every column prefix,
    rounded up. Distinct counts are exact and come from one pass over partial aggregates."""
    counts = table.agg(F.count("*").alias("n"), *(F.count_distinct(F.struct(*columns[: i + 1])).alias(f"d{i}") for i in range(len(columns))))
    each = [F.ceil(F.col("n") / F.greatest(F.col(f"d{i}"), F.lit(1))).cast("string") for i in range(len(columns))]
    return counts.select(F.lit(name).alias("tbl"), F.lit(index).alias("idx"), F.concat_ws(" ", F.col("n").cast("string"), *each).alias("stat"))
