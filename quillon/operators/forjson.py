"""FOR JSON: query results as one JSON document.

PATH nests by dotted aliases; AUTO nests by the tables of the FROM clause and folds consecutive equal
outer rows. Arrays follow an explicit order, since rows have none otherwise. The document is one
value, so the last step gathers it in one row, as the result demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

from quillon.functions import semantics as S
from quillon.functions.json import _quoted


def shown(x: Column, kind: DataType, raw: bool = False) -> Column:
    """A value as JSON text: ISO times in UTC, base64 blobs; ``raw`` embeds JSON as it is."""
    if raw:
        text = x
    elif isinstance(kind, StringType):
        whole = F.to_json(F.struct(x.alias("v")))
        text = F.when(x.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
    elif isinstance(kind, (DoubleType, FloatType)):
        text = S.real_text(x.cast("double"))
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        text = F.concat(F.lit('"'), F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    elif isinstance(kind, BinaryType):
        text = F.concat(F.lit('"'), F.base64(x), F.lit('"'))
    elif isinstance(kind, BooleanType):
        text = x.cast("int").cast("string")
    else:
        text = x.cast("string")
    return text


def _object(members: list[tuple[str, Column]], nulls: bool) -> Column:
    """{...} of (name, JSON text); members that are NULL are left out, or null with ``nulls``."""
    parts = [F.concat(F.lit(_quoted(name) + ":"), F.coalesce(value, F.lit("null")) if nulls else value) for name, value in members]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _tree(paths: list[tuple[str, Column]], nulls: bool) -> Column:
    """Nests members by the dots in their names, in order of first mention."""
    groups: dict[str, list[tuple[str, Column]] | Column] = {}
    for path, value in paths:
        head, dot, rest = path.partition(".")
        if dot:
            groups.setdefault(head, []).append((rest, value))
        else:
            groups[head] = value
    members = []
    for name, inner in groups.items():
        if isinstance(inner, list):
            empty = inner[0][1].isNull()
            for _, v in inner[1:]:
                empty = empty & v.isNull()
            nested = _tree(inner, nulls)
            members.append((name, nested if nulls else F.when(~empty, nested)))
        else:
            members.append((name, inner))
    return _object(members, nulls)


def _document(items: DataFrame, order: list[str], root: str | None, wrapper: bool) -> DataFrame:
    """One row, column json, from rows of (order columns, item)."""
    if root is not None and not wrapper:
        raise ValueError("ROOT and WITHOUT_ARRAY_WRAPPER cannot be used together")
    gathered = items.agg(F.array_sort(F.collect_list(F.struct(*order, "item"))).alias("x"))
    body = F.array_join(F.transform("x", lambda e: e["item"]), ",")
    body = F.concat(F.lit("["), body, F.lit("]")) if wrapper else body
    return gathered.select((F.concat(F.lit("{" + _quoted(root) + ":"), body, F.lit("}")) if root is not None else body).alias("json"))


def for_json_path(df: DataFrame, order: list[str], columns: list[str] | None = None, root: str | None = None, nulls: bool = False, wrapper: bool = True, raw: tuple[str, ...] = ()) -> DataFrame:
    """SELECT ... FOR JSON PATH: an object for each row; dotted column names nest. ``order`` names the
    columns that order the array (they needn't be shown)."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    item = _tree([(c, shown(F.col(f"`{c}`"), kinds[c], c in raw)) for c in columns], nulls)
    return _document(df.select(*(F.col(f"`{o}`").alias(f"k{i}") for i, o in enumerate(order)), item.alias("item")), [f"k{i}" for i in range(len(order))], root, wrapper)


def for_json_auto(df: DataFrame, outer: list[str], inner: list[str], name: str, order: list[str], root: str | None = None, nulls: bool = False, wrapper: bool = True) -> DataFrame:
    """SELECT ... FOR JSON AUTO over a two-table join: consecutive rows (by ``order``) with equal outer
    columns become one object whose member ``name`` is the array of inner objects. Runs of equal
    rows are found by a window, so equal outer rows that don't follow one another stay apart."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = Window.orderBy(*order)
    changed = F.lit(False)
    for c in outer:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(rows))
    numbered = df.withColumn("__at", F.row_number().over(rows)).withColumn("__new", changed | (F.col("__at") == 1))
    runs = numbered.withColumn("__run", F.sum(F.col("__new").cast("long")).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    inner_item = _object([(c, shown(F.col(c), kinds[c])) for c in inner], nulls)
    missing = F.lit(True)
    for c in inner:
        missing = missing & F.col(c).isNull()
    folded = runs.groupBy("__run", *outer).agg(F.array_sort(F.collect_list(F.when(~missing, F.struct("__at", inner_item.alias("item"))))).alias("x"))
    body = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["item"]), ","), F.lit("]"))
    item = _object([*((c, shown(F.col(c), kinds[c])) for c in outer), (name, body)], nulls)
    return _document(folded.select("__run", item.alias("item")), ["__run"], root, wrapper)
