"""Sources and sinks: literal tables, files, scripts, blobs, results as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, StringType

from quillon.functions import core as C


def values(spark: SparkSession, rows: list[tuple], types: list[str] | None = None) -> DataFrame:
    """VALUES (...), (...): columns column1, column2, ...; all rows must have as many."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("all VALUES must have the same number of terms")
    names = [f"column{i + 1}" for i in range(len(rows[0]))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, types, strict=True)) if types else names)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file under a given schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=header)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """RFC 4180 CSV: fields with a comma, quote or line break are quoted, quotes doubled."""
    df.write.csv(path, header=header, quote='"', escape='"')


def copy_to(df: DataFrame, path: str) -> None:
    """A copy of a table, as VACUUM INTO makes one."""
    df.write.parquet(path)


def insert_script(df: DataFrame, name: str) -> DataFrame:
    """Lines of INSERT statements, one for each row, that rebuild a table's rows."""
    def literal(f):
        c = F.col(f.name)
        if isinstance(f.dataType, StringType):
            return C.quote_text(c)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return C.quote_real(c.cast("double"))
        if isinstance(f.dataType, BinaryType):
            return C.quote_blob(c)
        text = c.cast("string")
        return F.coalesce(text if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))

    quoted = '"' + name.replace('"', '""') + '"'
    return df.select(F.concat(F.lit(f"INSERT INTO {quoted} VALUES("), F.concat_ws(",", *(literal(f) for f in df.schema.fields)), F.lit(");")).alias("line"))


def list_lines(df: DataFrame, separator: str = "|") -> DataFrame:
    """Rows in list mode: values joined by a separator, NULL as nothing."""
    return df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("line"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content, sha256)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def rows(df: DataFrame) -> list[Row]:
    """A materialised result."""
    return df.collect()


def each(df: DataFrame) -> Iterator[Row]:
    """A streamed result: one partition at a time is held, the next is fetched meanwhile."""
    return df.toLocalIterator(prefetchPartitions=True)


# The catalog as tables.
def table_info(df: DataFrame) -> DataFrame:
    """pragma table_info: cid, name, type, notnull, dflt_value, pk."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME"}
    fields = [(i, f.name, kinds.get(f.dataType.simpleString(), "NUMERIC"), int(not f.nullable), f.metadata.get("default"), int(f.metadata.get("pk", 0))) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(fields, "cid int, name string, type string, notnull int, dflt_value string, pk int")


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The schema table: type, name, tbl_name, rootpage, sql."""
    made = []
    for name, df in sorted(tables.items()):
        columns = ", ".join(f"{r['name']} {r['type']}" for r in table_info(df).collect())
        made.append(("table", name, name, 0, f"CREATE TABLE {name} ({columns})"))
    return spark.createDataFrame(made, "type string, name string, tbl_name string, rootpage int, sql string")
