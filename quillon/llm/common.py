"""Pieces that several corpus operators share: text rules, shared staging, skew-safe joins."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import string
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, local mode gets a temporary
    folder; a cluster without the setting is refused, since no local folder is shared there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _FALLBACK[app]


def text_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Keeps the session's Arrow batches small enough for long texts: what a Python worker and its
    executor hold at once is one batch. Settings that are smaller already stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Folders of the tables staged within the innermost ``staging`` of this thread or task.
_OWNED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)
#: Removes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, row ids made by
    ``monotonically_increasing_id`` stay fixed, and a lost executor costs nothing upstream. The write's
    shuffle files go when it is done. ``by`` lays the files out by a column's values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{tag}-{uuid.uuid4().hex}"
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, parent)


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that are staged inside and deletes them at its end: for callers that write or collect what
    they compute before they leave. Tables staged elsewhere, which other results may still read, stay."""
    token = _OWNED.set([])
    try:
        yield
    finally:
        for path in _OWNED.get():
            delete(spark, path)
        _OWNED.reset(token)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins ``rows`` with one row per key of ``groups``. The extra hashed key keeps the join from
    reusing the aggregate's partitioning, so both sides get a plain exchange and adaptive execution
    may split a key that holds a third of the rows."""
    salt = F.xxhash64(*keys)
    return rows.withColumn("__salt", salt).join(groups.withColumn("__salt", salt), [*keys, "__salt"], how).drop("__salt")


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 1 << 20) -> DataFrame:
    """Inner join with a staged table of short rows: it is broadcast if it has at most ``most`` rows,
    and joined with skew handling beyond that."""
    return rows.join(F.broadcast(groups), keys) if groups.count() <= most else join_groups(rows, groups, keys)


def with_row_id(df: DataFrame, name: str = "__rid") -> DataFrame:
    """Adds a row identity that every later scan gives again: hash of the file and row in it, for plain
    reads of files with deterministic filters. Anything else is staged with a running number."""
    analyzed = df._jdf.queryExecution().analyzed()
    plan = analyzed.toString()
    nodes = {line.strip(" :+-|").split(" ")[0].strip("'!") for line in plan.splitlines() if line.strip()}
    if nodes <= {"Project", "Filter", "Relation"} and "parquet" in plan and analyzed.deterministic():
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("r")).alias(name))
    return staged(df.select("*", F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r")).alias(name)), "rows")


def blocked_filter(hashes: DataFrame, blocks: int, least: int = 1) -> DataFrame:
    """(block, bits): a blocked Bloom filter as 4 KB bitmaps, holding the bits that at least ``least``
    rows of ``hashes`` (h) hit."""
    hits = hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(F.array_distinct(F.array(*filter_bits(F.col("h"))))).alias("pos"))
    kept = hits.groupBy("block", "pos").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return kept.groupBy("block").agg(F.call_function("bitmap_construct_agg", F.col("pos")).alias("bits"))


#: Bits of one block of a Bloom filter: what bitmap_construct_agg packs into a bitmap.
BLOCK_BITS = 32768


def filter_bits(h: Column) -> list[Column]:
    """The two bits of a hash within its block."""
    return [F.pmod(F.shiftrightunsigned(h, shift), F.lit(BLOCK_BITS)) for shift in (16, 40)]


def bit_set(bits: Column, pos: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (pos % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def flag_members(rows: DataFrame, hashes: DataFrame, count: int, least: int = 1, out: str = "again", bits_per_row: int = 16, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Adds a boolean ``out`` to rows (h): false only if fewer than ``least`` of ``hashes`` (h, about
    ``count`` rows) equal the row's. Rows never shuffle: the filter is broadcast, and one of more than
    ``max_broadcast_bytes`` goes in rounds, each with so many of its blocks and the rows that fall in them."""
    blocks = max(1, -(-count * bits_per_row // BLOCK_BITS))
    seen = blocked_filter(hashes, blocks, least)
    once = max(1, max_broadcast_bytes // (BLOCK_BITS // 8))
    placed = rows.withColumn("block", F.pmod("h", F.lit(blocks)))
    first, second = filter_bits(F.col("h"))

    def tested(some: DataFrame, bits: DataFrame) -> DataFrame:
        member = F.coalesce(bit_set(F.col("bits"), first) & bit_set(F.col("bits"), second), F.lit(False))
        return some.join(F.broadcast(bits), "block", "left").withColumn(out, member).select(*rows.columns, *[out] * (out not in rows.columns))

    if blocks <= once:
        return tested(placed, seen)
    turn = F.floor(F.col("block") / F.lit(once)).cast("int").alias("__round")
    placed, seen = staged(placed.select("*", turn), "rounds", "__round"), staged(seen.select("*", turn), "filter", "__round")
    done = [staged(tested(placed.where(F.col("__round") == k), seen.where(F.col("__round") == k).drop("__round")), "tested") for k in range(-(-blocks // once))]
    return functools.reduce(DataFrame.unionByName, done)
