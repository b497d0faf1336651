"""Exact deduplication: a two-plane blocked Bloom filter decides which hashes may repeat; only rows
that it flags are shuffled and grouped, all others pass straight through.

Pass 1 maps every row's 64-bit hash to a filter block and two bits in it and counts the bits, with
map-side combining; bits met twice or more form the filter's "again" plane, packed into 4 KB bitmaps
by the SQL bitmap aggregates. Pass 2 tests each row's two bits: both set means "possibly repeated".
A false positive only sends a single row through the exact grouping, so results are exact.

The filter takes ``bits_per_row`` bits a row and is broadcast, in rounds of ``max_broadcast_bytes`` if
it is larger, each for the rows whose hashes fall in its blocks: rows pass straight through at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, flag_members, join_groups, staged
from quillon.session import table


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts
    the row with the largest id stays; null ids are smallest; of repeated rows with that id one
    stays. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    text = ascii_lower(F.col(text_col))
    rows = staged(
        df.select(
            F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("rid")
        ),
        "exact",
    )
    flagged = flag_members(rows, rows.select("h"), rows.count(), 2, "again", bits_per_row, max_broadcast_bytes)
    once = flagged.where(~F.col("again")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    maybe = flagged.where("again")
    groups = maybe.groupBy("sha").agg(F.max("h").alias("h"), F.count("*").alias("group_size"), F.max(F.struct("id", "rid")).alias("keep"))
    many = join_groups(maybe.drop("again"), groups, ["sha", "h"]).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "sha"
    )
    return once.unionByName(many).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every row of ``documents`` with its group and whether it stays."""
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM n
"""
