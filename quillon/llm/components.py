"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, join_groups, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b) that isn't its
    own root. Each round links a node's larger neighbours to its smallest one (large star), then its
    smaller ones (small star); rounds end when the edges no longer change, after about log(n) of
    them. Minima are combined before the shuffle and joins may split a hot node, so a hub of any
    degree is fine. Every round is written to the shared folder."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = _both(now)
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = join_groups(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        middle = staged(large, "edges")
        least = middle.groupBy("a").agg(F.min("b").alias("m"))
        small = join_groups(middle, least, ["a"]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        after = staged(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), "edges")
        total = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        discard(middle)
        if total == mark or not total[0]:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, mark = after, total
