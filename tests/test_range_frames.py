"""RANGE frames with offsets beyond 32 bits."""

from pyspark.sql import functions as F

from quillon.operators.windows import Over, prepared


def test_range_offsets_are_distances(spark):
    values = [-6_000_000_000, -3_000_000_000, 0, 3_000_000_000]
    df = spark.createDataFrame([(x,) for x in values], "x long")
    spec = Over(order=(F.col("x"),), unit="range", start=-5_000_000_000, end=0)
    got = [r.n for r in df.select("x", F.count("*").over(spec.spec()).alias("n")).orderBy("x").collect()]
    assert got == [sum(0 <= x - y <= 5_000_000_000 for y in values) for x in values] == [1, 2, 2, 2]


def test_huge_group_offsets(spark):
    df, spec = prepared(spark.createDataFrame([(1,), (5,), (5,)], "x long"), Over(order=(F.col("x"),), unit="groups", start=-(1 << 40), end=0))
    assert sorted(r.n for r in df.select(F.count("*").over(spec.spec()).alias("n")).collect()) == [1, 3, 3]
