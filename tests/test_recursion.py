"""Recursion without a bound of its own."""

import inspect

import pytest
from pyspark.sql import functions as F

from quillon.operators import relational


@pytest.mark.parametrize("distinct", [True, False])
def test_recursion_over_merged_rounds(spark, monkeypatch, distinct):
    monkeypatch.setattr(relational, "MERGE_ROUNDS", 3)
    step = lambda new: new.where("n < 11").select(F.col("n") + 1)
    out = relational.recursive(spark.range(1, 2).toDF("n"), step, distinct=distinct)
    assert sorted(r.n for r in out.collect()) == list(range(1, 12))


def test_bound_only_where_asked_for(spark):
    assert inspect.signature(relational.recursive).parameters["max_rounds"].default is None
    with pytest.raises(RecursionError, match="no end after 3 rounds"):
        relational.recursive(spark.range(1), lambda new: new.select(F.col("id") + 1), max_rounds=3)


def test_limit_of_the_recursion(spark):
    """LIMIT ends a recursion that has no other end; rows come round by round."""
    import sqlite3

    from quillon.engine import Database

    con = sqlite3.connect(":memory:")
    for sql in (
        "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c LIMIT 5) SELECT n FROM c",
        "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c LIMIT 5 OFFSET 3) SELECT n FROM c",
        "WITH RECURSIVE c(n) AS (SELECT 1 UNION SELECT (n * 2) % 11 FROM c LIMIT 4) SELECT n FROM c",
        "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 3 LIMIT 100) SELECT n FROM c",
        "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c LIMIT 0) SELECT n FROM c",
    ):
        assert sorted(r[0] for r in Database(spark).exec(sql).rows()) == sorted(r[0] for r in con.execute(sql)), sql
