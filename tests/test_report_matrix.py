"""Cross-tabs without given columns."""

from quillon.operators.report import matrix


def test_matrix_of_many_headings_and_null(spark):
    rows = [("a", k, 1) for k in range(1100)] + [("a", None, 7), ("b", 3, 5)]
    out = {r.g: r for r in matrix(spark.createDataFrame(rows, "g string, c int, v int"), ["g"], "c", "v").collect()}
    assert out["a"]["1099"] == 1 and out["a"]["null"] == 7 and out["b"]["3"] == 5
    assert {g: r.total for g, r in out.items()} == {"a": 1107, "b": 5, None: 1112}


def test_matrix_of_given_headings(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("a", "y", 4)], "g string, c string, v int")
    assert matrix(df, ["g"], "c", "v", values=["x", None]).where("level = 0").select("x", "null", "total").first() == (1, 2, 3)
    assert matrix(df, ["g"], "c", "v", values=["x"]).where("level = 0").first().total == 1
