"""The engine front, row changes against a model, frames against brute force."""

import pytest
from pyspark.sql import functions as F

from quillon.engine import Database
from quillon.errors import EngineError
from quillon.operators import dml as M
from quillon.operators import relational as R
from quillon.operators import windows as W
from quillon.plans import dialect


@pytest.fixture
def db(spark, sf):
    return Database(spark, sf)


def test_exec_and_parameters(db):
    assert db.exec("SELECT count(*) FROM nation").scalar() == 25
    assert db.exec("SELECT n_name FROM nation WHERE n_nationkey = ?", [3]).scalar() is not None
    assert db.exec("SELECT n_name FROM nation WHERE n_nationkey == :k", {"k": 3}).first()[0] == db.exec('SELECT "n_name" FROM [nation] WHERE n_nationkey = 3').scalar()
    assert len(db.exec("SELECT n_name FROM nation ORDER BY n_name LIMIT 5, 3").rows()) == 3
    assert len(db.exec("SELECT n_name FROM nation LIMIT -1").rows()) == 25
    assert db.exec("SELECT count(*) FROM nation WHERE n_name GLOB 'A*'").scalar() == db.exec("SELECT count(*) FROM nation WHERE n_name LIKE 'a%'").scalar()
    assert db.exec("SELECT count(*) FROM nation WHERE n_nationkey IN ()").scalar() == 0
    assert db.exec("SELECT NULL IS 1, 1 IS NOT NULL, 2 NOTNULL").first()[0] == 0


def test_prepare(db):
    s = db.prepare("SELECT count(*) FROM nation WHERE n_regionkey = ?1")
    assert s.parameters == ["?1"]
    assert s.bind(0).exec().scalar() == 5
    assert s.clear().exec().scalar() == 0


def test_streaming_stops(db):
    seen = []
    db.exec("SELECT n_nationkey FROM nation").each(lambda r: seen.append(r[0]) or len(seen) < 3)
    assert len(seen) == 3


def test_for_json(db):
    assert db.exec("SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 2 FOR JSON PATH, ROOT('n')").scalar() == '{"n":[{"id":0},{"id":1}]}'
    assert db.exec("SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 0 FOR JSON PATH").scalar() == "[]"
    with pytest.raises(EngineError):
        db.exec("SELECT 1 FOR JSON PATH, ROOT('r'), WITHOUT_ARRAY_WRAPPER")


def test_transactions(db):
    with db.begin() as tx:
        db.change("nation", lambda t: M.delete(t, F.col("n_nationkey") < 5))
        tx.savepoint("a")
        db.change("nation", lambda t: M.delete(t))
        assert db.row_count("nation") == 0
        tx.rollback_to("a")
    assert db.row_count("nation") == 20
    with pytest.raises(RuntimeError), db.begin():
        db.change("nation", lambda t: M.delete(t))
        raise RuntimeError
    assert db.row_count("nation") == 20 and not db.in_transaction


def test_errors(db):
    for sql, code in (("SELECT * FROM nowhere", "no such table"), ("SELECT nothing FROM nation", "no such column"), ("SELEC 1", "syntax")):
        with pytest.raises(EngineError) as e:
            db.exec(sql)
        assert e.value.code == code


def test_statements():
    assert len(dialect.statements("SELECT 1; SELECT ';'; -- no ;\nSELECT 3")) == 3
    assert dialect.complete("SELECT 1;") and not dialect.complete("SELECT 1")


@pytest.mark.parametrize("conflict", ["ignore", "replace"])
def test_insert_against_model(spark, conflict):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z"), (None, "m")], "k int, v string")
    out = M.insert(old, new, ["k"], conflict, [F.col("k"), F.col("v")])
    model = {1: "a", 2: "b"}
    for k, v in ((2, "x"), (3, "y"), (3, "z")):
        if conflict == "replace" or k not in model:
            model[k] = v
    got = out.collect()
    assert {r.k: r.v for r in got if r.k is not None} == model
    assert sorted(r.v for r in got if r.k is None) == ["m", "n"]


def test_insert_abort(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert M.insert(old, spark.createDataFrame([(2, "b")], old.schema), ["k"]).count() == 2
    with pytest.raises(Exception, match="UNIQUE constraint failed"):
        M.insert(old, spark.createDataFrame([(1, "b")], old.schema), ["k"]).collect()


def test_foreign_key_restrict(spark):
    child = spark.createDataFrame([(1, 7), (2, None)], "id int, p int")
    gone = spark.createDataFrame([(7,)], "p int").withColumnRenamed("p", "id0")
    with pytest.raises(Exception, match="FOREIGN KEY"):
        M.on_delete(child, ["p"], gone, ["id0"], "restrict").collect()
    assert M.on_delete(child, ["p"], gone, ["id0"], "set default", {"p": F.lit(0)}).orderBy("id").collect()[0].p == 0


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    pick = lambda rows: sorted(r.x if r.x is not None else -1 for r in R.not_in(left, F.col("x"), spark.createDataFrame(rows, "m int"), "m").collect())
    assert pick([(1,)]) == [2]
    assert pick([(1,), (None,)]) == []
    assert pick([]) == [-1, 1, 2]


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
@pytest.mark.parametrize(("start", "end"), [(-1, 1), (None, 0), (0, 2)])
def test_groups_frames(spark, exclude, start, end):
    rows = [(i, i * 7 % 5, i) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    df, spec = W.prepared(df, W.Over((), (F.col("g"),)).extend(unit="groups", start=start, end=end, exclude=exclude))
    got = {r.id: r.s for r in df.select("id", W.excluded_sum(F.col("v"), spec).alias("s")).collect()}
    for i, g, _ in rows:
        inside = [(j, h, v) for j, h, v in rows if (start is None or h - g >= start) and h - g <= end]
        left = [v for j, h, v in inside if not (exclude == "current row" and j == i or exclude == "group" and h == g or exclude == "ties" and h == g and j != i)]
        assert got[i] == (sum(left) if left else None)


def test_windows_refuse_overrides():
    w = W.Over((), (F.lit(1),), "rows", -1, 0)
    with pytest.raises(ValueError, match="frame"):
        w.extend(unit="rows", start=0, end=0)
    with pytest.raises(ValueError, match="ORDER BY"):
        W.Over((), (F.lit(1),)).extend(order=(F.lit(2),))


def test_stream_windows(spark, sf, tmp_path):
    from quillon.streaming.results import read_events, windowed

    source = spark.read.parquet(f"{sf}/events.parquet")
    source.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = windowed(read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string"), "ts", "1 hour", "1 hour", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM hourly").first()[0] == source.count()


def test_csv_round_trip(spark, tmp_path):
    from quillon.sources import tables as T

    df = spark.createDataFrame([(1, 'a,"b"'), (2, "line")], "id int, s string")
    T.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), schema="id int, s string", header=True, quote='"', escape='"')
    assert sorted(back.collect()) == sorted(df.collect())


@pytest.mark.parametrize(("text", "want"), [("1 + 2 * 3", 7), ("(1 + 2) * 3 - -1", 10), ("n % 3 == 1 ? 'a' : 'b'", "a"), ("Iif(n > 5, Upper('x'), 'y')", "X"), ("Len(Trim('  ab '))", 2), ("n / 0", None), ("Sum(n) - Max(n)", 5), ("!(n > 5) || n == 7", True), ("Format(1234.5, '0.00')", "1,234.50")])
def test_report_expression(spark, text, want):
    from quillon.operators.report_expr import with_expression

    df = spark.createDataFrame([(7,), (5,)], "n int")
    assert with_expression(df, "x", text).where("n = 7").first().x == want


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 ? 2", "nope(1)", "1 2", "Upper('a'"])
def test_report_expression_errors(spark, text):
    from quillon.operators.report_expr import Bad, with_expression

    with pytest.raises(Bad):
        with_expression(spark.range(1), "x", text)
