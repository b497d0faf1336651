"""The SQL front against Python's own sqlite3 on the same tables and statements."""

import sqlite3

import pyarrow.parquet as pq
import pytest

from quillon.engine import Database
from quillon.errors import EngineError
from quillon.plans import syntax

TABLES = ("region", "nation", "customer", "orders", "supplier", "part", "events")

QUERIES = """
SELECT 7/2, -7/2, 7.0/2, 1/0, 7%3, 7.5%2, 'abc'||1.0, 5 & 3, 1<<4, -8>>70, ~5
SELECT CAST('12abc' AS INTEGER), CAST('3.9' AS REAL), CAST(3.9 AS INTEGER), CAST(5 AS TEXT), typeof(1), typeof(1.5), typeof('x'), typeof(NULL), typeof(1=1)
SELECT 1 IN (), NULL IN (), 1 IN (1,NULL), 2 NOT IN (1,NULL), NULL IS NULL, 1 IS 1, 1 IS NOT 2, 3 BETWEEN 1 AND 5, 'abc' LIKE 'A%', 'abc' GLOB 'a*', 'a' ISNULL
SELECT max(1,2,NULL), min(3,1,2), coalesce(NULL,2), ifnull(NULL,'x'), iif(1>2,'a','b'), nullif(1,1), abs(-5), abs('x'), round(2.5), round(-2.567,2), sign(-3)
SELECT substr('hello',2,3), substr('hello',-3), substr('hello',0,3), substr('hello',3,-2), upper('abé'), lower('ABÉ'), trim('  x '), ltrim('xxa','x'), replace('abc','b','zz'), instr('hello','l'), hex('abc'), length('héllo'), unicode('A'), char(65,66)
SELECT quote('it''s'), quote(1.5), quote(NULL), printf('%05d|%-5s|%.2f', 42, 'ab', 3.14159), format('%x', 255), soundex('Robert')
SELECT date('2024-01-31','+1 month'), datetime('2024-02-29 12:34:56'), time('12:00'), julianday('2000-01-01'), strftime('%Y/%m/%d %H', '2024-03-04 05:06:07'), date('bad'), date('2024-03-10','weekday 0'), datetime(0,'unixepoch','+1 day')
SELECT json('{"a" : [1,2]}'), json_array(1,'x',NULL,2.5), json_object('a',1,'b','c'), json_type('{"a":1}','$.a'), json_array_length('[1,2,3]'), '{"a":{"b":1}}' -> 'a', '{"a":"t"}' ->> 'a', json_set('{}','$.x',1), json_remove('[1,2,3]','$[0]')
SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_name
SELECT r_name AS r, count(*) AS n FROM region, nation WHERE r_regionkey = n_regionkey GROUP BY r ORDER BY n DESC, r LIMIT 2, 2
SELECT c_nationkey, max(c_acctbal), c_name FROM customer GROUP BY c_nationkey
SELECT c_mktsegment, total(c_nationkey), avg(c_nationkey), count(DISTINCT c_nationkey), sum(c_nationkey) FILTER (WHERE c_acctbal > 0) FROM customer GROUP BY 1 HAVING count(*) > 5
SELECT count(*), sum(o_totalprice), max(o_orderkey) FROM orders WHERE o_orderkey < 0
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_acctbal > 0
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_custkey < 10
SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn, lag(n_name) OVER w, sum(n_nationkey) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)
SELECT n_nationkey, rank() OVER (ORDER BY n_regionkey), count(*) FILTER (WHERE n_nationkey > 5) OVER (ORDER BY n_nationkey), ntile(3) OVER (ORDER BY n_nationkey) FROM nation
SELECT 1 AS k UNION SELECT 2 INTERSECT SELECT 2
SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region EXCEPT SELECT 3 ORDER BY 1 DESC
WITH RECURSIVE c(n) AS (VALUES(1) UNION ALL SELECT n+1 FROM c WHERE n < 10) SELECT n, n*n FROM c
WITH RECURSIVE c(a, b) AS (SELECT n_nationkey, n_nationkey % 5 FROM nation UNION SELECT c.b, n.n_regionkey FROM c JOIN nation n ON n.n_nationkey = c.b) SELECT a, b FROM c ORDER BY 1, 2
WITH a AS (SELECT n_name x FROM nation), b(y) AS (SELECT x FROM a WHERE x > 'M') SELECT y FROM b
VALUES (1,'a'),(2,'b'),(3,NULL)
SELECT * FROM (SELECT n_nationkey k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey k, s_name FROM supplier) b
SELECT * FROM (SELECT n_nationkey k, n_name FROM nation) LEFT JOIN (SELECT s_nationkey k, s_name FROM supplier) USING (k)
SELECT p_partkey FROM part WHERE p_size = 5 OR p_size IN (7,9) AND NOT p_retailprice > 1000
SELECT o_orderpriority, CASE WHEN count(*) > 300 THEN 'many' ELSE 'few' END FROM orders GROUP BY o_orderpriority
SELECT c_custkey FROM customer WHERE c_acctbal > '9000'
SELECT p_partkey FROM part WHERE p_size = '5'
SELECT p_name FROM part WHERE p_name = 5
SELECT (1,2) < (1,3), (1,2) = (1,2), (1,NULL) = (2,NULL)
SELECT c_name FROM customer WHERE c_name LIKE '%0000001%' ORDER BY c_name COLLATE NOCASE DESC LIMIT 3
SELECT x, y FROM (SELECT n_nationkey % 3 AS x, count(*) AS y FROM nation GROUP BY x) WHERE y > 8
SELECT n_regionkey + 1 AS k FROM nation WHERE k = 2
SELECT count(n_nationkey), n_regionkey FROM nation GROUP BY n_regionkey ORDER BY count(n_nationkey), n_regionkey DESC
SELECT a.n_name, b.n_name FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_nationkey + 20 WHERE b.n_name IS NULL
SELECT 9223372036854775807, 0x1F, 1e3, .5, 'a''b', "n_name" FROM nation LIMIT 1
SELECT first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) FROM nation
SELECT s_name, n.n_name FROM supplier s CROSS JOIN nation n WHERE s.s_nationkey == n.n_nationkey AND s_acctbal <> 0
SELECT n_name FROM nation WHERE (SELECT max(n_nationkey) FROM nation) = n_nationkey
SELECT o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY 1, 2 HAVING max(o_totalprice) > 100000 ORDER BY 3 DESC, 1, 2
SELECT n_regionkey, group_concat(n_nationkey) FROM (SELECT * FROM nation WHERE n_nationkey < 1) GROUP BY n_regionkey
""".strip().split("\n")

ERRORS = ("SELECT nope FROM nation", "SELECT * FROM nowhere", "SELEC 1", "SELECT nosuch(1)", "SELECT 1 UNION SELECT 1, 2", "SELECT sum(n_nationkey) FROM nation WHERE sum(n_nationkey) > 1", "SELECT n_nationkey FROM nation a, nation b", "SELECT (SELECT 1", "SELECT * FROM nation JOIN region USING (nope)")

CHANGES = """
CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT, n INTEGER)
INSERT INTO t VALUES (1, 'a', 10), (2, 'b', NULL), (3, 'c', 30)
INSERT INTO t(id, name) SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1
INSERT OR IGNORE INTO t VALUES (1, 'zz', 0), (9, 'nine', 9)
INSERT OR REPLACE INTO t VALUES (2, 'bb', 22)
INSERT INTO t VALUES (3, 'x', 1), (50, 'fifty', 5) ON CONFLICT(id) DO UPDATE SET n = n + excluded.n, name = excluded.name
INSERT INTO t VALUES (1, 'never', 1) ON CONFLICT(id) DO NOTHING
UPDATE t SET n = id * 2, name = upper(name) WHERE n IS NULL
UPDATE t SET (name, n) = ('row', 7) WHERE id = 9
UPDATE t SET n = s.s_suppkey FROM supplier s WHERE s.s_suppkey = t.id
DELETE FROM t WHERE n > 200
ALTER TABLE t ADD COLUMN extra TEXT DEFAULT 'e'
ALTER TABLE t RENAME COLUMN extra TO more
CREATE TABLE u AS SELECT id, n FROM t WHERE id < 10
CREATE VIEW v AS SELECT name FROM t WHERE id > 100
ALTER TABLE u RENAME TO w
""".strip().split("\n")


@pytest.fixture(scope="module")
def both(spark, sf):
    con = sqlite3.connect(":memory:", isolation_level=None)
    for t in TABLES:
        d = pq.read_table(f"{sf}/{t}.parquet").to_pandas()
        d.drop(columns=[c for c in d.columns if str(d[c].dtype).startswith("datetime")]).to_sql(t, con, index=False)
    return Database(spark, sf), con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("sql", QUERIES)
def test_query(both, sql):
    db, con = both
    got, want = plain(map(tuple, db.exec(sql).rows())), plain(con.execute(sql).fetchall())
    assert list(map(repr, got)) == list(map(repr, want))


@pytest.mark.parametrize("sql", ERRORS)
def test_error(both, sql):
    db, con = both
    with pytest.raises(sqlite3.Error):
        con.execute(sql)
    with pytest.raises(EngineError):
        db.exec(sql)


def test_names_and_json_columns(both):
    db, _ = both
    assert db.exec("SELECT n_name, n_nationkey+1, count(*) AS c FROM nation GROUP BY 1, 2").columns == ["n_name", "n_nationkey+1", "c"]
    rows = db.exec("SELECT e.event_id, j.key, CAST(j.value AS INTEGER) FROM events e, json_each(e.props) j WHERE e.event_id < 3").rows()
    assert len(rows) == 3 and {r[1] for r in rows} == {"k"}
    assert db.exec("SELECT json_extract('{\"a\":[1,2]}', '$.a[1]')").scalar() == "2"


def test_for_json_auto(both):
    db, _ = both
    got = db.exec("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey < 3 ORDER BY r_name, n_name FOR JSON AUTO, ROOT('x')").scalar()
    assert got == '{"x":[{"r_name":"AFRICA","nation":[{"n_name":"NATION_0"}]},{"r_name":"AMERICA","nation":[{"n_name":"NATION_1"}]},{"r_name":"ASIA","nation":[{"n_name":"NATION_2"}]}]}'
    assert db.exec("SELECT r_name FROM region WHERE r_regionkey = 0 FOR JSON AUTO").scalar() == '[{"r_name":"AFRICA"}]'


def test_changes(spark, sf):
    con = sqlite3.connect(":memory:", isolation_level=None)
    for t in ("nation", "supplier"):
        pq.read_table(f"{sf}/{t}.parquet").to_pandas().to_sql(t, con, index=False)
    db = Database(spark, sf)
    for sql in CHANGES:
        db.exec(sql)
        con.execute(sql)
        for name in ("t", "w", "v"):
            if name in db.tables():
                assert plain(map(tuple, db.exec(f"SELECT * FROM {name}").rows())) == plain(con.execute(f"SELECT * FROM {name}").fetchall()), sql
    for sql in ("DROP TABLE w", "DROP VIEW v"):
        db.exec(sql)
    assert "w" not in db.tables() and db.exec("PRAGMA table_info(t)").rows()[0].name == "id"


def test_returning_and_transactions(spark, sf):
    db = Database(spark, sf)
    assert {tuple(r) for r in db.exec("DELETE FROM region WHERE r_regionkey > 2 RETURNING r_regionkey, upper(r_name)").rows()} == {(3, "EUROPE"), (4, "MIDDLE EAST")}
    assert [r[0] for r in db.exec("INSERT INTO region VALUES (7, 'SEVEN') RETURNING r_name").rows()] == ["SEVEN"]
    db.exec("BEGIN; DELETE FROM region; ROLLBACK")
    assert db.row_count("region") == 4
    db.exec("BEGIN; DELETE FROM region WHERE r_regionkey = 7; SAVEPOINT s; DELETE FROM region; ROLLBACK TO s; COMMIT")
    assert db.row_count("region") == 3


def test_maintenance(spark, sf, tmp_path):
    db = Database(spark)
    db.exec(f"ATTACH DATABASE '{sf}' AS data")
    assert db.exec("SELECT count(*) FROM data.nation n JOIN data.region r ON n.n_regionkey = r.r_regionkey").scalar() == 25
    db.exec("CREATE TABLE t AS SELECT n_nationkey AS k FROM data.nation")
    db.exec("DELETE FROM t WHERE k < 4")
    assert db.changes == 4
    db.exec("UPDATE t SET k = 100 WHERE k = 4; ANALYZE t; REINDEX t")
    assert db.changes == 1 and db.exec("SELECT stat FROM sqlite_stat1").scalar() == "21 1"
    assert any("Scan" in r.detail or "Relation" in r.detail for r in db.exec("EXPLAIN QUERY PLAN SELECT * FROM t WHERE k > 3").rows())
    db.exec("DETACH data")
    db.exec(f"VACUUM INTO '{tmp_path}/copy'")
    assert spark.read.parquet(f"{tmp_path}/copy/t.parquet").count() == 21
    with pytest.raises(EngineError):
        db.exec("SELECT * FROM data.nation")


@pytest.mark.parametrize("sql", ["SELECT", "SELECT 1 +", "SELECT * FROM", "INSERT INTO t", "SELECT (1", "SELECT CASE 1", "SELECT 1 1", "UPDATE t", "SELECT a FROM b WHERE", "WITH x SELECT 1"])
def test_syntax_errors(sql):
    with pytest.raises(EngineError) as e:
        syntax.parse(sql)
    assert e.value.code == "syntax"
