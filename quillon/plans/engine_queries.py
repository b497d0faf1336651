"""The engine's own features: statements that change, constrain, prepare and inspect, each ending in a table."""

from __future__ import annotations

import uuid

from quillon.engine import Database
from quillon.errors import EngineError
from quillon.operators import relational
from quillon.plans.registry import query
from quillon.sources import tables as T


def _database(t, *names: str) -> Database:
    db = Database(t.spark)
    db.attach_frames({n: t(n) for n in names})
    return db


@query("SELECT c_custkey::BIGINT AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal >= 0")
def sql_constraints(t):
    db = _database(t, "customer")
    db.exec("CREATE TABLE c(k INTEGER PRIMARY KEY, name TEXT NOT NULL, bal REAL CHECK(bal >= 0))")
    db.exec("INSERT OR IGNORE INTO c SELECT c_custkey, c_name, c_acctbal FROM customer")
    db.exec("INSERT OR IGNORE INTO c SELECT c_custkey, 'again', 1.0 FROM customer WHERE c_acctbal >= 0")
    return db.get("c")


@query("SELECT n_nationkey::BIGINT AS k, 'q' AS tag, (n_nationkey * 2)::BIGINT AS twice FROM nation")
def sql_defaults(t):
    db = _database(t, "nation")
    db.exec("CREATE TABLE d(k INTEGER, tag TEXT DEFAULT 'q', twice AS (k * 2)); INSERT INTO d(k) SELECT n_nationkey FROM nation")
    return db.get("d")


@query("SELECT s_suppkey::BIGINT AS k, s_nationkey::BIGINT AS n FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def sql_foreign_keys(t):
    db = _database(t, "nation", "supplier")
    db.exec("PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY, r INTEGER); CREATE TABLE s(k INTEGER, n INTEGER REFERENCES p ON DELETE CASCADE)")
    db.exec("INSERT INTO p SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO s SELECT s_suppkey, s_nationkey FROM supplier; DELETE FROM p WHERE r = 1")
    return db.get("s")


@query("SELECT row_number() OVER (ORDER BY r_name) AS id, r_name AS name FROM region")
def sql_numbered_key(t):
    db = _database(t, "region")
    db.exec("CREATE TABLE r(id INTEGER PRIMARY KEY, name TEXT); INSERT INTO r(name) SELECT r_name FROM region ORDER BY r_name")
    return db.get("r")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = (SELECT max(n_nationkey) FROM nation) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def sql_with_update(t):
    db = _database(t, "nation", "supplier")
    db.exec("WITH last AS (SELECT max(n_nationkey) AS k FROM nation) UPDATE supplier SET s_acctbal = 0.0 WHERE s_nationkey = (SELECT k FROM last)")
    return db.get("supplier").select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 4 OFFSET 1)")
def sql_delete_limit(t):
    db = _database(t, "supplier")
    db.exec("DELETE FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 4 OFFSET 1")
    return db.get("supplier").select("s_suppkey")


@query("SELECT 5::BIGINT AS changed, 30::BIGINT AS total, 25::BIGINT AS rowid")
def sql_change_counters(t):
    db = _database(t, "nation", "region")
    db.exec("CREATE TABLE n(id INTEGER PRIMARY KEY, name TEXT); INSERT INTO n(name) SELECT n_name FROM nation; DELETE FROM region")
    return db.exec("SELECT changes() AS changed, total_changes() AS total, last_insert_rowid() AS rowid").df


@query("SELECT unnest(range(3, 8))::BIGINT AS n")
def sql_recursive_limit(t):
    return Database(t.spark).exec("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c LIMIT 5 OFFSET 2) SELECT n FROM c").df


@query("SELECT event_id, ((props->>'$.k')::BIGINT > 50)::INT AS above, 'integer' AS class FROM events")
def sql_json_classes(t):
    return _database(t, "events").exec("SELECT event_id, CAST(json_extract(props, '$.k') > 50 AS INTEGER) AS above, typeof(json_extract(props, '$.k')) AS class FROM events").df


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def prepared_statement(t):
    db = _database(t, "nation")
    return db.prepare("SELECT n_name FROM nation WHERE n_regionkey = ?1 AND n_nationkey > :least").bind(2, least=5).exec().df


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def transaction_savepoints(t):
    db = _database(t, "region")
    db.exec("BEGIN; DELETE FROM region WHERE r_regionkey = 0; SAVEPOINT s; DELETE FROM region; ROLLBACK TO s; RELEASE s; COMMIT; BEGIN; DELETE FROM region; ROLLBACK")
    return db.get("region")


@query("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def attach_schema(t):
    db = Database(t.spark)
    db.exec(f"ATTACH DATABASE '{t.sf_dir}' AS data; REINDEX; ANALYZE data_region")
    return db.exec("SELECT count(*) AS n FROM data.nation JOIN data.region ON n_regionkey = r_regionkey").df


@query("SELECT n_nationkey, n_name FROM nation")
def vacuum_into(t):
    db = _database(t, "nation")
    relational.checkpoint_folder(t.spark)
    folder = f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vacuum-{uuid.uuid4().hex}"
    db.exec(f"VACUUM INTO '{folder}'")
    return t.spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3")
def streamed_rows(t):
    rows: list = []
    _database(t, "region").exec("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey").each(lambda r: rows.append(tuple(r)) or len(rows) < 3)
    return t.spark.createDataFrame(rows, "r_regionkey int, r_name string")


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey,n_name,n_regionkey'), ('region', 'r_regionkey,r_name')) v(name, columns)")
def catalog_tables(t):
    db = _database(t, "nation", "region")
    return T.values(t.spark, [(n, ",".join(r.name for r in db.table(n).collect())) for n in db.tables()], ["string", "string"]).toDF("name", "columns")


@query("SELECT 1 AS found")
def explain_plan(t):
    plan = _database(t, "nation").exec("EXPLAIN QUERY PLAN SELECT n_name FROM nation WHERE n_nationkey = 3").df
    return plan.where("detail like '%PushedFilters%n_nationkey%'").limit(1).selectExpr("1 AS found")


@query("""SELECT * FROM (VALUES (0, 'region', 'r', 'r_regionkey', 'CASCADE')) v(id, parent, child_column, parent_column, on_delete)""")
def pragma_foreign_keys(t):
    db = _database(t, "region")
    db.exec("CREATE TABLE c(r INTEGER REFERENCES region(r_regionkey) ON DELETE CASCADE)")
    return db.exec("PRAGMA foreign_key_list(c)").df.selectExpr("id", "`table` AS parent", "`from` AS child_column", "`to` AS parent_column", "on_delete")


@query("""SELECT * FROM (VALUES ('CHECK constraint failed: bal'), ('non-unique entry in c(k)')) v(integrity_check)""")
def pragma_integrity_check(t):
    db = Database(t.spark)
    db.exec("CREATE TABLE c(k INTEGER UNIQUE, v INTEGER, CONSTRAINT bal CHECK(v > 0))")
    db.put("c", t.spark.sql("SELECT * FROM VALUES (1L, 1L), (1L, 2L), (2L, -1L) v(k, v)"))
    return db.exec("PRAGMA integrity_check").df


@query("""SELECT * FROM (VALUES (0, 'syntax'), (1, 'no such table'), (2, 'no such column'), (3, 'error'), (4, 'misuse'), (5, 'constraint'), (6, 'error')) v(statement, code)""")
def error_codes(t):
    db = _database(t, "nation")
    db.exec("CREATE TABLE k(a INTEGER NOT NULL)")
    statements = (
        "SELEC 1", "SELECT * FROM nowhere", "SELECT nope FROM nation", "SELECT nosuch(1)", "SELECT n_name FROM nation WHERE sum(n_nationkey) > 1",
        "INSERT INTO k VALUES (NULL)", "SELECT load_extension('x')",
    )
    found = []
    for i, sql in enumerate(statements):
        try:
            db.exec(sql)
        except EngineError as e:
            found.append((i, e.code))
    return t.spark.createDataFrame(found, "statement int, code string")


@query("""SELECT 'integer' AS random_class, 5::BIGINT AS blob_bytes, '0000' AS blob_hex, 3::BIGINT AS octets, 7::BIGINT AS hint, '"a"' AS quoted, 10::BIGINT AS day, 8::BIGINT AS clock, 19::BIGINT AS moment""")
def sql_small_functions(t):
    return Database(t.spark).exec(
        "SELECT typeof(random()) AS random_class, length(zeroblob(5)) AS blob_bytes, hex(zeroblob(2)) AS blob_hex, octet_length('é1') AS octets, likely(7) AS hint, "
        "json_quote('a') AS quoted, length(current_date) AS day, length(current_time) AS clock, length(current_timestamp) AS moment"
    ).df


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS month, strftime(o_orderdate, '%H:%M:%S.000') AS fraction FROM orders""")
def sql_date_spans(t):
    return _database(t, "orders").exec(
        "SELECT o_orderkey, datetime(o_orderdate, '+01:30') AS later, date(o_orderdate, '+0000-00-10') AS month, time(o_orderdate, 'utc', 'subsec') AS fraction FROM orders"
    ).df


@query("""SELECT '[{"r_regionkey":0,"r_name":"AFRICA"},{"r_regionkey":1,"r_name":"AMERICA"}]' AS json""")
def result_to_json(t):
    result = _database(t, "region").exec("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 2")
    return t.spark.createDataFrame([(result.to_json(["r_regionkey"]),)], "json string")
