"""The SQL front: the same kind of queries as statements of the dialect."""

from __future__ import annotations

from quillon.engine import Database
from quillon.plans.registry import query


def _run(t, sql: str, *names: str):
    db = Database(t.spark)
    db.attach_frames({n: t(n) for n in names})
    return db.exec(sql).df


@query("""SELECT r_name, count(*) AS n, min(n_name) AS first FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) > 2""")
def sql_group(t):
    return _run(t, "SELECT r_name, count(*) AS n, min(n_name) AS first FROM region, nation WHERE r_regionkey == n_regionkey GROUP BY 1 HAVING n > 2", "region", "nation")


@query("""SELECT o_orderkey, o_orderkey::BIGINT // 7 AS quotient, o_orderkey % 7 AS rest, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS class FROM orders WHERE o_orderkey >= '0'""")
def sql_expressions(t):
    return _run(t, "SELECT o_orderkey, o_orderkey / 7 AS quotient, o_orderkey % 7 AS rest, iif(o_totalprice > 200000, 'high', 'low') AS class FROM orders WHERE o_orderkey >= '0'", "orders")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, count(*) FILTER (WHERE c_acctbal < 0) OVER (PARTITION BY c_nationkey) AS debtors FROM customer""")
def sql_windows(t):
    return _run(t, "SELECT c_custkey, row_number() OVER (w ORDER BY c_acctbal, c_custkey) AS rn, count(*) FILTER (WHERE c_acctbal < 0) OVER w AS debtors FROM customer WINDOW w AS (PARTITION BY c_nationkey)", "customer")


@query("""SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def sql_subqueries(t):
    return _run(t, "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "customer", "orders", "nation")


@query("""WITH RECURSIVE c(n, s) AS (SELECT 1::BIGINT, '1' UNION ALL SELECT n + 1, s || ',' || (n + 1) FROM c WHERE n < 12) SELECT n, s FROM c""")
def sql_recursive(t):
    return _run(t, "WITH RECURSIVE c(n, s) AS (VALUES (1, '1') UNION ALL SELECT n + 1, s || ',' || (n + 1) FROM c WHERE n < 12) SELECT n, s FROM c")


@query("""(SELECT n_name AS k FROM nation UNION SELECT r_name FROM region) EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 2""")
def sql_compound(t):
    return _run(t, "SELECT n_name AS k FROM nation UNION SELECT r_name FROM region EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY k", "nation", "region")


@query("""SELECT event_id, 'k' AS key, (props->>'$.k')::VARCHAR AS value, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def sql_json_dates(t):
    return _run(t, "SELECT e.event_id, j.key, j.value, date(e.ts) AS day FROM events e, json_each(e.props) j", "events")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 7 UNION ALL SELECT -1, 1.5""")
def sql_changes(t):
    db = Database(t.spark)
    db.attach_frames({"customer": t("customer")})
    db.exec("CREATE TABLE c AS SELECT c_custkey, c_acctbal FROM customer; UPDATE c SET c_acctbal = 0.0 WHERE c_acctbal < 0; DELETE FROM c WHERE c_custkey = 7; INSERT INTO c VALUES (-1, 1.5)")
    return db.get("c")


@query("""SELECT '[' || string_agg('{"r_name":"' || r_name || '"}', ',' ORDER BY r_name) || ']' AS json FROM region""")
def sql_for_json(t):
    return _run(t, "SELECT r_name FROM region ORDER BY r_name FOR JSON PATH", "region")


@query("""SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near,
  count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS before,
  sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS beside FROM customer""")
def sql_groups_exclude(t):
    return _run(
        t,
        "SELECT c_custkey, count(*) OVER w AS near, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS before, "
        "sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS beside "
        "FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)",
        "customer",
    )
