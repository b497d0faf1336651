"""Row changes, constraints, statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import dml as M
from quillon.operators import report as R
from quillon.operators.report_expr import with_expression
from quillon.plans.registry import query

_BASE = "SELECT c_custkey, c_name, c_acctbal FROM customer"
_NEW = "SELECT 2 * c_custkey AS c_custkey, 'new ' || c_name AS c_name, c_acctbal + 1 AS c_acctbal FROM customer"
_WITH = f"WITH old AS ({_BASE}), new AS ({_NEW})"


def _tables(t):
    columns = ("c_custkey", "c_name", "c_acctbal")
    old = t("customer").select(*columns)
    new = t("customer").select((2 * F.col("c_custkey")).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return old, new


@query(f"{_WITH} SELECT * FROM old UNION ALL SELECT -1 - c_custkey, c_name, c_acctbal FROM new")
def dml_insert(t):
    old, new = _tables(t)
    return M.insert(old, new.withColumn("c_custkey", -1 - F.col("c_custkey")), ["c_custkey"])


@query(f"{_WITH} SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def dml_insert_ignore(t):
    return M.insert(*_tables(t), ["c_custkey"], "ignore")


@query(f"{_WITH} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new")
def dml_insert_replace(t):
    return M.insert(*_tables(t), ["c_custkey"], "replace")


@query(f"""{_WITH} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name,
  CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND o.c_acctbal > 0 THEN o.c_acctbal + n.c_acctbal ELSE coalesce(o.c_acctbal, n.c_acctbal) END AS c_acctbal FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def dml_upsert(t):
    return M.upsert(*_tables(t), ["c_custkey"], {"c_acctbal": F.col("old.c_acctbal") + F.col("excluded.c_acctbal")}, F.col("old.c_acctbal") > 0)


@query(f"{_WITH} SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM old")
def dml_update(t):
    return M.update(_tables(t)[0], {"c_name": F.upper("c_name"), "c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)


@query(f"{_WITH} SELECT o.c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE o.c_acctbal + n.c_acctbal END AS c_acctbal FROM old o LEFT JOIN new n ON o.c_custkey = n.c_custkey")
def dml_update_from(t):
    old, new = _tables(t)
    return M.update_from(old, new, ["c_custkey"], {"c_name": F.col("source.c_name"), "c_acctbal": F.col("old.c_acctbal") + F.col("source.c_acctbal")})


@query(f"{_WITH} SELECT * FROM old WHERE NOT coalesce(c_acctbal < 0, FALSE)")
def dml_delete(t):
    return M.delete(_tables(t)[0], F.col("c_acctbal") < 0)


@query(f"{_WITH} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM old WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25)")
def dml_delete_limit(t):
    return M.delete_limited(_tables(t)[0], F.col("c_acctbal") > 0, ["c_custkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 25)


@query(f"{_WITH} SELECT c_custkey, c_acctbal + 10 AS c_acctbal FROM old WHERE c_acctbal < 0")
def dml_returning(t):
    old = _tables(t)[0]
    return M.returning(old, M.update(old, {"c_acctbal": F.col("c_acctbal") + 10}, F.col("c_acctbal") < 0), ["c_custkey"], "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def fk_check(t):
    return M.foreign_key_violations(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], t("customer").where("c_nationkey <> 3"), ["c_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def fk_cascade(t):
    return M.on_delete(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], t("customer").where("c_nationkey = 3"), ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fk_set_null(t):
    return M.on_delete(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], t("customer").where("c_nationkey = 3"), ["c_custkey"], "set null")


@query("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def unique_check(t):
    return M.unique_violations(t("lineitem"), ["l_orderkey"])


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > -500)")
def constraint_check(t):
    return M.check_violations(t("customer"), F.col("c_acctbal") > -500).select("c_custkey")


@query("SELECT n_nationkey, n_name AS name, n_regionkey, 'x' AS tag, n_nationkey * 2 AS twice FROM nation")
def alter_and_generated(t):
    out = M.rename_column(M.add_column(t("nation"), "tag", "string", F.lit("x")), "n_name", "name")
    return M.generated(out, {"twice": F.col("n_nationkey") * 2}).select("n_nationkey", "name", "n_regionkey", "tag", "twice")


@query("""SELECT 'lineitem' AS tbl, 'l_key' AS idx, count(*)::VARCHAR || ' ' || ceil(count(*)::DOUBLE / count(DISTINCT l_returnflag))::BIGINT || ' ' || ceil(count(*)::DOUBLE / count(DISTINCT (l_returnflag, l_linestatus)))::BIGINT AS stat FROM lineitem""")
def analyze_statistics(t):
    return M.index_statistics(t("lineitem"), "lineitem", "l_key", ["l_returnflag", "l_linestatus"])


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS "O", round(sum(l_quantity), 2) AS total, grouping(l_returnflag)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def report_matrix(t):
    return R.matrix(t("lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", values=["F", "O"]).select("l_returnflag", *(F.round(c, 2).alias(c) for c in ("F", "O", "total")), "level")


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS s, (grouping(r_name) + grouping(n_name))::INT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def report_subtotals(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.grouped(joined, ["r_name", "n_name"], {"n": F.count("*"), "s": F.round(F.sum("c_acctbal"), 2)})


@query("""SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS of_status, round(n / sum(n) OVER (), 6) AS of_all FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)""")
def report_share(t):
    counts = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    n = F.col("n")
    shares = R.with_share(R.with_share(counts, n, "of_status", "o_orderstatus"), n, "of_all")
    return shares.select("o_orderstatus", "o_orderpriority", "n", F.round("of_status", 6).alias("of_status"), F.round("of_all", 6).alias("of_all"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def report_parameters(t):
    out = t("customer").select("c_custkey", "c_mktsegment")
    return R.optional_filter(R.optional_filter(out, "c_mktsegment", "MACHINERY"), "c_custkey", None)


@query("""SELECT n_name, r_name, c, round(c::DOUBLE / sum(c) OVER (PARTITION BY r_name), 6) AS share, CASE WHEN c > avg(c) OVER () THEN upper(substr(n_name, 1, 3)) ELSE 'low' END AS mark FROM (SELECT n_name, r_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)""")
def report_expressions(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = joined.groupBy("n_name", "r_name").agg(F.count("*").alias("c"))
    return with_expression(with_expression(counts, "share", "Round(c / Sum(c), 6)", ("r_name",)), "mark", "c > Avg(c) ? Upper(Substring(n_name, 1, 3)) : 'low'")
