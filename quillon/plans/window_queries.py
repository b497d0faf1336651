"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import windows as W
from quillon.plans.registry import query

_C = "FROM customer"
_BY = "PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey"


def _by(*order):
    return W.Over((F.col("c_nationkey"),), tuple(order) or (F.col("c_acctbal"), F.col("c_custkey")))


def _segment():
    return W.Over((F.col("c_nationkey"),), (F.col("c_mktsegment"),))


@query(f"""SELECT c_custkey, row_number() OVER ({_BY}) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr {_C}""")
def win_rank_family(t):
    seg = W.ordered(_segment())
    return t("customer").select("c_custkey", F.row_number().over(W.ordered(_by())).alias("rn"), F.rank().over(seg).alias("rk"), F.dense_rank().over(seg).alias("dr"))


@query(f"""SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 9) AS cd, ntile(4) OVER ({_BY}) AS nt {_C}""")
def win_ntile_dist(t):
    seg = W.ordered(_segment())
    return t("customer").select("c_custkey", F.round(F.percent_rank().over(seg), 9).alias("pr"), F.round(F.cume_dist().over(seg), 9).alias("cd"), F.ntile(4).over(W.ordered(_by())).alias("nt"))


@query(f"""SELECT c_custkey, lag(c_acctbal) OVER ({_BY}) AS before, lead(c_acctbal, 2) OVER ({_BY}) AS after, lag(c_custkey, 3, -1::BIGINT) OVER ({_BY}) AS third {_C}""")
def win_lag_lead(t):
    w = W.ordered(_by())
    return t("customer").select("c_custkey", F.lag("c_acctbal").over(w).alias("before"), F.lead("c_acctbal", 2).over(w).alias("after"), F.lag("c_custkey", 3, -1).over(w).alias("third"))


@query("""SELECT s_suppkey, lag(s_acctbal, (s_suppkey % 3)::INT) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS back FROM supplier""")
def win_lag_per_row(t):
    spec = W.Over((F.col("s_nationkey"),), (F.col("s_suppkey"),))
    return W.lag_by(t("supplier"), F.col("s_acctbal"), F.col("s_suppkey") % 3, spec, "back").select("s_suppkey", "back")


@query(f"""SELECT c_custkey, first_value(c_custkey) OVER w AS f, last_value(c_custkey) OVER w AS l, nth_value(c_custkey, 2) OVER w AS n2 {_C} WINDOW w AS ({_BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def win_first_last_nth(t):
    w = _by().extend(unit="rows", start=-2, end=2).spec()
    return t("customer").select("c_custkey", F.first("c_custkey").over(w).alias("f"), F.last("c_custkey").over(w).alias("l"), F.nth_value("c_custkey", 2).over(w).alias("n2"))


@query(f"""SELECT c_custkey, round(sum(c_acctbal) OVER ({_BY} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS n {_C}""")
def win_rows(t):
    back, on = _by().extend(unit="rows", start=-3, end=0).spec(), _by().extend(unit="rows", start=1, end=3).spec()
    return t("customer").select("c_custkey", F.round(F.sum("c_acctbal").over(back), 2).alias("s"), F.count("*").over(on).alias("n"))


@query(f"""SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near {_C}""")
def win_range(t):
    w = _by(F.col("c_acctbal")).extend(unit="range", start=-500, end=500).spec()
    return t("customer").select("c_custkey", F.count("*").over(w).alias("near"))


@query(f"""SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n {_C}""")
def win_groups(t):
    df, spec = W.prepared(t("customer"), _segment().extend(unit="groups", start=-1, end=1))
    return df.select("c_custkey", F.count("*").over(spec.spec()).alias("n"))


@query(f"""SELECT c_custkey, sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)::BIGINT AS cur,
  sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP)::BIGINT AS grp,
  count(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS ties {_C}""")
def win_exclude(t):
    key = F.col("c_custkey")
    base = _segment()
    df, cur = W.prepared(t("customer"), base.extend(unit="groups", start=-1, end=0, exclude="current row"))
    grp, ties = (W.replace(cur, exclude=x) for x in ("group", "ties"))
    return df.select("c_custkey", W.excluded_sum(key, cur).alias("cur"), W.excluded_sum(key, grp).alias("grp"), W.excluded_count(key, ties).alias("ties"))


@query(f"""SELECT c_custkey, count(*) FILTER (WHERE c_acctbal < 0) OVER ({_BY}) AS debtors, max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') OVER (PARTITION BY c_nationkey) AS best {_C}""")
def win_filter(t):
    whole = W.Over((F.col("c_nationkey"),))
    return t("customer").select(
        "c_custkey", W.filtered(F.count, F.lit(1), F.col("c_acctbal") < 0, _by()).alias("debtors"),
        W.filtered(F.max, F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING", whole).alias("best"),
    )


@query(f"""SELECT c_custkey, count(*) OVER w AS n, sum(c_custkey) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS two {_C} WINDOW w AS ({_BY})""")
def win_named(t):
    w = _by()
    return t("customer").select("c_custkey", F.count("*").over(w.spec()).alias("n"), F.sum("c_custkey").over(w.extend(unit="rows", start=-1, end=0).spec()).alias("two"))


@query("""SELECT o_orderpriority, y, n, rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, y) AS place FROM (SELECT o_orderpriority, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2)""")
def win_over_grouped(t):
    grouped = t("orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return grouped.withColumn("place", F.rank().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("n"), "y")))


@query(f"""SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS mean, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 2) AS running {_C}""")
def win_default_frame(t):
    return t("customer").select("c_custkey", F.round(F.avg("c_acctbal").over(W.Over((F.col("c_nationkey"),)).spec()), 4).alias("mean"), F.round(F.sum("c_acctbal").over(_segment().spec()), 2).alias("running"))


@query("""SELECT n_nationkey, string_agg(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names FROM nation""")
def win_group_concat(t):
    spec = W.Over((F.col("n_regionkey"),), (F.col("n_name"),), "rows", None, 0)
    return t("nation").select("n_nationkey", W.group_concat_over(F.col("n_name"), "|", spec).alias("names"))


@query(f"""SELECT c_custkey, count(*) OVER ({_BY} ROWS BETWEEN 9223372036854775 PRECEDING AND CURRENT ROW) AS n {_C}""")
def win_huge_offset(t):
    return t("customer").select("c_custkey", F.count("*").over(_by().extend(unit="rows", start=-9223372036854775807, end=0).spec()).alias("n"))
