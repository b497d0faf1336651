"""Scans, projections, joins, aggregation, sorting, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators import aggregates as A
from quillon.operators import relational as R
from quillon.operators import sorting as O
from quillon.plans.registry import query


# ---- scans and sources
@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45""")
def scan_filter(t):
    return t("lineitem").where("l_shipdate < timestamp_ntz'1996-01-01' and l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 299""")
def scan_key_range(t):
    return t("orders").where(F.col("o_orderkey").between(100, 299)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT * FROM customer WHERE c_custkey = 42""")
def scan_point_lookup(t):
    return t("customer").where("c_custkey = 42")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber >= 2""")
def scan_key_prefix(t):
    return t("lineitem").where("l_orderkey = 7 and l_linenumber >= 2").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'""")
def scan_index_equality(t):
    return t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_size FROM part WHERE p_size = 5 OR p_size = 7 OR p_size IN (9, 11)""")
def scan_multi_probe(t):
    return t("part").where("p_size = 5 or p_size = 7 or p_size in (9, 11)").select("p_partkey", "p_size")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def scan_in_subquery(t):
    poor = t("customer").where("c_acctbal < 0").select("c_custkey")
    return t("orders").join(poor, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R'""")
def scan_covering(t):
    return t("lineitem").where("l_returnflag = 'R'").select("l_returnflag", "l_linestatus")


@query("""SELECT n.n_name AS n_name, s.cnt AS cnt FROM nation n JOIN (SELECT c_nationkey, count(*) AS cnt FROM customer GROUP BY c_nationkey) s ON s.c_nationkey = n.n_nationkey""")
def source_subquery(t):
    counts = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("cnt"))
    return t("nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "cnt")


@query("""SELECT c_custkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000) v WHERE c_nationkey = 3""")
def source_view(t):
    name = R.fresh_name("rich")
    t("customer").where("c_acctbal > 5000").createOrReplaceTempView(name)
    return t.spark.table(name).where("c_nationkey = 3").select("c_custkey", "c_name")


@query("""SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(column1, column2)""")
def values_source(t):
    return t.values("column1, column2", "(1, 'a'), (2, 'b'), (3, NULL)")


@query("""SELECT 1 AS one, 'x' AS x""")
def source_single_row(t):
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("x"))


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 1000""")
def scan_offset_skip(t):
    return O.limit(t("orders").select("o_orderkey").orderBy("o_orderkey"), 20, 1000)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4""")
def scan_index_hint(t):
    # INDEXED BY names an access path; here the scan's filter is pushed to the files instead.
    return t("customer").hint("indexed_by_ignored").where("c_nationkey = 4").select("c_custkey", "c_name")


# ---- projection, predicates
@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, upper(l_returnflag) || '-' || l_linestatus AS flags FROM lineitem""")
def project_exprs(t):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"),
        S.concat_text(F.upper("l_returnflag"), F.lit("-"), F.col("l_linestatus")).alias("flags"),
    )


@query("""SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def project_star(t):
    n, r = t("nation").alias("n"), t("region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@query("""SELECT o_orderkey, o_totalprice / 1000 AS thousands FROM orders WHERE o_totalprice / 1000 > 400""")
def where_alias(t):
    return t("orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("thousands")).where("thousands > 400")


_MIXED = "(1, 10), (2, NULL), (3, 0), (4, -5), (5, NULL), (6, 7)"


@query(f"""SELECT id, (x > 0 AND x < 10)::INT AS both, (x > 0 OR x IS NULL)::INT AS either, (NOT x > 0)::INT AS neither FROM (VALUES {_MIXED}) v(id, x)""")
def logic_three_valued(t):
    x = F.col("x")
    return t.values("id, x", _MIXED).select("id", S.as_int((x > 0) & (x < 10)).alias("both"), S.as_int((x > 0) | x.isNull()).alias("either"), S.as_int(~(x > 0)).alias("neither"))


@query(f"""SELECT id, (x = 7)::INT AS eq, (x <> 7)::INT AS ne, (x < 7)::INT AS lt, (x >= 0)::INT AS ge FROM (VALUES {_MIXED}) v(id, x)""")
def comparisons(t):
    x = F.col("x")
    return t.values("id, x", _MIXED).select("id", *(S.as_int(e).alias(n) for n, e in (("eq", x == 7), ("ne", x != 7), ("lt", x < 7), ("ge", x >= 0))))


_PAIRS = "(1, 1, 1), (2, 1, 2), (3, NULL, 1), (4, NULL, NULL)"


@query(f"""SELECT id, (a IS NOT DISTINCT FROM b)::INT AS same, (a IS DISTINCT FROM b)::INT AS differ, (a IS NULL)::INT AS missing FROM (VALUES {_PAIRS}) v(id, a, b)""")
def is_distinct(t):
    a, b = F.col("a"), F.col("b")
    return t.values("id, a, b", _PAIRS).select("id", S.as_int(S.is_(a, b)).alias("same"), S.as_int(S.is_not(a, b)).alias("differ"), S.as_int(a.isNull()).alias("missing"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 12 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_name ILIKE '%a%'""")
def between_in_like(t):
    return t("part").where(F.col("p_size").between(10, 12) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & S.like(F.col("p_name"), "%A%")).select("p_partkey", "p_name")


@query(f"""SELECT id, 0 AS none, (x NOT IN (0, 7))::INT AS not_those FROM (VALUES {_MIXED}) v(id, x)""")
def in_empty_list(t):
    x = F.col("x")
    return t.values("id, x", _MIXED).select("id", S.as_int(S.in_list(x, [])).alias("none"), S.as_int(~S.in_list(x, [0, 7])).alias("not_those"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def not_in_null_aware(t):
    return R.not_in(t("customer").select("c_custkey"), F.col("c_custkey"), t("orders"), "o_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)""")
def not_in_with_null(t):
    members = t("orders").select(F.when(F.col("o_orderkey") != 1, F.col("o_custkey")).alias("m"))
    return R.not_in(t("customer").select("c_custkey"), F.col("c_custkey"), members, "m")


_TEXTS = "(1, 'abc'), (2, 'ABC'), (3, 'a%c'), (4, 'a_c'), (5, 'xabcx'), (6, NULL), (7, ''), (8, 'a[b]c'), (9, 'abd')"


@query(f"""SELECT id, (s ILIKE 'a%')::INT AS starts, (s ILIKE 'a\\%c' ESCAPE '\\')::INT AS percent, (s ILIKE '_b_')::INT AS middle FROM (VALUES {_TEXTS}) v(id, s)""")
def like_escape(t):
    s = F.col("s")
    return t.values("id, s", _TEXTS).select("id", *(S.as_int(S.like(s, p, e)).alias(n) for n, p, e in (("starts", "A%", None), ("percent", "a\\%c", "\\"), ("middle", "_B_", None))))


@query(f"""SELECT id, (s GLOB 'a*')::INT AS starts, (s GLOB '?b?')::INT AS middle, (s GLOB 'ab[a-c]')::INT AS ranged, (regexp_full_match(s, 'ab[^a-c]'))::INT AS other FROM (VALUES {_TEXTS}) v(id, s)""")
def glob(t):
    s = F.col("s")
    return t.values("id, s", _TEXTS).select("id", *(S.as_int(S.glob(s, p)).alias(n) for n, p in (("starts", "a*"), ("middle", "?b?"), ("ranged", "ab[a-c]"), ("other", "ab[^a-c]"))))


@query("""SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12][13]$')""")
def regexp(t):
    return t("part").where(F.regexp_like("p_brand", F.lit("#[12][13]$"))).select("p_partkey")


_NUMBERS = "(1, 7, 2), (2, -7, 2), (3, 7, -2), (4, 7, 0), (5, NULL, 2), (6, 0, 5), (7, 9223372036854775807, 10)"


@query(f"""SELECT id, a::BIGINT // nullif(b, 0)::BIGINT AS quotient, a::BIGINT % nullif(b, 0)::BIGINT AS remainder FROM (VALUES {_NUMBERS.replace("-7, 2", "-8, 2").replace("7, -2", "8, -2")}) v(id, a, b)""")
def arith_int_div_mod(t):
    rows = _NUMBERS.replace("-7, 2", "-8, 2").replace("7, -2", "8, -2")
    return t.values("id, a, b", rows).select("id", S.int_div(F.col("a"), F.col("b")).alias("quotient"), S.modulo(F.col("a"), F.col("b")).alias("remainder"))


@query("""SELECT 3::BIGINT AS a, -3::BIGINT AS b, -3::BIGINT AS c, NULL::BIGINT AS d, 1::BIGINT AS e, -1::BIGINT AS f, NULL::BIGINT AS g""")
def arith_truncation(t):
    one = t.spark.range(1)
    d = lambda a, b: S.int_div(F.lit(a), F.lit(b))
    m = lambda a, b: S.modulo(F.lit(a), F.lit(b))
    return one.select(d(7, 2).alias("a"), d(-7, 2).alias("b"), d(7, -2).alias("c"), d(1, 0).alias("d"), m(7, 2).alias("e"), m(-7, 2).alias("f"), m(1, 0).alias("g"))


@query("""SELECT 9223372036854775808.0::DOUBLE AS sum, -9223372036854775809.0::DOUBLE AS difference, 3::DOUBLE AS small, NULL::BIGINT AS exact, NULL::BIGINT AS edge""")
def arith_overflow(t):
    big = F.lit(9223372036854775807)
    return t.spark.range(1).select(
        S.add(big, F.lit(1)).alias("sum"), S.subtract(-big, F.lit(2)).alias("difference"), S.add(F.lit(1), F.lit(2)).alias("small"),
        S.add_exact(big, F.lit(1)).alias("exact"), S.int_div(F.lit(S.INT_MIN), F.lit(-1)).alias("edge"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) END AS ratio FROM lineitem""")
def arith_null_div(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(S.real_div(F.col("l_tax"), F.col("l_discount")), 4).alias("ratio"))


_BITS = "(1, 12, 10), (2, -1, 3), (3, 1, 70), (4, -8, 70), (5, 5, -1), (6, NULL, 1)"


@query(f"""SELECT id, (a::BIGINT & b::BIGINT) AS conj, (a::BIGINT | b::BIGINT) AS disj, ~(a::BIGINT) AS inv FROM (VALUES {_BITS}) v(id, a, b)""")
def bit_ops(t):
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    return t.values("id, a, b", _BITS).select("id", a.bitwiseAND(b).alias("conj"), a.bitwiseOR(b).alias("disj"), S.bit_not(a).alias("inv"))


@query("""SELECT * FROM (VALUES (1, 12288, 0), (2, -8, -1), (3, 0, 0), (4, 0, -1), (5, 2, 10), (6, NULL, NULL)) v(id, l, r)""")
def bit_shifts(t):
    out = t.values("id, a, b", _BITS).select("id", S.shift_left(F.col("a"), F.col("b")).alias("l"), S.shift_right(F.col("a"), F.col("b")).alias("r"))
    return out.select("id", F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"))


@query("""SELECT n_nationkey, n_name || ':' || n_regionkey::VARCHAR AS label FROM nation""")
def concat_text(t):
    return t("nation").select("n_nationkey", S.concat_text(F.col("n_name"), F.lit(":"), F.col("n_regionkey").cast("string")).alias("label"))


_CASTS = "(1, '12abc'), (2, ' 42 '), (3, 'abc'), (4, '-3.75x'), (5, ''), (6, NULL), (7, '1e3'), (8, '+9')"


@query("""SELECT * FROM (VALUES (1, 12, 12.0::DOUBLE), (2, 42, 42.0), (3, 0, 0.0), (4, -3, -3.75), (5, 0, 0.0), (6, NULL, NULL), (7, 1, 1000.0), (8, 9, 9.0)) v(id, i, r)""")
def cast_prefix(t):
    s = F.col("s")
    return t.values("id, s", _CASTS).select("id", S.cast_integer(s).cast("int").alias("i"), S.cast_real(s).alias("r"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 END AS code FROM part""")
def case_when(t):
    size, brand = F.col("p_size"), F.col("p_brand")
    return t("part").select("p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("class"), F.when(brand == "Brand#11", 1).when(brand == "Brand#22", 2).alias("code"))


@query(f"""SELECT id, (lower(s) = 'abc')::INT AS nocase, (rtrim(s || '  ') = 'abc')::INT AS trimmed FROM (VALUES {_TEXTS}) v(id, s)""")
def collate_nocase_rtrim(t):
    s = F.col("s")
    return t.values("id, s", _TEXTS).select("id", S.as_int(S.nocase(s) == S.nocase(F.lit("aBc"))).alias("nocase"), S.as_int(S.rtrimmed(F.concat(s, F.lit("  "))) == S.rtrimmed(F.lit("abc "))).alias("trimmed"))


@query(f"""SELECT id, (a < 1 OR (a = 1 AND b < 2))::INT AS less, (a = 1 AND b = 2)::INT AS same FROM (VALUES {_PAIRS}) v(id, a, b)""")
def row_values(t):
    a, b = F.col("a"), F.col("b")
    one, two = F.lit(1), F.lit(2)
    return t.values("id, a, b", _PAIRS).select("id", S.as_int(S.row_less([a, b], [one, two])).alias("less"), S.as_int(S.row_equal([a, b], [one, two])).alias("same"))


@query("""SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer""")
def scalar_subquery_corr(t):
    best = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    return t("customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "best")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)""")
def scalar_subquery(t):
    # An ungrouped aggregate is one row; joining it adds one column.
    limit = t("orders").agg((F.avg("o_totalprice") * 2).alias("limit"))
    return t("orders").join(F.broadcast(limit), F.col("o_totalprice") > F.col("limit")).select("o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 5 AND c_acctbal > 100""")
def bound_parameters(t):
    t("customer").createOrReplaceTempView(name := R.fresh_name("customers"))
    return t.spark.sql(f"SELECT c_custkey, c_name FROM {name} WHERE c_nationkey = :n AND c_acctbal > :least", args={"n": 5, "least": 100})


@query("""SELECT 255 AS hex, 1.5::DOUBLE AS real, 'it''s' AS text, '3132' AS blob, NULL::INT AS nothing, 1 AS yes, 0 AS no""")
def literals(t):
    return t.spark.range(1).select(
        F.lit(0xFF).alias("hex"), F.lit(1.5).alias("real"), F.lit("it's").alias("text"), F.hex(F.unhex(F.lit("3132"))).alias("blob"),
        F.lit(None).cast("int").alias("nothing"), S.as_int(F.lit(True)).alias("yes"), S.as_int(F.lit(False)).alias("no"),
    )


@query("""SELECT * FROM (VALUES (1, 1), (2, 5), (3, 3), (4, 2), (5, 4), (6, 6)) v(id, place)""")
def cross_class_order(t):
    rows = t.values("id, i, r, s, b", "(1, NULL, NULL, NULL, NULL), (2, NULL, NULL, 'abc', NULL), (3, 12, NULL, NULL, NULL), (4, NULL, 11.5D, NULL, NULL), (5, NULL, NULL, '12', NULL), (6, NULL, NULL, NULL, X'31')")
    from pyspark.sql import Window

    value = S.dynamic(F.col("i").cast("long"), F.col("r"), F.col("s"), F.col("b"))
    return rows.select("id", F.row_number().over(Window.orderBy(value)).alias("place"))


# ---- joins
_CO = "FROM customer c {} JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000"


def _customer_orders(t, how):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 300000)
    return t("customer").join(t("orders"), on, how).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice " + _CO.format("INNER"))
def join_inner(t):
    return _customer_orders(t, "inner")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice " + _CO.format("LEFT"))
def join_left(t):
    return _customer_orders(t, "left")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice " + _CO.format("RIGHT"))
def join_right(t):
    return _customer_orders(t, "right")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice " + _CO.format("FULL"))
def join_full(t):
    return _customer_orders(t, "full")


_L, _R = "(1, 'a'), (2, 'b'), (3, 'c'), (NULL, 'n')", "(2, 'x'), (3, 'y'), (3, 'z'), (5, 'w'), (NULL, 'm')"


@query(f"""SELECT k, l, r FROM (VALUES {_L}) a(k, l) FULL JOIN (VALUES {_R}) b(k, r) USING (k)""")
def join_full_using(t):
    return R.using_join(t.values("k, l", _L), t.values("k, r", _R), ["k"], "full").select("k", "l", "r")


@query(f"""SELECT k, l, r FROM (VALUES {_L}) a(k, l) NATURAL LEFT JOIN (VALUES {_R}) b(k, r)""")
def join_natural(t):
    return R.natural_join(t.values("k, l", _L), t.values("k, r", _R), "left").select("k", "l", "r")


@query("""SELECT n_name, r_name FROM nation CROSS JOIN region""")
def join_cross(t):
    return t("nation").crossJoin(t("region")).select("n_name", "r_name")


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name""")
def join_theta(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_name") > F.col("b.n_name"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + 1""")
def join_self(t):
    a, b = t("customer").alias("a"), t("customer").alias("b")
    on = (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("b.c_custkey") == F.col("a.c_custkey") + 1)
    return a.join(b, on).select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"))


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_three_way(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT n_name, c_custkey, o_orderkey FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000) ON c_nationkey = n_nationkey""")
def join_nested_group(t):
    inner = t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"))
    return t("nation").join(inner, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", "c_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1 AND l_quantity < 5""")
def join_hash(t):
    return t("lineitem").where("l_quantity < 5").join(t("part").where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("""SELECT c_custkey, spent FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) s ON s.o_custkey = c_custkey""")
def join_materialized_subquery(t):
    spent = t("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return t("customer").join(spent, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "spent")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 49)""")
def semi_exists(t):
    lines = t("lineitem").where("l_returnflag = 'R' and l_quantity > 49")
    return t("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_not_exists(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT event_id, low, high FROM events JOIN (VALUES (0.0, 10.0), (10.0, 20.0), (90.0, 95.0)) b(low, high) ON value >= low AND value < high""")
def join_range(t):
    bands = t.values("low, high", "(0.0, 10.0), (10.0, 20.0), (90.0, 95.0)")
    return R.range_join(t("events").select("event_id", "value"), bands, "value", "low", "high", 10.0).select("event_id", "low", "high")


# ---- aggregation
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def group_by(t):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - discount)), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg(discount), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15""")
def group_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("""SELECT year(o_orderdate)::INT AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2""")
def group_expr_alias(t):
    return t("orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0""")
def agg_ungrouped_empty(t):
    return t("orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_orderkey").alias("m"))


@query(f"""SELECT count(*) AS n, count(x) AS present, sum(x)::BIGINT AS s, sum(x)::DOUBLE AS t, round(avg(x), 6) AS a, min(x) AS lo, max(x) AS hi FROM (VALUES {_MIXED}) v(id, x)""")
def agg_count_sum_avg(t):
    x = F.col("x")
    return t.values("id, x", _MIXED).agg(F.count("*").alias("n"), F.count(x).alias("present"), F.sum(x).alias("s"), A.total(x).alias("t"), F.round(F.avg(x), 6).alias("a"), F.min(x).alias("lo"), F.max(x).alias("hi"))


@query("""SELECT c_nationkey, coalesce(round(sum(c_acctbal) FILTER (WHERE c_acctbal < 0), 2), 0.0) AS debt FROM customer GROUP BY c_nationkey""")
def agg_total(t):
    return t("customer").groupBy("c_nationkey").agg(F.round(A.total(F.when(F.col("c_acctbal") < 0, F.col("c_acctbal"))), 2).alias("debt"))


@query("""SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name DESC) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def agg_ordered_concat(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reversed_order = F.array_join(F.reverse(F.array_sort(F.collect_list("n_name"))), ", ")
    return joined.groupBy("r_name").agg(reversed_order.alias("nations"))


@query("""SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus""")
def agg_group_concat_distinct(t):
    return t("orders").groupBy("o_orderstatus").agg(A.group_concat(F.col("o_orderpriority"), ",", distinct=True).alias("priorities"))


@query("""SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY l_returnflag""")
def agg_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("numbers"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large FROM orders GROUP BY o_orderpriority""")
def agg_filter(t):
    return t("orders").groupBy("o_orderpriority").agg(
        A.count_where(F.col("o_orderstatus") == "F").alias("done"), F.round(A.where(F.sum, F.col("o_totalprice"), F.col("o_totalprice") > 100000), 2).alias("large")
    )


@query("""SELECT c_nationkey, max(c_acctbal) AS best, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS who FROM customer GROUP BY c_nationkey""")
def agg_bare_minmax(t):
    return t("customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), A.bare(F.col("c_custkey"), at_most=F.struct("c_acctbal", -F.col("c_custkey"))).alias("who"))


@query("""SELECT DISTINCT l_shipmode FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem)""")
def distinct(t):
    return t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).distinct()


@query("""SELECT DISTINCT o_custkey FROM orders""")
def distinct_keys(t):
    return t("orders").select("o_custkey").distinct()


@query("""SELECT count(*) AS n FROM lineitem""")
def count_star(t):
    return t("lineitem").agg(F.count("*").alias("n"))


@query("""SELECT min(l_shipdate) AS first, max(l_shipdate) AS last, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem""")
def min_max_extremes(t):
    return t("lineitem").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("""SELECT o_orderstatus, round(sum(o_totalprice) / count(DISTINCT o_custkey), 2) AS each, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus""")
def agg_nested_exprs(t):
    return t("orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice") / F.count_distinct("o_custkey"), 2).alias("each"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"))


@query("""SELECT event_type, round(sum(value), 2) AS s, count(*) AS n FROM events GROUP BY event_type""")
def agg_salted(t):
    out = A.salted_groups(t("events").select("event_type", "value", "event_id"), ["event_type"], [F.sum("value").alias("s"), F.count("*").alias("n")], [F.sum("s").alias("s"), F.sum("n").alias("n")])
    return out.select("event_type", F.round("s", 2).alias("s"), "n")


# ---- sorting
@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
def top_n(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query(f"""SELECT id, x, row_number() OVER (ORDER BY x NULLS FIRST, id) AS up, row_number() OVER (ORDER BY x DESC NULLS LAST, id) AS down, row_number() OVER (ORDER BY x NULLS LAST, id) AS nl FROM (VALUES {_MIXED}) v(id, x)""")
def order_nulls(t):
    from pyspark.sql import Window

    x = F.col("x")
    n = lambda o: F.row_number().over(Window.orderBy(o, "id"))
    return t.values("id, x", _MIXED).select("id", "x", n(O.term(x)).alias("up"), n(O.term(x, True)).alias("down"), n(O.term(x, nulls="last")).alias("nl"))


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5""")
def limit_offset(t):
    return O.limit(t("customer").select("c_custkey", "c_name").orderBy("c_custkey"), 10, 5)


@query("""SELECT n_regionkey, n_name FROM nation""")
def limit_negative(t):
    return O.limit(O.by_position(t("nation").select("n_regionkey", "n_name"), 1, -2), -1)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber""")
def sort_full(t):
    return t("lineitem").orderBy("l_shipdate", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""SELECT p_name FROM part ORDER BY lower(p_name), p_name LIMIT 50""")
def sort_collated(t):
    return t("part").orderBy(O.term(F.col("p_name"), collation="nocase"), "p_name").limit(50).select("p_name")


# ---- set operations
@query("""SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""")
def union_all(t):
    return R.compound(t("customer").select(F.col("c_nationkey").alias("k")), ("union all", t("supplier").select("s_nationkey")))


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def union(t):
    return R.compound(t("customer").select(F.col("c_nationkey").alias("k")), ("union", t("supplier").select("s_nationkey")))


@query("""SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders""")
def intersect(t):
    return R.compound(t("customer").select(F.col("c_custkey").alias("k")), ("intersect", t("orders").select("o_custkey")))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def except_(t):
    return R.compound(t("customer").select(F.col("c_custkey").alias("k")), ("except", t("orders").select("o_custkey")))


@query("""(SELECT 1 AS k UNION SELECT 2) INTERSECT SELECT 2""")
def compound_chain(t):
    one = lambda v: t.spark.range(1).select(F.lit(v).alias("k"))
    return R.compound(one(1), ("union", one(2)), ("intersect", one(2)))


@query("""SELECT k FROM (SELECT n_name AS k FROM nation UNION SELECT r_name FROM region) ORDER BY k DESC LIMIT 7""")
def compound_order(t):
    return R.compound(t("nation").select(F.col("n_name").alias("k")), ("union", t("region").select("r_name"))).orderBy(F.desc("k")).limit(7)


@query("""WITH big(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = k WHERE total > 2000000""")
def cte(t):
    big = R.renamed(t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice")), "k", "total")
    return big.where("total > 2000000").join(t("customer"), F.col("c_custkey") == F.col("k")).select("c_name", F.round("total", 2).alias("total"))


@query("""WITH RECURSIVE c(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 15) SELECT n, f FROM c""")
def recursive_union_all(t):
    return t.spark.sql("WITH RECURSIVE c(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 15) SELECT n, f FROM c")


_EDGES = "(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5)"


@query(f"""WITH RECURSIVE e(a, b) AS (VALUES {_EDGES}), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c""")
def recursive_union(t):
    edges = t.values("a, b", _EDGES)
    hop = edges.select(F.col("a").alias("b"), F.col("b").alias("to"))
    return R.recursive(edges, lambda new: new.join(hop, "b").select("a", F.col("to").alias("b")))
