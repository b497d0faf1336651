"""Scalar functions: strings, mathematics, dates, printf."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from quillon.functions import core as C
from quillon.functions import datetime as D
from quillon.functions import semantics as S
from quillon.functions.printf import printf
from quillon.plans.registry import query


@query("""SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, length(p_name) AS n, strlen(p_name)::INT AS bytes FROM part""")
def str_case_length(t):
    name = F.col("p_name")
    return t("part").select("p_partkey", C.lower(name).alias("low"), C.upper(name).alias("up"), C.length(name).cast("long").alias("n"), C.octet_length(name).alias("bytes"))


@query("""SELECT n_nationkey, substr(n_name, 2, 3) AS a, right(n_name, 3) AS b, left(n_name, 2) AS c, substr(n_name, 3) AS d, '' AS e FROM nation""")
def str_substr(t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", C.substr(n, 2, 3).alias("a"), C.substr(n, -3).alias("b"), C.substr(n, 0, 3).alias("c"), C.substr(n, 3).alias("d"), C.substr(n, 1, -2).alias("e"))


@query("""SELECT 'he' AS zero, 'el' AS back, 'lo' AS tail, 'hello' AS far, 'he' AS before, '' AS none""")
def str_substr_edges(t):
    h = F.lit("hello")
    return t.spark.range(1).select(C.substr(h, 0, 3).alias("zero"), C.substr(h, -4, 2).alias("back"), C.substr(h, -2).alias("tail"), C.substr(h, -9).alias("far"), C.substr(h, 3, -2).alias("before"), C.substr(h, 9, 2).alias("none"))


@query("""SELECT n_nationkey, trim('  ' || n_name || '  ') AS t, ltrim('xxy' || n_name, 'xy') AS l, rtrim(n_name || 'zz', 'z') AS r FROM nation""")
def str_trim(t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", C.trim(F.concat(F.lit("  "), n, F.lit("  "))).alias("t"), C.ltrim(F.concat(F.lit("xxy"), n), "xy").alias("l"), C.rtrim(F.concat(n, F.lit("zz")), "z").alias("r"))


@query("""SELECT n_nationkey, replace(n_name, 'A', '--') AS r, instr(n_name, 'AN')::INT AS i, n_name AS same FROM nation""")
def str_replace_instr(t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", C.replace(n, F.lit("A"), F.lit("--")).alias("r"), C.instr(n, F.lit("AN")).alias("i"), C.replace(n, F.lit(""), F.lit("x")).alias("same"))


@query("""SELECT n_nationkey, hex(n_name) AS h, hex(n_regionkey::VARCHAR) AS i, '' AS nothing FROM nation""")
def str_hex(t):
    return t("nation").select("n_nationkey", C.hex_(F.col("n_name")).alias("h"), C.hex_(F.col("n_regionkey")).alias("i"), C.hex_(F.lit(None).cast("string")).alias("nothing"))


@query("""SELECT '41' AS ok, NULL::VARCHAR AS odd, NULL::VARCHAR AS bad, '4142' AS spaced""")
def str_unhex(t):
    return t.spark.range(1).select(F.hex(C.unhex(F.lit("41"))).alias("ok"), F.hex(C.unhex(F.lit("414"))).alias("odd"), F.hex(C.unhex(F.lit("4g"))).alias("bad"), F.hex(C.unhex(F.lit("41-42"), "-")).alias("spaced"))


_ABC = "(1, 'a', 'b', NULL), (2, NULL, 'x', 'y'), (3, NULL, NULL, NULL), (4, 'p', 'q', 'r')"


@query(f"""SELECT id, concat(a, b, c) AS joined, concat_ws('-', a, b, c) AS dashed, coalesce(a, b, c) AS first, ifnull(a, '?') AS marked FROM (VALUES {_ABC}) v(id, a, b, c)""")
def str_concat_ws(t):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return t.values("id, a, b, c", _ABC).select("id", C.concat(a, b, c).alias("joined"), C.concat_ws(F.lit("-"), a, b, c).alias("dashed"), C.coalesce(a, b, c).alias("first"), C.ifnull(a, F.lit("?")).alias("marked"))


@query("""SELECT * FROM (VALUES (1, 'R163', '?000'), (2, 'T522', '?000')) v(id, s, n)""")
def str_soundex(t):
    return t.values("id, s", "(1, 'Robert'), (2, '12Tymczak')").select("id", C.soundex(F.col("s")).alias("s"), C.soundex(F.lit(None).cast("string")).alias("n"))


@query("""SELECT 'AB€' AS chars, 65 AS code, NULL::INT AS none, '0000' AS zeros""")
def str_char_unicode(t):
    return t.spark.range(1).select(C.char(F.lit(65), F.lit(66), F.lit(0x20AC)).alias("chars"), C.unicode(F.lit("ABC")).alias("code"), C.unicode(F.lit("")).alias("none"), F.hex(C.zeroblob(F.lit(2))).alias("zeros"))


@query("""SELECT '''it''''s''' AS t, '1.5' AS r, 'NULL' AS n, 'X''3132''' AS b, '42' AS i, 'text' AS k1, 'integer' AS k2, 'null' AS k3""")
def str_quote_typeof(t):
    none = F.lit(None).cast("long")
    return t.spark.range(1).select(
        C.quote_text(F.lit("it's")).alias("t"), C.quote_real(F.lit(1.5)).alias("r"), C.quote_integer(none).alias("n"), C.quote_blob(F.unhex(F.lit("3132"))).alias("b"), C.quote_integer(F.lit(42)).alias("i"),
        C.typeof(F.lit("x"), StringType()).alias("k1"), C.typeof(F.lit(1), LongType()).alias("k2"), C.typeof(none, LongType()).alias("k3"),
    )


@query(f"""SELECT id, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END AS hi, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS lo, nullif(a, 'a') AS no_a, CASE WHEN b > 'b' THEN 'y' ELSE 'n' END AS pick FROM (VALUES {_ABC}) v(id, a, b, c)""")
def scalar_min_max_nullif_iif(t):
    a, b = F.col("a"), F.col("b")
    return t.values("id, a, b, c", _ABC).select("id", C.max_(a, b).alias("hi"), C.min_(a, b).alias("lo"), C.nullif(a, F.lit("a")).alias("no_a"), C.iif(b > "b", F.lit("y"), F.lit("n")).alias("pick"))


@query("""SELECT s_suppkey, abs(s_acctbal) AS a, sign(s_acctbal)::BIGINT AS s, round(s_acctbal / 7.0, 3) AS r FROM supplier""")
def math_abs_sign_round(t):
    x = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", C.abs_(x).alias("a"), C.sign(x).alias("s"), C.round_(x / 7.0, 3).alias("r"))


@query("""SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS sq, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 6) END AS l, CASE WHEN s_acctbal > 0 THEN round(log10(s_acctbal), 6) END AS l10, CASE WHEN s_acctbal > 0 THEN round(log2(s_acctbal), 6) END AS l2, round(pow(s_acctbal, 2), 4) AS p FROM supplier""")
def math_roots_logs(t):
    x = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", F.round(C.sqrt(F.abs(x)), 6).alias("sq"), F.round(C.ln(x), 6).alias("l"), F.round(C.log10(x), 6).alias("l10"), F.round(C.log2(x), 6).alias("l2"), F.round(C.power(x, F.lit(2)), 4).alias("p"))


@query("""SELECT id, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(atan(x), 9) AS t, CASE WHEN abs(x) <= 1 THEN round(asin(x), 9) END AS a, round(atan2(x, 2.0), 9) AS t2, round(degrees(x), 9) AS d FROM (VALUES (1, 0.5::DOUBLE), (2, -1.0), (3, 2.0), (4, 0.0)) v(id, x)""")
def math_trigonometry(t):
    x = F.col("x")
    return t.values("id, x", "(1, 0.5D), (2, -1.0D), (3, 2.0D), (4, 0.0D)").select(
        "id", F.round(C.sin(x), 9).alias("s"), F.round(C.cos(x), 9).alias("c"), F.round(C.atan(x), 9).alias("t"), F.round(C.asin(x), 9).alias("a"), F.round(C.atan2(x, F.lit(2.0)), 9).alias("t2"), F.round(C.degrees(x), 9).alias("d")
    )


@query("""SELECT s_suppkey, ceil(s_acctbal)::DOUBLE AS c, floor(s_acctbal)::DOUBLE AS f, trunc(s_acctbal)::DOUBLE AS tr, s_suppkey AS same, round(s_acctbal - trunc(s_acctbal / 7.0) * 7.0, 6) AS m FROM supplier""")
def math_ceil_floor_trunc_mod(t):
    x = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", C.ceil(x, DoubleType()).alias("c"), C.floor(x, DoubleType()).alias("f"), C.trunc(x, DoubleType()).alias("tr"), C.ceil(F.col("s_suppkey"), LongType()).alias("same"), F.round(C.mod(x, F.lit(7.0)), 6).alias("m"))


@query("""SELECT NULL::DOUBLE AS root, NULL::DOUBLE AS arc, NULL::DOUBLE AS lg, 2.0::DOUBLE AS ten, 3.0::DOUBLE AS based, NULL::DOUBLE AS m, 3.0::DOUBLE AS half, -3.0::DOUBLE AS neg""")
def math_domains(t):
    return t.spark.range(1).select(
        C.sqrt(F.lit(-1.0)).alias("root"), C.acos(F.lit(2.0)).alias("arc"), C.log10(F.lit(0.0)).alias("lg"), C.log(F.lit(100.0)).alias("ten"), F.round(C.log_base(F.lit(2.0), F.lit(8.0)), 9).alias("based"),
        C.mod(F.lit(1.0), F.lit(0.0)).alias("m"), C.round_(F.lit(2.5)).alias("half"), C.round_(F.lit(-2.5)).alias("neg"),
    )


_O = "FROM orders"


def _orders(t):
    return t("orders")


@query(f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt {_O}""")
def date_time_datetime(t):
    d = F.col("o_orderdate")
    return _orders(t).select("o_orderkey", D.date(d, kind="timestamp").alias("d"), D.time(d, kind="timestamp").alias("t"), D.datetime(d, kind="timestamp").alias("dt"))


@query(f"""SELECT o_orderkey, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS jd, epoch(o_orderdate)::BIGINT AS ue {_O}""")
def date_julianday_unixepoch(t):
    d = F.col("o_orderdate")
    return _orders(t).select("o_orderkey", F.round(D.julianday(d, kind="timestamp"), 6).alias("jd"), D.unixepoch(d, kind="timestamp").alias("ue"))


@query(f"""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS b,
  strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(day(o_orderdate)::INT - 1), '%Y-%m-%d') AS c, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS e {_O}""")
def date_modifiers(t):
    d = F.col("o_orderdate")
    k = {"kind": "timestamp"}
    return _orders(t).select(
        "o_orderkey", D.date(d, "+10 days", **k).alias("a"), D.datetime(d, "-36 hours", **k).alias("b"), D.date(d, "+1 month", **k).alias("c"), D.date(d, "start of year", **k).alias("y"), D.date(d, "start of month", "+1 month", "-1 day", **k).alias("e")
    )


@query(f"""SELECT o_orderkey, strftime(o_orderdate + to_days(((8 - dayofweek(o_orderdate)) % 7)::INT), '%Y-%m-%d') AS monday {_O}""")
def date_weekday(t):
    return _orders(t).select("o_orderkey", D.date(F.col("o_orderdate"), "weekday 1", kind="timestamp").alias("monday"))


@query(f"""SELECT o_orderkey, strftime(o_orderdate, '%d|%m|%Y|%H|%M|%S|%j|%w|%u|%I|%p|%W|%%') AS s {_O}""")
def date_strftime(t):
    return _orders(t).select("o_orderkey", D.strftime("%d|%m|%Y|%H|%M|%S|%j|%w|%u|%I|%p|%W|%%", F.col("o_orderdate"), kind="timestamp").alias("s"))


_TIMES = "(1, '2024-01-31'), (2, '2024-02-29 12:34:56.789'), (3, '2024-02-29T12:34Z'), (4, '23:59'), (5, '2024-03-10 01:00:00+02:00'), (6, 'nonsense'), (7, NULL), (8, '2024-13-01')"


@query("""SELECT * FROM (VALUES (1, '2024-01-31 00:00:00', '2024-03-02'), (2, '2024-02-29 12:34:56', '2024-03-29'), (3, '2024-02-29 12:34:00', '2024-03-29'), (4, '2000-01-01 23:59:00', '2000-02-01'), (5, '2024-03-09 23:00:00', '2024-04-09'), (6, NULL, NULL), (7, NULL, NULL), (8, NULL, NULL)) v(id, dt, later)""")
def date_parse_text(t):
    s = F.col("s")
    return t.values("id, s", _TIMES).select("id", D.datetime(s).alias("dt"), D.date(s, "+1 month").alias("later"))


@query("""SELECT '2024-02-29 12:34:56' AS unix, '2000-01-01' AS julian, '12:34:56.789' AS sub, NULL::VARCHAR AS bad, 1709210096.789::DOUBLE AS seconds""")
def date_numbers(t):
    return t.spark.range(1).select(
        D.datetime(F.lit(1709210096), "unixepoch", kind="number").alias("unix"), D.date(F.lit(2451544.5), kind="number").alias("julian"), D.time(F.lit("2024-02-29 12:34:56.789"), "subsec").alias("sub"),
        D.date(F.lit("2024-02-29"), "3 fortnights").alias("bad"), D.unixepoch(F.lit("2024-02-29 12:34:56.789"), "subsec").alias("seconds"),
    )


@query("""SELECT '+0001-01-04 03:04:05.000' AS up, '-0000-10-28 00:00:00.000' AS down""")
def date_timediff(t):
    return t.spark.range(1).select(D.timediff(F.lit("2024-03-05 03:04:05"), F.lit("2023-02-01")).alias("up"), D.timediff(F.lit("2023-03-01"), F.lit("2024-01-29")).alias("down"))


@query("""SELECT p_partkey, printf('%05d', p_size) AS d, printf('%-10s|', p_brand) AS s FROM part""")
def printf_common(t):
    return t("part").select("p_partkey", printf("%05d", F.col("p_size")).alias("d"), printf("%-10s|", F.col("p_brand")).alias("s"))


@query("""SELECT '1,234,567' AS commas, '1.50' AS fixed, '1.500000e+00' AS sci, 'ff' AS hx, '''it''''s''' AS q, '  7' AS wide, '%' AS pct, '+5' AS plus, 'xxx' AS chars""")
def printf_full(t):
    one = F.lit
    return t.spark.range(1).select(
        printf("%,d", one(1234567)).alias("commas"), printf("%.2f", one(1.5)).alias("fixed"), printf("%e", one(1.5)).alias("sci"), printf("%x", one(255)).alias("hx"), printf("%Q", one("it's")).alias("q"),
        printf("%*d", one(3), one(7)).alias("wide"), printf("%%").alias("pct"), printf("%+d", one(5)).alias("plus"), printf("%.3c", one("x")).alias("chars"),
    )


@query("""SELECT '1.5' AS a, '100000000.0' AS b, '1.0e+20' AS c, '0.1' AS d, '-3.0' AS e, NULL::VARCHAR AS f""")
def real_text(t):
    shown = lambda v: S.real_text(F.lit(v).cast("double"))
    return t.spark.range(1).select(*(shown(v).alias(n) for n, v in zip("abcdef", (1.5, 1e8, 1e20, 0.1, -3.0, None), strict=True)))
