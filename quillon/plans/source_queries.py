"""Sources, sinks and the catalog as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources import tables as T


@query("""SELECT * FROM (VALUES (0, 'n_nationkey', 'INTEGER'), (1, 'n_name', 'TEXT'), (2, 'n_regionkey', 'INTEGER')) v(cid, name, type)""")
def pragma_table_info(t):
    return T.table_info(t("nation")).select("cid", "name", "type")


@query("""SELECT 'table' AS type, name, sql FROM (VALUES ('nation', 'CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)'), ('region', 'CREATE TABLE region (r_regionkey INTEGER, r_name TEXT)')) v(name, sql)""")
def schema_table(t):
    return T.schema_table(t.spark, {n: t(n) for n in ("region", "nation")}).select("type", "name", "sql")


@query("""SELECT 'INSERT INTO "nation" VALUES(' || n_nationkey || ',''' || replace(n_name, '''', '''''') || ''',' || n_regionkey || ');' AS line FROM nation""")
def dump_script(t):
    return T.insert_script(t("nation"), "nation")


@query("""SELECT n_nationkey || '|' || n_name || '|' || n_regionkey AS line FROM nation""")
def list_mode(t):
    return T.list_lines(t("nation"))


@query("""SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, 2.5)) v(column1, column2, column3)""")
def values_rows(t):
    return T.values(t.spark, [(1, "a", 1.5), (2, None, 2.5)], ["int", "string", "double"])


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2""")
def events_hourly(t):
    window = F.window(F.col("ts"), "1 hour")
    return t("events").groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s")).select(F.col("w.start").alias("start"), "event_type", "n", "s")
