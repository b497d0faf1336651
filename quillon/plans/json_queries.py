"""JSON functions, table functions and FOR JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.operators import forjson as X
from quillon.plans.registry import query

_E = "FROM events"


def _events(t):
    return t("events")


@query(f"""SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::VARCHAR AS text, NULL::VARCHAR AS missing {_E}""")
def json_extract(t):
    p = F.col("props")
    return _events(t).select("event_id", J.json_extract(p, "$.k").cast("int").alias("k"), J.extract_text(p, "$.k").alias("text"), J.json_extract(p, "$.none").alias("missing"))


@query(f"""SELECT event_id, '[' || (props->>'$.k') || ',null]' AS pair {_E}""")
def json_extract_many(t):
    return _events(t).select("event_id", J.json_extract(F.col("props"), "$.k", "$.none").alias("pair"))


@query(f"""SELECT event_id, props->>'$.k' AS json, (props->>'$.k')::INT AS value {_E}""")
def json_arrow(t):
    p = F.col("props")
    return _events(t).select("event_id", J.arrow(p, "k").alias("json"), J.arrow_text(p, "$.k").cast("int").alias("value"))


@query(f"""SELECT event_id, 'object' AS whole, 'integer' AS k, NULL::VARCHAR AS none {_E}""")
def json_type(t):
    p = F.col("props")
    return _events(t).select("event_id", J.json_type(p).alias("whole"), J.json_type(p, "$.k").alias("k"), J.json_type(p, "$.none").alias("none"))


_DOCS = """(1, '{"a": [1, 2, {"b": null}], "c": "x"}'), (2, '[]'), (3, '{a: 1, /* five */ b: .5,}'), (4, 'nope'), (5, '[1,2'), (6, NULL), (7, '{"a":1,"a":2}'), (8, ' 12.50 ')"""


@query("""SELECT * FROM (VALUES (1, 1, 1, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 0, 0, 5), (6, NULL, NULL, NULL), (7, 1, 1, 0), (8, 1, 1, 0)) v(id, strict, loose, place)""")
def json_valid(t):
    d = F.col("d")
    return t.values("id, d", _DOCS).select("id", J.json_valid(d).alias("strict"), J.json_valid(d, 2).alias("loose"), J.json_error_position(d).alias("place"))


@query("""SELECT * FROM (VALUES (1, '{"a":[1,2,{"b":null}],"c":"x"}'), (2, '[]'), (3, '{"a":1,"b":0.5}'), (7, '{"a":1,"a":2}'), (8, '12.50')) v(id, m)""")
def json_minify(t):
    return t.values("id, d", _DOCS).where("id in (1, 2, 3, 7, 8)").select("id", J.json(F.col("d")).alias("m"))


@query("""SELECT * FROM (VALUES (1, 0::BIGINT, 3::BIGINT), (2, 0, NULL), (7, 0, 0)) v(id, whole, a)""")
def json_array_length(t):
    d = F.col("d")
    return t.values("id, d", _DOCS).where("id in (1, 2, 7)").select("id", J.json_array_length(d).alias("whole"), J.json_array_length(d, "$.a").alias("a"))


@query("""SELECT '{"a":1,"b":2}' AS ins, '{"a":9}' AS rep, '{"a":9,"b":[1]}' AS st, '[1,2,3]' AS app, '{"a":{"b":{"c":5}}}' AS deep""")
def json_set(t):
    one, lit = t.spark.range(1), F.lit
    a = lit('{"a":1}')
    return one.select(
        J.json_insert(a, ("$.a", lit(9)), ("$.b", lit(2))).alias("ins"), J.json_replace(a, ("$.a", lit(9)), ("$.b", lit(2))).alias("rep"),
        J.json_set(a, ("$.a", lit(9)), ("$.b", lit("[1]"), True)).alias("st"), J.json_insert(lit("[1,2]"), ("$[#]", lit(3))).alias("app"),
        J.json_set(lit("{}"), ("$.a.b.c", lit(5))).alias("deep"),
    )


@query("""SELECT '{"b":2}' AS one, '[1,3]' AS item, '[1,2]' AS last, NULL::VARCHAR AS root, '{"a":{"x":1},"c":3}' AS merged""")
def json_remove_patch(t):
    one, lit = t.spark.range(1), F.lit
    return one.select(
        J.json_remove(lit('{"a":1,"b":2}'), "$.a").alias("one"), J.json_remove(lit("[1,2,3]"), "$[1]").alias("item"), J.json_remove(lit("[1,2,3]"), "$[#-1]").alias("last"),
        J.json_remove(lit("{}"), "$").alias("root"), J.json_patch(lit('{"a":{"x":1,"y":2},"b":1}'), lit('{"a":{"y":null},"b":null,"c":3}')).alias("merged"),
    )


@query("""SELECT n_nationkey, '[' || n_nationkey || ',"' || n_name || '",null]' AS arr, '{"k":' || n_nationkey || ',"name":"' || n_name || '"}' AS obj, '"' || n_name || '"' AS q FROM nation""")
def json_array_object(t):
    k, n = F.col("n_nationkey"), F.col("n_name")
    return t("nation").select("n_nationkey", J.json_array((k, "integer"), (n, "text"), (F.lit(None).cast("string"), "text")).alias("arr"), J.json_object(("k", k, "integer"), ("name", n, "text")).alias("obj"), J.json_quote(n, "text").alias("q"))


@query("""SELECT r_name, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']' AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def json_group_array(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(J.json_group_array(F.col("n_name"), "text", F.col("n_name")).alias("names"))


@query("""SELECT r_name, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def json_group_object(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(J.json_group_object(F.col("n_name"), F.col("n_nationkey"), "integer", F.col("n_name")).alias("keys"))


@query("""SELECT e.event_id AS event_id, 'k' AS key, (e.props->>'$.k')::VARCHAR AS value, 'integer' AS type, '$.k' AS fullkey, '$' AS path FROM events e""")
def json_each(t):
    J.register(t.spark)
    t("events").createOrReplaceTempView("json_each_events")
    return t.spark.sql("SELECT e.event_id, j.key, j.value, j.type, j.fullkey, j.path FROM json_each_events e, LATERAL json_each(e.props, '$') j")


@query("""SELECT * FROM (VALUES (0, NULL, '{"a":[1,{"b":2}],"c":null}', 'object', NULL, NULL, '$'), (2, 'a', '[1,{"b":2}]', 'array', NULL, 0, '$.a'), (3, '0', '1', 'integer', '1', 2, '$.a[0]'),
  (4, '1', '{"b":2}', 'object', NULL, 2, '$.a[1]'), (6, 'b', '2', 'integer', '2', 4, '$.a[1].b'), (8, 'c', NULL, 'null', NULL, 0, '$.c')) v(id, key, value, type, atom, parent, fullkey)""")
def json_tree(t):
    J.register(t.spark)
    return t.spark.sql("""SELECT id, key, value, type, atom, parent, fullkey FROM json_tree('{"a":[1,{"b":2}],"c":null}', '$')""")


@query("""SELECT '[' || string_agg('{"id":' || n_nationkey || ',"name":{"nation":"' || n_name || '","region":"' || r_name || '"}}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def for_json_path(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shown = joined.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name.nation"), F.col("r_name").alias("name.region"))
    return X.for_json_path(shown, ["id"])


@query("""SELECT '{"nations":[' || string_agg('{"id":' || n_nationkey || ',"none":null}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation""")
def for_json_root_nulls(t):
    shown = t("nation").select(F.col("n_nationkey").alias("id"), F.lit(None).cast("string").alias("none"))
    return X.for_json_path(shown, ["id"], root="nations", nulls=True)


@query("""SELECT '[' || string_agg(o, ',' ORDER BY r_name) || ']' AS json FROM (SELECT r_name, '{"r_name":"' || r_name || '","nation":[' || string_agg('{"n_name":"' || n_name || '"}', ',' ORDER BY n_name) || ']}' AS o
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)""")
def for_json_auto(t):
    joined = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return X.for_json_auto(joined, ["r_name"], ["n_name"], "nation", ["r_name", "n_name"])
