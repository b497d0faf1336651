"""Values out of JSON compare and are typed by their own class, against sqlite3."""

import sqlite3

import pytest

from quillon.engine import Database

DOC = '{"a":1,"b":"1","c":2.5,"d":true,"e":null,"f":[10,"x",9],"g":"abc"}'
EXPRESSIONS = [
    *(f"json_extract('{DOC}', '$.{k}') {op} {v}" for k in "abcdeg" for op in ("=", "<", ">=", "<>", "IS") for v in ("1", "'1'", "9", "2.5", "'b'", "NULL")),
    *(f"typeof(json_extract('{DOC}', '$.{k}'))" for k in "abcdefg"),
    *(f"typeof('{DOC}' ->> '{k}')" for k in "abcdefg"),
    *(f"'{DOC}' ->> '{k}' BETWEEN 1 AND 3" for k in "abcdeg"),
    *(f"'{DOC}' ->> '{k}' IN (1, 'abc')" for k in "abcdeg"),
    f"json_extract('{DOC}', '$.a') = json_extract('{DOC}', '$.b')",
    f"json_extract('{DOC}', '$.a') < json_extract('{DOC}', '$.c')",
    f"1 < json_extract('{DOC}', '$.g')",
]


def test_expressions(spark):
    db, con = Database(spark), sqlite3.connect(":memory:")
    for lo in range(0, len(EXPRESSIONS), 60):
        some = EXPRESSIONS[lo : lo + 60]
        sql = "SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(some))
        got, want = tuple(db.exec(sql).first()), con.execute(sql).fetchone()
        assert [(e, g) for e, g in zip(some, got, strict=True)] == [(e, w) for e, w in zip(some, want, strict=True)]


@pytest.mark.parametrize("where", ["value > 9", "value = 10", "value > 'a'", "key = 1", "key < 1", "typeof(value) = 'integer'", "typeof(key) = 'integer'", "atom <> 9"])
def test_nodes(spark, where):
    db, con = Database(spark), sqlite3.connect(":memory:")
    for source in ("json_each('[10,\"x\",9]')", f"json_tree('{DOC}')"):
        sql = f"SELECT fullkey FROM {source} WHERE {where}"
        assert sorted(r[0] for r in db.exec(sql).rows()) == sorted(r[0] for r in con.execute(sql)), sql


def test_arithmetic_of_literals(spark):
    db, con = Database(spark), sqlite3.connect(":memory:")
    some = ["9223372036854775807 + 1", "9223372036854775807 * 2", "0 - 9223372036854775807 - 1", "'12abc' + 1", "' -3x' * 2", "'1.5x' + 1", "'1e2' + 1", "'abc' + 1", "'12' || 1", "'7' / 2", "'7.' + 0", "'1e' + 1"]
    sql = "SELECT " + ", ".join(f"{e} AS c{i}, typeof({e}) AS t{i}" for i, e in enumerate(some))
    assert tuple(db.exec(sql).first()) == con.execute(sql).fetchone()
