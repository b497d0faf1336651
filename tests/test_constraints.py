"""Constraints, defaults, generated columns and foreign keys of CREATE TABLE, statement by statement against sqlite3."""

import sqlite3

import pytest

from quillon.engine import Database
from quillon.errors import EngineError

RULES = """
CREATE TABLE t(id INTEGER PRIMARY KEY, a INTEGER NOT NULL CHECK(a > 0), b TEXT DEFAULT 'q', u TEXT UNIQUE, dbl AS (a * 2))
INSERT INTO t(a, u) VALUES (1, 'x'), (2, 'y')
INSERT INTO t(a) VALUES (-1)
INSERT INTO t(a) VALUES (NULL)
INSERT INTO t(a, u) VALUES (3, 'x')
INSERT INTO t VALUES (10, 5, 'b', NULL)
INSERT INTO t(a, dbl) VALUES (1, 2)
INSERT INTO t(a, u) VALUES (7, NULL)
INSERT INTO t(id, a) VALUES (10, 8)
INSERT OR IGNORE INTO t(id, a, u) VALUES (10, 8, 'p'), (20, -3, 'r'), (21, 4, 'y'), (22, 4, 'z'), (23, 4, 'z')
INSERT OR REPLACE INTO t(id, a, u) VALUES (1, 9, 'y')
INSERT INTO t(nope) VALUES (1)
INSERT INTO t(a) SELECT 3
UPDATE t SET a = 0 WHERE id = 10
UPDATE t SET a = a + 1 WHERE id = 10
UPDATE t SET u = 'z' WHERE id = 10
UPDATE t SET dbl = 1
WITH big(x) AS (SELECT 100 UNION SELECT 101) INSERT INTO t(a) SELECT x FROM big
WITH big AS (SELECT max(id) AS m FROM t) DELETE FROM t WHERE id = (SELECT m FROM big)
WITH low AS (SELECT min(id) AS m FROM t) UPDATE t SET b = 'low' WHERE id IN (SELECT m FROM low)
INSERT INTO t(id, a) VALUES (10, 50) ON CONFLICT(id) DO UPDATE SET a = excluded.a - 100
INSERT INTO t(id, a) VALUES (10, 50) ON CONFLICT(id) DO UPDATE SET a = excluded.a
CREATE TABLE two(x INTEGER, y TEXT, z REAL DEFAULT (1.5 + 1), PRIMARY KEY (x, y), CONSTRAINT far CHECK (x < 100))
INSERT INTO two(x, y) VALUES (1, 'a'), (1, 'b')
INSERT INTO two(x, y) VALUES (1, 'a')
INSERT INTO two(x, y) VALUES (100, 'a')
INSERT INTO two(x, y) VALUES (NULL, 'a'), (NULL, 'a')
CREATE UNIQUE INDEX by_z ON two(y, z)
CREATE UNIQUE INDEX by_x ON two(x, y)
INSERT INTO two VALUES (1, 'c', 1), (1, 'c', 2)
DROP INDEX by_x
DROP INDEX nothere
INSERT INTO two DEFAULT VALUES
ALTER TABLE two DROP COLUMN x
""".strip().split("\n")

KEYS = """
CREATE TABLE p(id INTEGER PRIMARY KEY, n TEXT)
CREATE TABLE c(id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE CASCADE)
CREATE TABLE d(k INTEGER DEFAULT 1, FOREIGN KEY (k) REFERENCES p ON DELETE SET DEFAULT)
CREATE TABLE e(k INTEGER REFERENCES p)
CREATE TABLE g(c INTEGER REFERENCES c(id) ON DELETE SET NULL)
INSERT INTO c(p) VALUES (99)
DELETE FROM c
PRAGMA foreign_keys = ON
INSERT INTO p VALUES (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four')
INSERT INTO c VALUES (1, 99)
INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL)
INSERT INTO d VALUES (2), (3), (NULL)
INSERT INTO e VALUES (4)
INSERT INTO g VALUES (2), (3)
UPDATE c SET p = 77 WHERE id = 1
DELETE FROM p WHERE id = 2
DELETE FROM p WHERE id = 4
DELETE FROM p WHERE id = 1
UPDATE p SET id = 40 WHERE id = 4
UPDATE p SET n = 'x' WHERE id = 4
DELETE FROM p WHERE id = 3
""".strip().split("\n")


def rows(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize(("script", "tables"), [(RULES, ("t", "two")), (KEYS, ("p", "c", "d", "e", "g"))])
def test_against_sqlite(spark, script, tables):
    db, con = Database(spark), sqlite3.connect(":memory:", isolation_level=None)
    for sql in script:
        want = got = None
        try:
            con.execute(sql)
        except sqlite3.Error as e:
            want = str(e)
        try:
            db.exec(sql)
        except EngineError as e:
            got = str(e)
        assert (got is None) == (want is None), (sql, got, want)
        if want and "constraint failed" in want:
            assert got.replace(" ", "") == want.replace(" ", ""), sql
        for name in tables:
            if name in db.tables():
                assert rows(db.exec(f"SELECT * FROM {name}").rows()) == rows(con.execute(f"SELECT * FROM {name}").fetchall()), (sql, name)


def test_counts_of_changes(spark):
    db = Database(spark)
    db.exec("CREATE TABLE t(id INTEGER PRIMARY KEY, a INTEGER)")
    db.exec("INSERT INTO t(a) VALUES (5), (6), (7)")
    assert db.exec("SELECT changes(), last_insert_rowid()").rows()[0] == (3, 3)
    db.exec("UPDATE t SET a = 0 WHERE a > 5")
    assert db.exec("SELECT changes(), total_changes()").rows()[0] == (2, 5)


def test_delete_and_update_with_limit(spark):
    db = Database(spark)
    db.exec("CREATE TABLE t(id INTEGER PRIMARY KEY, a INTEGER); INSERT INTO t(a) VALUES (5), (9), (7), (9), (1)")
    db.exec("DELETE FROM t WHERE a > 1 ORDER BY a DESC, id LIMIT 2")
    assert rows(db.exec("SELECT id, a FROM t").rows()) == [(1, 5), (3, 7), (5, 1)]
    db.exec("UPDATE t SET a = -a ORDER BY a LIMIT 1 OFFSET 1")
    assert rows(db.exec("SELECT id, a FROM t").rows()) == [(1, -5), (3, 7), (5, 1)]


def test_pragmas_of_rules(spark):
    db = Database(spark)
    db.exec("CREATE TABLE p(id INTEGER PRIMARY KEY, n TEXT UNIQUE); CREATE TABLE c(p INTEGER REFERENCES p(id) ON DELETE CASCADE, q INTEGER CHECK(q > 0))")
    db.exec("CREATE INDEX i ON c(q); INSERT INTO c VALUES (1, 1)")
    assert [tuple(r) for r in db.exec("PRAGMA index_list(p)").rows()] == [(0, "sqlite_autoindex_p_1", 1, "u", 0)]
    assert [tuple(r) for r in db.exec("PRAGMA index_list(c)").rows()] == [(0, "i", 0, "c", 0)]
    assert [tuple(r) for r in db.exec("PRAGMA index_info(i)").rows()] == [(0, 1, "q")]
    assert [tuple(r) for r in db.exec("PRAGMA foreign_key_list(c)").rows()] == [(0, 0, "p", "p", "id", "NO ACTION", "CASCADE", "NONE")]
    assert [tuple(r) for r in db.exec("PRAGMA foreign_key_check(c)").rows()] == [("c", "p", 0)]
    assert db.exec("PRAGMA integrity_check").scalar() == "ok"
    db.put("c", db.get("c").selectExpr("p", "-1L AS q"))
    assert db.exec("PRAGMA integrity_check").scalar() == "CHECK constraint failed: q>0"


@pytest.mark.parametrize("sql", ["CREATE TABLE x(a TEXT COLLATE NOCASE)", "CREATE TABLE x(a INTEGER UNIQUE ON CONFLICT IGNORE)", "CREATE TRIGGER g AFTER INSERT ON t BEGIN SELECT 1; END"])
def test_clauses_that_are_refused(spark, sql):
    with pytest.raises(EngineError):
        Database(spark).exec(sql)


def test_rollback_forgets_definitions(spark):
    db = Database(spark)
    db.exec("BEGIN; CREATE TABLE x(a INTEGER NOT NULL); ROLLBACK; CREATE TABLE x(a INTEGER)")
    db.exec("INSERT INTO x VALUES (NULL)")
    assert db.row_count("x") == 1
