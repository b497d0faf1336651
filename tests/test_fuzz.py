"""Random expressions of the SQL front against Python's own sqlite3."""

import random
import sqlite3

import pytest

from quillon.engine import Database

ROWS = [(1, 12, 12.0, "12", "abc"), (2, None, None, None, None), (3, -1, -1.5, " 12 ", "AbC"), (4, 0, 0.0, "", "x"), (5, 7, 2.5, "7x", "zz"), (6, 100, 1e6, "abc", "B")]


class Grammar:
    """Expressions of numbers, texts and predicates over t(id, a, r, s, u), by depth."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def one_of(self, plain, made, depth):
        if depth <= 0 or self.rng.random() < 0.35:
            return self.rng.choice(plain)
        return self.rng.choice(made)()

    def number(self, d: int) -> str:
        n, t, b, pick = (lambda: self.number(d - 1)), (lambda: self.text(d - 1)), (lambda: self.truth(d - 1)), self.rng.choice
        return self.one_of(["a", "r", "id", "1", "2", "-3", "0", "2.5", "NULL", "10"], [
            lambda: f"({n()} {pick('+-*/%')} {n()})", lambda: f"abs({n()})", lambda: f"length({t()})", lambda: f"coalesce({n()}, {n()})", lambda: f"CASE WHEN {b()} THEN {n()} ELSE {n()} END",
            lambda: f"round({n()}, {pick([0, 1, 2])})", lambda: f"instr({t()}, {t()})", lambda: f"max({n()}, {n()})", lambda: f"nullif({n()}, {n()})", lambda: f"(- {n()})", lambda: f"CAST({n()} AS INTEGER)", lambda: f"CAST({t()} AS REAL)",
        ], d)

    def text(self, d: int) -> str:
        n, t, pick = (lambda: self.number(d - 1)), (lambda: self.text(d - 1)), self.rng.choice
        return self.one_of(["s", "u", "'abc'", "'B'", "''", "'a%'", "NULL", "'12'"], [
            lambda: f"({t()} || {t()})", lambda: f"upper({t()})", lambda: f"lower({t()})", lambda: f"substr({t()}, {pick([-3, -1, 0, 1, 2, 9])}, {pick([-2, 0, 1, 3])})", lambda: f"replace({t()}, {t()}, {t()})", lambda: f"trim({t()})",
            lambda: "CAST(a AS TEXT)", lambda: "CAST(r AS TEXT)", lambda: f"hex({t()})", lambda: f"quote({t()})", lambda: f"typeof({pick([n, t])()})", lambda: f"ifnull({t()}, {t()})", lambda: f"printf('%d|%s|%.1f', a, {t()}, r)",
        ], d)

    def truth(self, d: int) -> str:
        n, t, b, pick = (lambda: self.number(d - 1)), (lambda: self.text(d - 1)), (lambda: self.truth(d - 1)), self.rng.choice
        return self.one_of(["a > 3", "s = 'abc'", "r IS NULL", "1", "0", "NULL"], [
            lambda: f"({n()} {pick(['<', '<=', '=', '<>', '>', '>=', 'IS', 'IS NOT'])} {n()})", lambda: f"({t()} {pick(['<', '=', '<>', '>', 'IS'])} {t()})", lambda: f"({b()} AND {b()})", lambda: f"({b()} OR {b()})", lambda: f"(NOT {b()})",
            lambda: f"({n()} BETWEEN {n()} AND {n()})", lambda: f"({n()} IN ({n()}, {n()}))", lambda: f"({t()} LIKE '{pick(['%a%', '_b%', 'ABC', 'a'])}')", lambda: f"({t()} GLOB '{pick(['*b*', '?b?', 'abc'])}')", lambda: f"({t()} ISNULL)",
            lambda: f"(a {pick('<=>')} s)", lambda: f"(s {pick('<=>')} 12)",
        ], d)


@pytest.fixture(scope="module")
def both(spark):
    db, con = Database(spark), sqlite3.connect(":memory:")
    db.attach_frames({"t": spark.createDataFrame(ROWS, "id long, a long, r double, s string, u string")})
    con.execute("CREATE TABLE t(id INTEGER, a INTEGER, r REAL, s TEXT, u TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", ROWS)
    return db, con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if abs(v) < 1e12 else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("seed", range(8))
def test_expressions(both, seed):
    g = Grammar(seed)
    expressions = [g.rng.choice([g.number, g.text, g.truth])(3) for _ in range(12)]
    sql = f"SELECT {', '.join(expressions)} FROM t ORDER BY id"
    got, want = both[0].exec(sql).rows(), both[1].execute(sql).fetchall()
    for k, e in enumerate(expressions):
        # CASE and coalesce widen a column to one class, so 1 may be shown as 1.0.
        assert [plain(r[k]) for r in got] == [plain(r[k]) for r in want], e
