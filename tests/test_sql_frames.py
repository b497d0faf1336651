"""GROUPS frames and EXCLUDE of the SQL front against sqlite3."""

import sqlite3

import pytest

from quillon.engine import Database

ROWS = [(i, "ab"[i % 2], (i * 7) % 5, None if i % 6 == 0 else i * 3) for i in range(24)]
FRAMES = ["GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING", "GROUPS 2 PRECEDING", "GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", "GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING"]


@pytest.fixture(scope="module")
def both(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t(id INTEGER, p TEXT, o INTEGER, v INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    db = Database(spark)
    db.put("t", spark.createDataFrame(ROWS, "id long, p string, o long, v long"))
    return db, con


def check(both, sql):
    db, con = both
    assert sorted(map(tuple, db.exec(sql).rows()), key=repr) == sorted(con.execute(sql).fetchall(), key=repr), sql


@pytest.mark.parametrize("direction", ["", " DESC"])
def test_frames(both, direction):
    items = ", ".join(f"sum(v) OVER (PARTITION BY p ORDER BY o{direction} {f}) AS s{i}, count(*) OVER (PARTITION BY p ORDER BY o{direction} {f}) AS n{i}" for i, f in enumerate(FRAMES))
    check(both, f"SELECT id, {items} FROM t AS x WHERE x.id <> 3")


@pytest.mark.parametrize("exclude", ["NO OTHERS", "CURRENT ROW", "GROUP", "TIES"])
def test_exclude(both, exclude):
    items = ", ".join(
        f"sum(v) OVER w{i} AS s{i}, count(v) OVER w{i} AS n{i}, count(*) OVER w{i} AS c{i}, avg(v) OVER w{i} AS a{i}, total(v) OVER w{i} AS t{i}" for i in range(len(FRAMES))
    )
    windows = ", ".join(f"w{i} AS (PARTITION BY p ORDER BY o {f} EXCLUDE {exclude})" for i, f in enumerate(FRAMES))
    check(both, f"SELECT id, {items} FROM t WINDOW {windows}")


def test_rows_and_stars(both):
    check(both, "SELECT *, sum(v) OVER (ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS s FROM t")
    check(both, "SELECT t.*, count(*) OVER (ORDER BY o GROUPS 1 PRECEDING) AS s FROM t")
