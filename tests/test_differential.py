"""Random queries of the dialect against DuckDB, compared as multisets."""

import random

import pytest

from tidemark.store.database import Database

duckdb = pytest.importorskip("duckdb")
WORDS = ["x", "yy", "zzz", "foo", "bar", "baz"]


class Gen:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def rows(self):
        r = self.r
        a = [(i, None if r.random() < 0.2 else r.randrange(-5, 6), None if r.random() < 0.2 else r.choice(WORDS)) for i in range(1, r.randrange(2, 7))]
        b = [(i, None if r.random() < 0.15 else r.randrange(1, 6), None if r.random() < 0.2 else r.randrange(-5, 6)) for i in range(1, r.randrange(2, 7))]
        return a, b

    def number(self, cols, depth=0):
        r = self.r
        k = r.randrange(8 if depth < 2 else 2)
        if k == 0:
            return str(r.randrange(0, 6))
        if k == 1 or k > 6:
            return r.choice(cols)
        if k == 2:
            return f"ABS({self.number(cols, depth + 1)})"
        if k == 3:
            return f"COALESCE({self.number(cols, depth + 1)}, {r.randrange(5)})"
        if k == 4:
            return f"CASE WHEN {self.test(cols, depth + 1)} THEN {self.number(cols, depth + 1)} ELSE {self.number(cols, depth + 1)} END"
        return f"({self.number(cols, depth + 1)} {r.choice('+-*')} {self.number(cols, depth + 1)})"

    def test(self, cols, depth=0):
        r = self.r
        k = r.randrange(8 if depth < 2 else 4)
        n = lambda: self.number(cols, depth + 1)
        if k == 0:
            return f"{n()} {r.choice(['=', '<>', '<', '<=', '>', '>='])} {n()}"
        if k == 1:
            return f"{n()} IS {r.choice(['', 'NOT '])}NULL"
        if k == 2:
            return f"{n()} {r.choice(['', 'NOT '])}IN ({n()}, {n()})"
        if k == 3:
            return f"{n()} {r.choice(['', 'NOT '])}BETWEEN {n()} AND {n()}"
        if k == 4:
            return f"NOT ({self.test(cols, depth + 1)})"
        return f"({self.test(cols, depth + 1)} {r.choice(['AND', 'OR'])} {self.test(cols, depth + 1)})"

    def query(self):
        r = self.r
        k = r.randrange(5)
        if k == 0:
            return f"SELECT {r.choice(['', 'DISTINCT '])}id, {self.number(['id', 'n'])} AS v, label FROM a WHERE {self.test(['id', 'n'])}"
        if k == 1:
            return f"SELECT label, COUNT(*) AS c, SUM(n) AS s, MIN(n) AS lo, MAX(id) AS hi, COUNT(DISTINCT n) AS d FROM a WHERE {self.test(['id', 'n'])} GROUP BY label HAVING COUNT(*) > {r.randrange(2)}"
        if k == 2:
            kind = r.choice(["JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL OUTER JOIN"])
            extra = f" AND {self.test(['a.n', 'b.m'])}" if kind == "JOIN" or r.random() < 0.3 and kind != "FULL OUTER JOIN" else ""
            return f"SELECT a.id AS x, b.id AS y, b.m FROM a {kind} b ON a.id = b.aid{extra}"
        if k == 3:
            return f"SELECT n AS v FROM a WHERE {self.test(['id', 'n'])} {r.choice(['UNION', 'UNION ALL', 'INTERSECT', 'INTERSECT ALL', 'EXCEPT', 'EXCEPT ALL'])} SELECT m FROM b WHERE {self.test(['id', 'm'])}"
        return f"SELECT id, n FROM a WHERE {r.choice(['', 'NOT '])}EXISTS (SELECT 1 AS o FROM b WHERE b.aid = a.id AND {self.test(['b.m', 'a.n'])}) OR n {r.choice(['', 'NOT '])}IN (SELECT m FROM b WHERE m IS NOT NULL)"


@pytest.mark.parametrize("seed", range(12))
def test_random_queries(spark, tmp_path, seed):
    g = Gen(seed)
    rows = g.rows()
    db, con = Database(spark, f"file://{tmp_path}"), duckdb.connect()
    for name, cols, types, data in (("a", "id, n, label", ("long", "long", "string"), rows[0]), ("b", "id, aid, m", ("long",) * 3, rows[1])):
        names = cols.split(", ")
        db.attach(name, spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in zip(names, types))))
        con.execute(f"CREATE TABLE {name} (" + ", ".join(f"{c} {'BIGINT' if t == 'long' else 'VARCHAR'}" for c, t in zip(names, types)) + ")")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", data)
    for _ in range(12):
        sql = g.query()
        got, want = db.execute(sql).rows(), con.execute(sql).fetchall()
        key = lambda row: tuple((v is None, str(v)) for v in row)
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key), sql
