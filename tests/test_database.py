import datetime as dt

import pytest

from tidemark.memory import MemoryStore
from tidemark.plans.lexer import SqlError
from tidemark.store.database import ConstraintError, Database, PermissionDenied


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def q(db, sql, params=None):
    return db.execute(sql, params).rows()


def test_defaults_serial_and_constraints(db):
    db.execute("CREATE TABLE t (id SERIAL PRIMARY KEY, status TEXT DEFAULT 'new', n INT DEFAULT 7, x FLOAT, CHECK (n > 0), UNIQUE (status, n))")
    assert q(db, "INSERT INTO t (x) VALUES (1) RETURNING id, status, n, x") == [(1, "new", 7, 1.0)]
    db.execute("INSERT INTO t (n) VALUES (NULL), (NULL)")  # a check of null passes, a null key never conflicts
    for bad in ("INSERT INTO t (n) VALUES (0)", "INSERT INTO t (id, n) VALUES (1, 50)", "INSERT INTO t (n) VALUES (7)", "INSERT INTO t (id) VALUES (NULL)", "INSERT INTO t (n) VALUES (9), (9)", "UPDATE t SET n = 7, status = 'new'"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    for bad in ("INSERT INTO t (n) VALUES ('x')", "INSERT INTO t (zz) VALUES (1)", "INSERT INTO t (n) VALUES (1, 2)", "INSERT INTO t (n) VALUES (n + 1)", "INSERT INTO zz VALUES (1)"):
        with pytest.raises(SqlError):
            db.execute(bad)
    assert q(db, "SELECT COUNT(*), MAX(id) FROM t") == [(3, 3)]


def test_types_round_trip(db, spark):
    db.execute("CREATE TABLE t (d DATE, ts TIMESTAMP, j JSON, m DECIMAL(10, 2), v VECTOR(2), b BOOL)")
    db.execute("INSERT INTO t VALUES ('2024-01-15', DATE '2024-01-15', '{\"a\": 1}', 0.1, '[1, 2]', TRUE)")
    assert q(db, "SELECT d, ts, j ->> 'a', m + m, v <-> '[1, 0]', b FROM t") == [(dt.date(2024, 1, 15), dt.datetime(2024, 1, 15), "1", __import__("decimal").Decimal("0.20"), 2.0, True)]
    with pytest.raises(Exception):
        db.execute("INSERT INTO t (v) VALUES ('[1, 2, 3]')")
    with pytest.raises(Exception):
        db.execute("INSERT INTO t (j) VALUES ('{')")


def test_upserts(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT, n INT)")
    db.execute("INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2)")
    up = "ON CONFLICT (id) DO UPDATE SET v = excluded.v, n = n + excluded.n WHERE t.n < 100"
    assert sorted(q(db, f"INSERT INTO t VALUES (1, 'x', 10), (3, 'c', 3) {up} RETURNING id, v, n")) == [(1, "x", 11), (3, "c", 3)]
    db.execute(f"INSERT INTO t VALUES (1, 'y', 1), (1, 'z', 1) {up}")  # applied in order
    assert q(db, "SELECT v, n FROM t WHERE id = 1") == [("z", 13)]
    with pytest.raises(SqlError):
        db.execute(f"INSERT INTO t VALUES (9, 'y', 1), (9, 'z', 1) {up}")
    assert db.execute("INSERT INTO t VALUES (1, 'q', 1), (5, 'e', 5), (5, 'f', 6) ON CONFLICT DO NOTHING").count == 1
    assert q(db, "SELECT v FROM t WHERE id = 5") == [("e",)]


def test_contradictions(db):
    db.execute("CREATE TABLE f (s TEXT, a TEXT, v TEXT)")
    do = "ON CONFLICT (s, a) DO ASSERT"
    assert db.execute(f"INSERT INTO f VALUES ('ada', 'c', 'blue'), ('ada', 'c', 'blue'), ('ada', 'h', NULL) {do}").count == 2
    assert db.execute(f"INSERT INTO f VALUES ('ada', 'c', 'blue'), ('ada', 'h', NULL) {do}").count == 0
    with pytest.raises(ConstraintError, match="contradiction in v of .s = ada, a = c.: held 'blue', asserted 'red'"):
        db.execute(f"INSERT INTO f VALUES ('ada', 'c', 'red') {do}")
    with pytest.raises(ConstraintError):
        db.execute(f"INSERT INTO f VALUES ('bob', 'c', 'x'), ('bob', 'c', 'y') {do}")
    with pytest.raises(SqlError):
        db.execute("INSERT INTO f VALUES ('q', 'r', 's') ON CONFLICT DO ASSERT")
    assert q(db, "SELECT COUNT(*) FROM f") == [(2,)]


def test_foreign_keys(db):
    db.script(
        "CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT, pid INT REFERENCES p (id) ON DELETE CASCADE ON UPDATE CASCADE); CREATE TABLE n (id INT, pid INT REFERENCES p ON DELETE SET NULL); "
        "CREATE TABLE r (pid INT REFERENCES p (id)); INSERT INTO p VALUES (1), (2), (3), (4); INSERT INTO c VALUES (10, 1), (11, 2), (12, NULL); INSERT INTO n VALUES (20, 1); INSERT INTO r VALUES (3)"
    )
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO c VALUES (13, 99)")
    with pytest.raises(ConstraintError):
        db.execute("DELETE FROM p WHERE id = 3")
    with pytest.raises(ConstraintError):
        db.execute("DROP TABLE p")
    db.execute("DELETE FROM p WHERE id = 1")
    db.execute("UPDATE p SET id = 22 WHERE id = 2")
    assert q(db, "SELECT id, pid FROM c ORDER BY id") == [(11, 22), (12, None)] and q(db, "SELECT pid FROM n") == [(None,)]


def test_transactions(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (1)")
    assert q(db, "SELECT COUNT(*) FROM t") == [(1,)]
    for bad in ("BEGIN", "VACUUM"):
        with pytest.raises(SqlError):
            db.execute(bad)
    db.execute("ROLLBACK")
    assert q(db, "SELECT COUNT(*) FROM t") == [(0,)]
    db.script("BEGIN; INSERT INTO t VALUES (2); DELETE FROM t; INSERT INTO t VALUES (2), (3); COMMIT")
    assert q(db, "SELECT id FROM t ORDER BY id") == [(2,), (3,)]
    with pytest.raises(SqlError):
        db.execute("COMMIT")


def test_a_database_opens_again(db, spark):
    db.script("CREATE TABLE t (id SERIAL PRIMARY KEY, v TEXT); INSERT INTO t (v) VALUES ('a'); CREATE VIEW w AS SELECT v FROM t")
    other = Database(spark, db.root)
    other.execute("INSERT INTO t (v) VALUES ('b')")
    assert q(other, "SELECT * FROM w ORDER BY v") == [("a",), ("b",)] and q(other, "SELECT MAX(id) FROM t") == [(2,)]


def test_both_times(db):
    db.script("CREATE TABLE p (sku TEXT, price INT, valid_from TIMESTAMP, valid_to TIMESTAMP); INSERT INTO p VALUES ('A', 100, '2020-01-01 00:00:00', '2020-06-01 00:00:00'), ('A', 150, '2020-06-01 00:00:00', NULL)")
    point = db.txid_current()
    db.execute("UPDATE p SET price = 151 WHERE price = 150")
    for at, want in (("2020-03-01 00:00:00", [(100,)]), ("2020-06-01 00:00:00", [(151,)]), ("2020-05-31 23:59:59.999999", [(100,)]), ("2019-01-01 00:00:00", [])):
        db.execute(f"SET valid_time = TIMESTAMP '{at}'")
        assert q(db, "SELECT x.price FROM p x WHERE x.sku = 'A'") == want
    db.execute("SET valid_time = TIMESTAMP '2021-01-01 00:00:00'")
    db.execute(f"SET transaction_time = {point}")
    assert q(db, "SELECT price FROM p") == [(150,)]
    db.execute("INSERT INTO p VALUES ('B', 1, '2020-01-01 00:00:00', NULL)")  # writes act on the latest state
    assert q(db, "SELECT price FROM p") == [(150,)]
    db.execute("CREATE TABLE copy AS SELECT sku, price FROM p")  # and what a write reads is the latest state too
    db.execute("RESET transaction_time")
    assert q(db, "SELECT COUNT(*) FROM copy") == [(3,)]
    assert q(db, "SELECT price FROM p ORDER BY price") == [(1,), (151,)]
    db.execute("SET valid_time = off")
    assert q(db, "SELECT COUNT(*) FROM p") == [(3,)]


def test_valid_time_predicate_over_a_small_domain(db):
    """Every interval and instant of a tiny line, against the definition."""
    days = [None, *(dt.datetime(2020, 1, d) for d in range(1, 5))]
    db.execute("CREATE TABLE p (id INT, valid_from TIMESTAMP, valid_to TIMESTAMP)")
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in days for b in days)]
    db.execute("INSERT INTO p VALUES " + ", ".join(f"({i}, {repr(str(a)) if a else 'NULL'}, {repr(str(b)) if b else 'NULL'})" for i, a, b in rows))
    for t in days[1:]:
        db.execute(f"SET valid_time = TIMESTAMP '{t}'")
        assert {r[0] for r in q(db, "SELECT id FROM p")} == {i for i, a, b in rows if a and a <= t and (b is None or t < b)}


def test_roles_and_fences(db):
    db.script(
        "CREATE TABLE m (id INT, tenant TEXT); INSERT INTO m VALUES (1, 'ann'), (2, 'bob'), (3, 'bob'); CREATE ROLE ann LOGIN; CREATE USER bob LOGIN PASSWORD 'x'; CREATE ROLE readers; GRANT readers TO bob; "
        "CREATE VIEW v AS SELECT id FROM m; CREATE TABLE other (id INT)"
    )
    db.execute("SET ROLE bob")
    with pytest.raises(PermissionDenied):
        db.execute("SELECT * FROM m")
    db.execute("RESET role")
    db.script("GRANT SELECT, DELETE, INSERT, UPDATE ON m TO readers; GRANT SELECT ON m TO ann; ALTER TABLE m ENABLE ROW LEVEL SECURITY")
    db.execute("SET ROLE bob")
    assert q(db, "SELECT * FROM m") == []  # no policy: nothing
    db.execute("RESET role")
    db.execute("CREATE POLICY own ON m USING (tenant = current_user())")
    for role, want in (("ann", {1}), ("bob", {2, 3})):
        db.execute(f"SET ROLE {role}")
        assert {r[0] for r in q(db, "SELECT id FROM m")} == want
        assert {r[0] for r in q(db, "SELECT id FROM v")} == want  # by view
        assert {r[0] for r in q(db, "SELECT x.id FROM (SELECT id FROM m) AS x WHERE x.id IN (SELECT id FROM m)")} == want
        db.execute("RESET role")
    db.execute("SET ROLE bob")
    with pytest.raises(PermissionDenied):
        db.execute("INSERT INTO m VALUES (9, 'ann')")
    with pytest.raises(PermissionDenied):
        db.execute("UPDATE m SET tenant = 'ann'")
    db.execute("RESET role")
    db.execute("CREATE UNIQUE INDEX one ON m (id)")
    db.execute("SET ROLE bob")
    with pytest.raises(PermissionDenied):
        db.execute("INSERT INTO m VALUES (1, 'bob') ON CONFLICT (id) DO UPDATE SET tenant = 'bob'")
    assert db.execute("INSERT INTO m VALUES (2, 'bob') ON CONFLICT (id) DO UPDATE SET tenant = 'bob'").count == 1
    assert db.execute("DELETE FROM m WHERE id < 3").count == 1
    for bad in ("DROP TABLE m", "CREATE ROLE z", "GRANT SELECT ON other TO bob", "SELECT * FROM other", "SELECT id FROM m WHERE id IN (SELECT id FROM other)", "INSERT INTO m SELECT id, 'bob' FROM other", "COPY other TO '/tmp/none'", "TRUNCATE m"):
        with pytest.raises(PermissionDenied):
            db.execute(bad)
    db.execute("RESET role")
    assert {r[0] for r in q(db, "SELECT id FROM m")} == {1, 3}
    db.script("ALTER ROLE bob BYPASSRLS; SET ROLE bob")
    assert len(q(db, "SELECT * FROM m")) == 2
    db.script("RESET role; REVOKE readers FROM bob; ALTER ROLE bob NOBYPASSRLS; SET ROLE bob")
    with pytest.raises(PermissionDenied):
        db.execute("SELECT * FROM m")


def test_owner_is_fenced_by_force_only(db):
    db.script("CREATE ROLE own; SET ROLE own; CREATE TABLE t (id INT); INSERT INTO t VALUES (1); ALTER TABLE t ENABLE ROW LEVEL SECURITY")
    assert q(db, "SELECT * FROM t") == [(1,)]
    db.execute("ALTER TABLE t FORCE ROW LEVEL SECURITY")
    assert q(db, "SELECT * FROM t") == []
    db.execute("CREATE POLICY all_ ON t FOR SELECT TO own USING (id > 0)")
    assert q(db, "SELECT * FROM t") == [(1,)] and db.execute("DELETE FROM t").count == 0


def test_a_bare_boolean_guard_fences(db):
    db.script("CREATE TABLE t (id INT, open BOOL); INSERT INTO t VALUES (1, TRUE), (2, FALSE), (3, NULL); CREATE ROLE r; GRANT SELECT ON t TO r; ALTER TABLE t ENABLE ROW LEVEL SECURITY; CREATE POLICY p ON t USING (open); SET ROLE r")
    assert q(db, "SELECT id FROM t") == [(1,)]


def test_alter_and_dump_and_restore(db, tmp_path):
    db.script(
        "CREATE TABLE p (id INT PRIMARY KEY, name TEXT NOT NULL); CREATE TABLE c (id SERIAL PRIMARY KEY, pid INT REFERENCES p (id), note TEXT DEFAULT 'it''s'); INSERT INTO p VALUES (1, 'a''b'), (2, 'c'); INSERT INTO c (pid) VALUES (1); "
        "CREATE INDEX i ON p (name); CREATE UNIQUE INDEX u ON c (pid, note); CREATE VIEW v AS SELECT name FROM p"
    )
    point = db.txid_current()
    db.script("ALTER TABLE c ADD COLUMN k INT DEFAULT 3; ALTER TABLE c RENAME COLUMN note TO memo; DELETE FROM c")
    for bad in ("ALTER TABLE c DROP COLUMN pid", "ALTER TABLE p RENAME COLUMN id TO key"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("ALTER TABLE c DROP COLUMN IF EXISTS nope")
    script = [r["statement"] for r in db.dump().orderBy("step").collect()]
    again = Database(db.spark, f"file://{tmp_path}/again")
    for s in script:
        again.execute(s)
    assert q(again, "SELECT * FROM v ORDER BY name") == [("a'b",), ("c",)] and again.schema_sql() == db.schema_sql()
    then = db.restore_as_of(f"file://{tmp_path}/then", point)
    assert q(then, "SELECT COUNT(*) FROM p") == [(2,)]
    assert q(db.backup(f"file://{tmp_path}/now"), "SELECT COUNT(*) FROM c") == [(0,)]
    db.execute("VACUUM")
    assert {r["table_name"]: r["rows"] for r in db.dbstat().collect()} == {"p": 2, "c": 0}


def test_copy_round_trip(db, tmp_path):
    db.execute("CREATE TABLE s (id INT, name TEXT, ok BOOL, v VECTOR, m DECIMAL(9, 2))")
    db.execute("INSERT INTO s VALUES (1, 'a,\"b\"', TRUE, '[1, 2.5]', 1.5), (2, NULL, FALSE, NULL, NULL), (3, 'two\nlines', NULL, '[0]', 2), (0, '  spaced ', NULL, NULL, 0)")
    db.execute(f"COPY s TO '{tmp_path}/out' HEADER")
    db.execute("CREATE TABLE d (id INT, name TEXT, ok BOOL, v VECTOR, m DECIMAL(9, 2), CHECK (id < 3))")
    with pytest.raises(ConstraintError):
        db.execute(f"COPY d FROM '{tmp_path}/out' HEADER")
    db.execute("CREATE TABLE e (id INT, name TEXT, ok BOOL, v VECTOR, m DECIMAL(9, 2))")
    db.execute(f"COPY e FROM '{tmp_path}/out' HEADER")
    assert sorted(q(db, "SELECT * FROM e")) == sorted(q(db, "SELECT * FROM s"))


def test_indexed_search_is_the_exact_one_on_small_tables(db):
    db.execute("CREATE TABLE t (id INT, tag TEXT, e VECTOR(2))")
    db.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, 't{i % 3}', '[{i}, 0]')" for i in range(60)))
    sql = "SELECT id FROM t ORDER BY e <-> '[7, 0]' LIMIT 3"
    exact = q(db, sql)
    db.execute("SET vector_index = on")
    assert q(db, sql) == exact and exact[0] == (7,)
    db.execute("DELETE FROM t WHERE id = 7")
    assert (7,) not in q(db, sql)  # a write makes the index anew
    assert q(db, "SELECT id FROM t WHERE tag = 't1' ORDER BY e <-> '[6, 0]' LIMIT 1") == [(4,)]  # a WHERE goes the exact way
    assert db.knn("t", "e", [0.0, 0.0], 2).select("id").collect()[0][0] == 0


def test_explain_and_analyze(db):
    db.script("CREATE TABLE t (id INT, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'a'), (3, NULL)")
    text = "\n".join(r[0] for r in q(db, "EXPLAIN SELECT id FROM t WHERE id > 1"))
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in text and "ReadSchema: struct<id:bigint>" in text
    assert q(db, "EXPLAIN ANALYZE SELECT id FROM t WHERE id > 1")[-1][0].startswith("rows=2 ms=")
    stats = {r["column_name"]: r for r in db.execute("ANALYZE t").frame.collect()}
    assert stats["id"]["distinct"] == 3 and stats["v"]["nulls"] == 1 and stats["id"]["high"] == 3


def test_memory_store(spark, tmp_path):
    m = MemoryStore(spark, f"file://{tmp_path}/m", 2)
    m.ensure_schema()
    m.ensure_schema()
    a = m.store("orion", "likes tea", [1, 0])
    m.store("orion", "likes rain", [0, 1])
    m.store("vega", "secret", [1, 0])
    assert m.store_many("vega", spark.createDataFrame([("bulk", [0.0, 2.0])], "fact string, embedding array<float>")) == 1
    assert [r[1] for r in m.recall("orion", [1, 0.1], 5)] == ["likes tea", "likes rain"]
    assert not m.forget("vega", a) and m.forget("orion", a)
    assert [r[1] for r in m.recall("orion", [1, 0])] == ["likes rain"]


def test_two_writers_of_one_folder(spark, tmp_path):
    """Each sees what the other committed; of two transactions that began together the second is refused and loses nothing of the first."""
    from tidemark.store.log import Conflict

    a, b = Database(spark, f"file://{tmp_path}/shared"), Database(spark, f"file://{tmp_path}/shared")
    a.execute("CREATE TABLE n (x INT)")
    a.execute("INSERT INTO n VALUES (1)")
    b.execute("INSERT INTO n VALUES (2)")
    assert sorted(a.execute("SELECT x FROM n").rows()) == [(1,), (2,)]
    a.execute("BEGIN")
    a.execute("INSERT INTO n VALUES (3)")
    b.execute("INSERT INTO n VALUES (4)")
    with pytest.raises(Conflict):
        a.execute("COMMIT")
    assert sorted(a.execute("SELECT x FROM n").rows()) == [(1,), (2,), (4,)]
    a.execute("INSERT INTO n VALUES (5)")
    assert len(b.execute("SELECT x FROM n").rows()) == len(Database(spark, f"file://{tmp_path}/shared").execute("SELECT x FROM n").rows()) == 4


def test_upsert_folds_repeats_in_order(spark, tmp_path, monkeypatch):
    from tidemark.store import database

    monkeypatch.setattr(database, "FOLD", 3)
    db = Database(spark, f"file://{tmp_path}/fold")
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, n INT, note TEXT)")
    db.execute("INSERT INTO t VALUES (1, 0, ''), (2, 5, 'b'), (3, NULL, NULL)")
    rows = ", ".join(f"(1, {i}, '{i}')" for i in range(10)) + ", (3, 7, 'x')"
    out = db.execute(f"INSERT INTO t VALUES {rows} ON CONFLICT (k) DO UPDATE SET n = t.n + excluded.n, note = t.note || excluded.note WHERE excluded.n <> 4")
    assert out.count == 2
    assert sorted(db.execute("SELECT * FROM t").rows()) == [(1, 41, "012356789"), (2, 5, "b"), (3, None, None)]
    db.execute("INSERT INTO t VALUES (2, 1, 'c'), (2, 2, 'd') ON CONFLICT (k) DO UPDATE SET n = (SELECT MAX(k) FROM t) + excluded.n")
    assert db.execute("SELECT n, note FROM t WHERE k = 2").rows() == [(5, "b")]


def test_serial_truncate_and_columns_keep_history(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/hist")
    db.execute("CREATE TABLE t (id SERIAL PRIMARY KEY, v TEXT)")
    for v in "abc":
        db.execute(f"INSERT INTO t (v) VALUES ('{v}')")
    db.execute("INSERT INTO t VALUES (9, 'i')")
    db.execute("INSERT INTO t (v) VALUES ('j')")
    assert db.execute("SELECT MAX(id) FROM t").rows() == [(10,)]
    db.execute("DELETE FROM t WHERE id > 3")
    db.execute("INSERT INTO t (v) VALUES ('d')")  # the next after the greatest that is held
    assert sorted(db.execute("SELECT * FROM t").rows()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    at = db.txid_current()
    db.execute("ALTER TABLE t ADD COLUMN extra INT")
    db.execute("UPDATE t SET extra = id * 2 WHERE id < 3")
    db.execute("ALTER TABLE t DROP COLUMN v")
    db.execute("ALTER TABLE t ADD COLUMN v TEXT")
    assert sorted(db.execute("SELECT id, extra, v FROM t").rows()) == [(1, 2, None), (2, 4, None), (3, None, None), (4, None, None)]
    assert db.execute("TRUNCATE t").count == 4 and db.execute("SELECT COUNT(*) FROM t").rows() == [(0,)]
    db.execute("INSERT INTO t (extra) VALUES (7)")
    assert db.execute("SELECT id, extra FROM t").rows() == [(1, 7)]
    db.execute(f"SET transaction_time = {at}")
    assert sorted(db.execute("SELECT id, extra FROM t").rows()) == [(1, None), (2, None), (3, None), (4, None)]


def test_vector_index_is_kept_and_follows_writes(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/vec")
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, e VECTOR(2))")
    db.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, VECTOR '[{i}, {i % 7}]')" for i in range(60)))
    near = lambda d: [r[0] for r in d.execute("SELECT id FROM t ORDER BY e <-> VECTOR '[20, 6]' LIMIT 1").rows()]
    db.execute("SET vector_index = on")
    assert near(db) == [20] and near(db) == [20]
    db.execute("INSERT INTO t VALUES (100, VECTOR '[20, 5.9]')")
    db.execute("DELETE FROM t WHERE id = 20")
    path = dict(db._indexes)
    assert near(db) == [100] and list(db._indexes) == list(path)
    again = Database(spark, f"file://{tmp_path}/vec")
    again.execute("SET vector_index = on")
    assert near(again) == [100] and list(again._indexes) == list(path)
    db.execute("UPDATE t SET e = VECTOR '[20, 6]' WHERE id = 3")
    assert near(again) == [3]
    db.execute("TRUNCATE t")
    assert near(again) == []


def test_repl_says_when_there_are_more_rows(spark, monkeypatch):
    from tidemark import repl

    monkeypatch.setattr(repl, "SHOWN", 3)
    assert repl._table(spark.range(3)).endswith("(3 rows)")
    assert repl._table(spark.range(4)).endswith("(first 3 rows, there are more)") and "\n3" not in repl._table(spark.range(4))
