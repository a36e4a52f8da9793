"""Queries over versioned tables: writes, constraints, travel in both times, roles and fences, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries.relational import database
from tidemark.session import Scratch
from tidemark.sources import load
from tidemark.store import secrets
from tidemark.streaming import streams


def _customers(spark: SparkSession, base: str):
    db = database(spark, base, ["customer", "orders", "nation"])
    db.execute("CREATE TABLE c (k INT PRIMARY KEY, name TEXT, nation INT, bal FLOAT)")
    db.execute("INSERT INTO c SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey > 20")
    return db


def upsert_do_update(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute(
        "INSERT INTO c SELECT c_custkey, UPPER(c_name), c_nationkey, c_acctbal FROM customer WHERE MOD(c_custkey, 10) = 0 "
        "ON CONFLICT (k) DO UPDATE SET name = excluded.name, nation = c.nation + excluded.nation WHERE excluded.nation > 3"
    )
    return db.sql("SELECT k, name, nation FROM c")


def do_nothing(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute("INSERT INTO c SELECT c_custkey, 'new', c_nationkey, c_acctbal FROM customer ON CONFLICT DO NOTHING")
    return db.sql("SELECT k, name FROM c")


def do_assert(spark: SparkSession, base: str) -> DataFrame:
    """The same facts asserted again add nothing; a contradiction is refused and leaves the table as it was."""
    db = _customers(spark, base)
    again = db.execute("INSERT INTO c SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer ON CONFLICT (k) DO ASSERT").count
    try:
        db.execute("INSERT INTO c SELECT c_custkey, c_name, c_nationkey + 1, c_acctbal FROM customer ON CONFLICT (k) DO ASSERT")
        refused = False
    except ValueError:
        refused = True
    return db.sql("SELECT COUNT(*) AS n FROM c").select("n", F.lit(again).cast("bigint").alias("added"), F.lit(refused).alias("refused"))


def update_returning(spark: SparkSession, base: str) -> DataFrame:
    return _customers(spark, base).sql("UPDATE c SET bal = bal * 2, name = name || '!' WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) RETURNING k, name, ROUND(bal, 2) AS bal")


def delete_returning(spark: SparkSession, base: str) -> DataFrame:
    return _customers(spark, base).sql("DELETE FROM c WHERE bal < 0 RETURNING k")


def insert_select_returning(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute("CREATE TABLE o (id SERIAL PRIMARY KEY, k INT REFERENCES c (k), note TEXT DEFAULT 'none')")
    return db.sql("INSERT INTO o (k) SELECT k FROM c WHERE nation = 2 RETURNING k, note")


def serial_dense(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute("CREATE TABLE o (id SERIAL PRIMARY KEY, k INT)")
    db.execute("INSERT INTO o (k) SELECT k FROM c")
    db.execute("INSERT INTO o (k) SELECT k FROM c")
    return db.sql("SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, MIN(id) AS low, MAX(id) AS high FROM o")


def fk_cascade(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute("CREATE TABLE o (id INT, k INT REFERENCES c (k) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.execute("INSERT INTO o SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 20")
    db.execute("DELETE FROM c WHERE nation < 5")
    db.execute("UPDATE c SET k = k + 1000000 WHERE nation = 7")
    return db.sql("SELECT id, k FROM o")


def txn_time_asof(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    point = db.txid_current()
    db.execute("UPDATE c SET name = 'x' WHERE nation = 1")
    db.execute("DELETE FROM c WHERE nation = 2")
    db.execute("INSERT INTO c SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey <= 20")
    db.execute(f"SET transaction_time = {point}")
    return db.sql("SELECT k, name, nation FROM c")


def txn_rollback(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.script("BEGIN; DELETE FROM c WHERE nation = 1; UPDATE c SET bal = 0.0; ROLLBACK; BEGIN; DELETE FROM c WHERE nation = 2; COMMIT")
    return db.sql("SELECT k, ROUND(bal, 2) AS bal FROM c")


def restore_as_of(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    point = db.txid_current()
    db.execute("DELETE FROM c WHERE nation < 20")
    return db.restore_as_of(Scratch(spark, "restored").root, point).sql("SELECT nation, COUNT(*) AS n FROM c GROUP BY nation")


def vacuum_keeps(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute("DELETE FROM c WHERE nation < 20")
    db.execute("VACUUM c")
    return db.sql("SELECT k FROM c")


def valid_time_asof(spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["prices", "skus"])
    db.execute("SET valid_time = TIMESTAMP '2021-06-01 00:00:00'")
    return db.sql("SELECT DISTINCT p.sku, p.price, p.valid_from FROM prices p JOIN skus s ON s.sku = p.sku")


def rls_filter(spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["memories"])
    db.execute("CREATE TABLE m AS SELECT id, LOWER(TRIM(tenant)) AS tenant, fact FROM memories")
    db.script(
        "CREATE ROLE quillbay LOGIN; GRANT SELECT ON m TO PUBLIC; ALTER TABLE m ENABLE ROW LEVEL SECURITY; "
        "CREATE POLICY own ON m USING (tenant = current_user()); SET ROLE quillbay"
    )
    return db.sql("SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, MIN(tenant) AS tenant FROM m")


def rls_default_deny(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.script("CREATE ROLE bob; GRANT SELECT ON c TO bob; ALTER TABLE c ENABLE ROW LEVEL SECURITY; CREATE VIEW v AS SELECT k FROM c; SET ROLE bob")
    return db.sql("SELECT (SELECT COUNT(*) FROM c) AS direct, COUNT(*) AS by_view FROM v")


def csv_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.execute("CREATE TABLE d (k INT, name TEXT, nation INT, bal FLOAT)")
    db.execute("UPDATE c SET name = 'a,\"b' WHERE nation = 1")
    db.execute("UPDATE c SET name = NULL WHERE nation = 2")
    path = Scratch(spark, "csv").root
    db.execute(f"COPY c TO '{path}' HEADER")
    db.execute(f"COPY d FROM '{path}' HEADER")
    return db.sql("SELECT k, name, nation, ROUND(bal, 2) AS bal FROM d")


def analyze_stats(spark: SparkSession, base: str) -> DataFrame:
    got = _customers(spark, base).execute("ANALYZE c").frame
    return got.filter("column_name in ('k', 'nation')").select("column_name", "rows", "nulls", "low", "high")


def view_expansion(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.script("CREATE VIEW rich AS SELECT k, nation FROM c WHERE bal > 5000; CREATE VIEW by_nation AS SELECT nation, COUNT(*) AS n FROM rich GROUP BY nation")
    return db.sql("SELECT n_name, n FROM by_nation JOIN nation ON n_nationkey = nation")


def alter_columns(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    db.script("ALTER TABLE c ADD COLUMN tier INT DEFAULT 4; ALTER TABLE c RENAME COLUMN bal TO balance; ALTER TABLE c DROP COLUMN name; UPDATE c SET tier = 1 WHERE balance > 9000")
    return db.sql("SELECT tier, COUNT(*) AS n, ROUND(SUM(balance), 2) AS s FROM c GROUP BY tier")


def knn_indexed(spark: SparkSession, base: str) -> DataFrame:
    """The indexed path finds the query's own row, and nothing it finds is out of order."""
    db = database(spark, base, ["embeddings"])
    db.execute("CREATE TABLE e AS SELECT vec_id, embedding FROM embeddings")
    first = load(spark, base, "embeddings").orderBy("vec_id").first()
    text = "[" + ",".join(map(repr, first["embedding"])) + "]"
    db.execute("SET vector_index = on")
    got = [r[0] for r in db.execute(f"SELECT vec_id FROM e ORDER BY embedding <-> VECTOR '{text}' LIMIT 10").rows()]
    return spark.createDataFrame([(got[0], len(got))], "nearest bigint, n bigint")


def upsert_repeats(spark: SparkSession, base: str) -> DataFrame:
    """Every order hits its customer: a key is updated as often as it has orders, in their order."""
    db = _customers(spark, base)
    db.execute("CREATE TABLE s (k INT PRIMARY KEY, orders INT, last INT)")
    db.execute("INSERT INTO s SELECT k, 0, 0 FROM c")
    db.execute(
        "INSERT INTO s SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_custkey > 20 "
        "ON CONFLICT (k) DO UPDATE SET orders = s.orders + excluded.orders, last = GREATEST(s.last, excluded.last) WHERE MOD(excluded.last, 5) <> 0"
    )
    return db.sql("SELECT k, orders, last FROM s")


def truncate_travel(spark: SparkSession, base: str) -> DataFrame:
    """A truncated table is empty but for what came after, and whole as of before."""
    db = _customers(spark, base)
    at = db.txid_current()
    db.execute("TRUNCATE c")
    db.execute("INSERT INTO c SELECT c_custkey, 'again', c_nationkey, c_acctbal FROM customer WHERE c_custkey <= 20")
    now = db.sql("SELECT 'now' AS at, COUNT(*) AS n, MAX(k) AS top FROM c")
    db.execute(f"SET transaction_time = {at}")
    return now.union(db.sql("SELECT 'before' AS at, COUNT(*) AS n, MAX(k) AS top FROM c"))


def values_and_parameters(spark: SparkSession, base: str) -> DataFrame:
    db = _customers(spark, base)
    for k, text in ((-1, "one"), (-2, None)):
        db.execute("INSERT INTO c (k, name, nation) VALUES ($1, $2, 3)", [k, text])
    return db.execute("SELECT k, name FROM c WHERE k < $1 OR nation = $2", [0, 7]).frame


def grant_and_revoke(spark: SparkSession, base: str) -> DataFrame:
    """What a role may do after each step: nothing, read, nothing again; and the table once it is dropped."""
    db = _customers(spark, base)
    db.execute("CREATE ROLE bob")

    def may(sql: str) -> bool:
        try:
            return db.execute(sql) is not None
        except (PermissionError, ValueError, RuntimeError):
            return False

    got = []
    for i, step in enumerate(("SELECT k FROM c LIMIT 1", "GRANT SELECT ON c TO bob", "REVOKE SELECT ON c FROM bob", "DROP TABLE c")):
        db.execute(step)
        db.execute("SET ROLE bob")
        got.append((i, may("SELECT COUNT(*) FROM c"), may("DELETE FROM c WHERE k < 0")))
        db.execute("RESET ROLE")
    return spark.createDataFrame(got, "step bigint, may_read boolean, may_delete boolean")


def vector_functions(spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["embeddings"])
    first = load(spark, base, "embeddings").orderBy("vec_id").first()
    q = "VECTOR '[" + ",".join(map(repr, first["embedding"])) + "]'"
    listed = ", ".join(f"ROUND({f}(embedding, {q}), 6) AS {f}" for f in ("l2_distance", "l1_distance", "cosine_distance", "inner_product"))
    return db.sql(f"SELECT vec_id, {listed} FROM embeddings")


def database_knn(spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["embeddings"])
    first = load(spark, base, "embeddings").orderBy("vec_id").first()
    return db.knn("embeddings", "embedding", list(first["embedding"]), 5).select("vec_id")


def secrets_kept(spark: SparkSession, base: str) -> DataFrame:
    """Shares, tokens and a sealed log over customers' names: what holds, and what must not."""
    names = [r[0].encode() for r in load(spark, base, "customer").orderBy("c_custkey").limit(20).select("c_name").collect()]  # a stated few
    shared = all(secrets.join_secret(secrets.split_secret(n, 5, 3)[1:4]) == n and secrets.join_secret(secrets.split_secret(n, 5, 3)[:2]) != n for n in names)
    token = secrets.issue_token(b"key", {"name": names[0].decode(), "expires": 5})

    def reads(key: bytes, now: int) -> bool:
        try:
            return secrets.read_token(key, token, now)["name"] == names[0].decode()
        except ValueError:
            return False

    log = secrets.ForwardLog(b"first")
    for n in names:
        log.append(n)
    forged = [*log.entries[:3], (b"other", log.entries[3][1]), *log.entries[4:]]
    got = [("shares", shared), ("token", reads(b"key", 4)), ("late token", reads(b"key", 5)), ("forged token", reads(b"other", 4)), ("log", secrets.ForwardLog.verify(b"first", log.entries)), ("forged log", secrets.ForwardLog.verify(b"first", forged))]
    return spark.createDataFrame(got, "what string, holds boolean")


def stream_windows(spark: SparkSession, base: str) -> DataFrame:
    return streams.run_to_table(streams.windowed_counts(streams.event_stream(spark, f"{base}/events.parquet"), "1 day", "0 seconds"), "complete")


def stream_latest(spark: SparkSession, base: str) -> DataFrame:
    return streams.latest_by_key(spark, streams.event_stream(spark, f"{base}/events.parquet"), "user_id", "ts", "event_type", "value")


QUERIES = {
    f.__name__: f
    for f in (
        upsert_do_update, do_nothing, do_assert, update_returning, delete_returning, insert_select_returning, serial_dense, fk_cascade, txn_time_asof, txn_rollback, restore_as_of, vacuum_keeps, valid_time_asof,
        rls_filter, rls_default_deny, csv_roundtrip, analyze_stats, view_expansion, alter_columns, knn_indexed, upsert_repeats, truncate_travel, values_and_parameters, grant_and_revoke, vector_functions, database_knn, secrets_kept, stream_windows, stream_latest,
    )
}

_FIRST = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
_C = "(SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS bal FROM customer WHERE c_custkey > 20)"
SQL = {
    "upsert_do_update": "SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 AND (c_custkey <= 20 OR c_nationkey > 3) THEN upper(c_name) ELSE c_name END AS name, CAST(CASE WHEN c_custkey % 10 = 0 AND c_custkey > 20 AND c_nationkey > 3 THEN 2 * c_nationkey ELSE c_nationkey END AS BIGINT) AS nation FROM customer WHERE c_custkey > 20 OR c_custkey % 10 = 0",
    "do_nothing": "SELECT c_custkey AS k, CASE WHEN c_custkey <= 20 THEN 'new' ELSE c_name END AS name FROM customer",
    "do_assert": "SELECT count(*) AS n, count(*) FILTER (c_custkey <= 20) AS added, true AS refused FROM customer",
    "update_returning": f"SELECT k, name || '!' AS name, round(bal * 2, 2) AS bal FROM {_C} WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "delete_returning": f"SELECT k FROM {_C} WHERE bal < 0",
    "insert_select_returning": f"SELECT k, 'none' AS note FROM {_C} WHERE nation = 2",
    "serial_dense": f"SELECT 2 * count(*) AS n, 2 * count(*) AS ids, CAST(1 AS BIGINT) AS low, 2 * count(*) AS high FROM {_C}",
    "fk_cascade": f"SELECT o_orderkey AS id, CASE WHEN nation = 7 THEN k + 1000000 ELSE k END AS k FROM orders JOIN {_C} ON k = o_custkey WHERE nation >= 5",
    "txn_time_asof": f"SELECT k, name, nation FROM {_C}",
    "txn_rollback": f"SELECT k, round(bal, 2) AS bal FROM {_C} WHERE nation <> 2",
    "restore_as_of": f"SELECT nation, count(*) AS n FROM {_C} GROUP BY nation",
    "vacuum_keeps": f"SELECT k FROM {_C} WHERE nation >= 20",
    "valid_time_asof": "SELECT DISTINCT p.sku, p.price, p.valid_from FROM prices p JOIN skus s ON s.sku = p.sku WHERE p.valid_from <= TIMESTAMP '2021-06-01' AND (p.valid_to IS NULL OR TIMESTAMP '2021-06-01' < p.valid_to)",
    "rls_filter": "SELECT count(*) AS n, count(DISTINCT id) AS ids, min(lower(trim(tenant))) AS tenant FROM memories WHERE lower(trim(tenant)) = 'quillbay'",
    "rls_default_deny": "SELECT CAST(0 AS BIGINT) AS direct, CAST(0 AS BIGINT) AS by_view",
    "csv_roundtrip": f"SELECT k, CASE nation WHEN 1 THEN 'a,\"b' WHEN 2 THEN NULL ELSE name END AS name, nation, round(bal, 2) AS bal FROM {_C}",
    "analyze_stats": f"SELECT 'k' AS column_name, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(k) AS low, max(k) AS high FROM {_C} UNION ALL SELECT 'nation', count(*), 0, min(nation), max(nation) FROM {_C}",
    "view_expansion": f"SELECT n_name, count(*) AS n FROM {_C} JOIN nation ON n_nationkey = nation WHERE bal > 5000 GROUP BY n_name",
    "alter_columns": f"SELECT CAST(CASE WHEN bal > 9000 THEN 1 ELSE 4 END AS BIGINT) AS tier, count(*) AS n, round(sum(bal), 2) AS s FROM {_C} GROUP BY ALL",
    "knn_indexed": "SELECT min(vec_id) AS nearest, CAST(10 AS BIGINT) AS n FROM embeddings",
    "stream_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_latest": "SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS r FROM events) WHERE r = 1",
    "upsert_repeats": "SELECT c_custkey AS k, count(o_orderkey) AS orders, coalesce(max(o_orderkey), 0) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 5 <> 0 WHERE c_custkey > 20 GROUP BY c_custkey",
    "truncate_travel": "SELECT 'now' AS at, count(*) AS n, CAST(max(c_custkey) AS BIGINT) AS top FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 'before', count(*), max(c_custkey) FROM customer WHERE c_custkey > 20",
    "values_and_parameters": "SELECT CAST(-1 AS BIGINT) AS k, 'one' AS name UNION ALL SELECT -2, NULL UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey > 20 AND c_nationkey = 7",
    "grant_and_revoke": "SELECT CAST(s AS BIGINT) AS step, s = 1 AS may_read, false AS may_delete FROM range(4) AS t(s)",
    "vector_functions": f"SELECT vec_id, round(list_distance(e, q), 6) AS l2_distance, round((SELECT sum(abs(x - y)) FROM (SELECT unnest(e) AS x, unnest(q) AS y)), 6) AS l1_distance, round(list_cosine_distance(e, q), 6) + 0.0 AS cosine_distance, round(list_inner_product(e, q), 6) AS inner_product FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings)",
    "database_knn": f"SELECT vec_id FROM (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_FIRST}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 5",
    "secrets_kept": "SELECT * FROM (VALUES ('shares', true), ('token', true), ('late token', false), ('forged token', false), ('log', true), ('forged log', false)) AS t(what, holds)",
}
