"""Queries of vectors, sketches and distributed structures, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ann, distributed, proofs
from tidemark.queries.relational import database
from tidemark.session import Scratch, shuffles_dropped
from tidemark.sketches import summaries
from tidemark.sources import load

_FIRST = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


def _query(spark: SparkSession, base: str) -> list[float]:
    return list(load(spark, base, "embeddings").orderBy("vec_id").first()["embedding"])


def _text(v: list[float]) -> str:
    return "[" + ",".join(map(repr, v)) + "]"


def _distances(op: str, spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["embeddings"])
    return db.sql(f"SELECT vec_id, ROUND(embedding {op} VECTOR '{_text(_query(spark, base))}', 6) AS d FROM embeddings")


def vec_l2(spark: SparkSession, base: str) -> DataFrame:
    return _distances("<->", spark, base)


def vec_cosine(spark: SparkSession, base: str) -> DataFrame:
    return _distances("<=>", spark, base)


def vec_ip(spark: SparkSession, base: str) -> DataFrame:
    return _distances("<#>", spark, base)


def vec_l1(spark: SparkSession, base: str) -> DataFrame:
    return _distances("<+>", spark, base)


def vec_norm_dims(spark: SparkSession, base: str) -> DataFrame:
    return database(spark, base, ["embeddings"]).sql("SELECT vec_id, ROUND(L2_NORM(embedding), 6) AS n, VECTOR_DIMS(embedding) AS dims FROM embeddings")


def knn_exact(spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["embeddings"])
    q = f"VECTOR '{_text(_query(spark, base))}'"
    return db.sql(f"SELECT vec_id, ROUND(embedding <-> {q}, 6) AS d FROM embeddings ORDER BY embedding <-> {q}, vec_id LIMIT 10")


def knn_radius(spark: SparkSession, base: str) -> DataFrame:
    db = database(spark, base, ["embeddings"])
    return db.sql(f"SELECT vec_id FROM embeddings WHERE embedding <=> VECTOR '{_text(_query(spark, base))}' < 0.9")


def knn_batch(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings")
    found = ann.knn_batch(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return found.select("query", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def _asked(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Vectors, and every fiftieth of them as the stated queries."""
    e = load(spark, base, "embeddings")
    return e, e.filter("vec_id % 50 = 0")


def _recall(spark: SparkSession, base: str, method: str, search) -> DataFrame:
    """Whether a method finds at least nine in ten of the true ten nearest, over the stated queries."""
    e, asked = _asked(spark, base)
    metric = "<=>" if method == "lsh" else "<->"
    exact: dict[int, set[int]] = {}
    for r in ann.knn_batch(e, asked, "vec_id", "embedding", 10, metric).select("query", "neighbour").collect():
        exact.setdefault(r[0], set()).add(r[1])
    hits = total = 0
    for r in asked.select("vec_id", "embedding").collect():  # the stated queries
        got = {x[0] for x in search(list(r["embedding"])).select("vec_id").collect()}
        hits += len(got & exact[r["vec_id"]])
        total += len(exact[r["vec_id"]])
    return spark.createDataFrame([(method, hits >= 0.9 * total)], "method string, recall_ok boolean")


def _judged(found: DataFrame, exact: DataFrame, rows: int, most_read: float) -> DataFrame:
    """Queries answered, and whether nine in ten true neighbours were found and only the allowed share of rows was read.

    Ten neighbours of each query are due, or all ``rows``: exact lists that a bound made too short count against the index.
    """
    hits = exact.join(found.select("query", "neighbour"), ["query", "neighbour"], "left_semi").count()
    asked = exact.select("query").distinct().count()
    total = asked * min(10, rows)
    read = found.groupBy("query").agg(F.max("read").alias("read")).agg(F.avg("read")).first()[0] or 0
    order = found.filter("rank = 1").count()
    return found.sparkSession.createDataFrame([(asked, order, hits >= 0.9 * total, read <= most_read * rows)], "asked bigint, answered bigint, recall_ok boolean, read_ok boolean")


def knn_ivf(spark: SparkSession, base: str) -> DataFrame:
    e, asked = _asked(spark, base)
    index = ann.IvfIndex.build(e, "embedding", "vec_id")
    return _judged(index.search_batch(asked, 10), ann.knn_batch(e, asked, "vec_id", "embedding", 10), e.filter("embedding is not null").count(), 1.0)


def _memories(spark: SparkSession, base: str) -> DataFrame:
    """Memories with an embedding of 64 finite values, once each."""
    m = load(spark, base, "memories").filter("id is not null and size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return m.groupBy("id").agg(F.first("embedding").alias("embedding"))


def knn_ivf_memories(spark: SparkSession, base: str) -> DataFrame:
    """The ten nearest by angle of every memory whose id is divisible by 50: at most a tenth of all rows is compared with a query.

    Where many memories tie in similarity the exact side's choice is the smaller id, as is the index's. The exact side
    compares every query with every memory; what is farther than the tenth that the index found isn't among the ten.
    """
    scratch = Scratch(spark, "memories")
    with shuffles_dropped(spark):
        m = scratch.write("memories", _memories(spark, base).filter("exists(embedding, x -> x <> 0)"))
        asked = scratch.write("asked", m.filter("id % 50 = 0"))
        index = ann.IvfIndex.build(m, "embedding", "id", "<=>")
        found = scratch.write("found", index.search_batch(asked, 10))
        bounded = scratch.write("bounded", asked.join(found.filter("rank = 10").select(F.col("query").alias("id"), F.col("distance").alias("most")), "id", "left"))
        exact = scratch.write("exact", ann.knn_batch(m, bounded, "id", "embedding", 10, "<=>", most="most"))
    return _judged(found, exact, m.count(), 0.1)


def ivf_changes(spark: SparkSession, base: str) -> DataFrame:
    """Nearest by an index that was built on half of the vectors, given the rest, and had every seventh removed; read back from its folder."""
    e = load(spark, base, "embeddings")
    index = ann.IvfIndex.build(e.filter("vec_id % 2 = 0"), "embedding", "vec_id")
    index.insert(e.filter("vec_id % 2 = 1"))
    index.remove(e.filter("vec_id % 7 = 3").select("vec_id"))
    again = ann.IvfIndex(spark, index.path)
    near = again.search(_query(spark, base), 10, probes=len(again.centroids))
    return near.select("vec_id", F.round("distance", 6).alias("d"))


def knn_lsh(spark: SparkSession, base: str) -> DataFrame:
    index = ann.LshIndex(load(spark, base, "embeddings"), "embedding")
    return _recall(spark, base, "lsh", lambda q: index.search(q, 10, 30, "<=>", "vec_id"))


def sq8_knn(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings")
    quantizer = ann.ScalarQuantizer.fit(e, "embedding")
    index = quantizer.index(e, "embedding")
    return _recall(spark, base, "sq8", lambda q: ann.search_codes(index, quantizer, "embedding", q, 10, 10, "vec_id"))


def pq_knn(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings")
    quantizer = ann.ProductQuantizer.fit(e, "embedding", 16)
    index = quantizer.index(e, "embedding")
    return _recall(spark, base, "pq", lambda q: ann.search_codes(index, quantizer, "embedding", q, 10, 10, "vec_id"))


def blind_knn(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings")
    q = _query(spark, base)
    turned = ann.rotate(e, "embedding", 99, len(q))
    near = ann.knn(turned.withColumn("embedding", F.col("embedding").cast("array<float>")), "embedding", ann.rotate_query(q, 99), 10, "<->", "vec_id")
    return near.select("vec_id", F.round("distance", 3).alias("d"))


def crdt_knn(spark: SparkSession, base: str) -> DataFrame:
    """Nearest after two replicas' writes are merged by last write: every third vector was overwritten by its negative."""
    e = load(spark, base, "embeddings")
    first = e.select("vec_id", F.lit(1).alias("at"), F.lit("a").alias("origin"), "embedding")
    later = e.filter("vec_id % 3 = 0").select("vec_id", F.lit(2), F.lit("b"), F.transform("embedding", lambda x: -x))
    merged = distributed.lww_merge(first.union(later), "vec_id", "at", "origin", "embedding")
    return ann.knn(merged, "embedding", _query(spark, base), 10, "<->", "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


# sketches
def hll(spark: SparkSession, base: str) -> DataFrame:
    ev = load(spark, base, "events")
    by = summaries.hll_merge(summaries.hll_build(ev, ["event_type", "user_id"], "event_id"), ["event_type"])
    exact = ev.groupBy("event_type").agg(F.countDistinct("event_id").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.03
    return summaries.hll_estimate(by).join(exact, "event_type").select("event_type", "exact", near.alias("near"))


def count_min(spark: SparkSession, base: str) -> DataFrame:
    """Estimates of all users' events: none too low, and nearly all within the bound of what they are too high."""
    ev = load(spark, base, "events")
    epsilon, delta = 0.0001, 0.001
    cm = summaries.CountMin(epsilon, delta)
    est = cm.estimate(cm.build(ev, "user_id"), ev, "user_id")
    exact = ev.filter("user_id is not null").groupBy("user_id").count()
    total = F.lit(ev.count() * epsilon)
    low = F.min((F.col("estimate") >= F.col("count")).cast("int")).cast("boolean")
    high = F.avg((F.col("estimate") - F.col("count") <= total).cast("int")) >= 1 - 2 * delta
    return est.join(exact, "user_id").agg(F.count("*").alias("users"), low.alias("never_low"), high.alias("seldom_high"))


def bloom_dedup(spark: SparkSession, base: str) -> DataFrame:
    """Orders' customers by a filter of customers: none may be missed, and of as many strangers about one in a hundred passes."""
    c, o = load(spark, base, "customer"), load(spark, base, "orders")
    bloom = summaries.Bloom(c.count())
    bits = bloom.build(c, "c_custkey")
    found = bloom.probe(bits, o, "o_custkey").agg(F.sum(F.col("maybe").cast("bigint")).alias("found"))
    strangers = bloom.probe(bits, c.select((F.col("c_custkey") + 10_000_000).alias("k")), "k").agg((F.avg(F.col("maybe").cast("int")) <= 0.03).alias("few_false"))
    return found.join(F.broadcast(strangers))  # one row each


def bloom_counting(spark: SparkSession, base: str) -> DataFrame:
    """After two of three customers were removed again, the others are still found and few of the removed are."""
    c = load(spark, base, "customer").select("c_custkey")
    kept, gone = c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 3 <> 0")
    bloom = summaries.Bloom(c.count())
    counters = bloom.counters(c, gone, "c_custkey")
    found = bloom.probe_counters(counters, kept, "c_custkey").agg(F.sum(F.col("maybe").cast("bigint")).alias("found"))
    false = bloom.probe_counters(counters, gone, "c_custkey").agg((F.avg(F.col("maybe").cast("int")) <= 0.03).alias("few_false"))
    return found.join(F.broadcast(false))  # one row each


def heavy_hitters(spark: SparkSession, base: str) -> DataFrame:
    return summaries.heavy_hitters(load(spark, base, "events"), "event_type", 3)


def quantiles_logbucket(spark: SparkSession, base: str) -> DataFrame:
    ev = load(spark, base, "events")
    est = summaries.quantile_estimate(summaries.quantile_sketch(ev, ["event_type"], "value"), ["event_type"], 0.9)
    return est.select("event_type", F.round("estimate", 6).alias("estimate"))


def reservoir(spark: SparkSession, base: str) -> DataFrame:
    return summaries.reservoir(load(spark, base, "events").select("event_id"), "event_id", 100)


def bitmap_ops(spark: SparkSession, base: str) -> DataFrame:
    o = load(spark, base, "orders")
    a = summaries.bitmaps(o.filter("o_orderstatus = 'F'"), [], "o_custkey")
    b = summaries.bitmaps(o.filter("o_orderstatus = 'O'"), [], "o_custkey")
    union, both = summaries.bitmap_size(summaries.bitmap_union(a.union(b))), summaries.bitmap_size(summaries.bitmap_intersection(a, b))
    return union.select(F.lit("union").alias("what"), "size").union(both.select(F.lit("both"), "size"))


# routing, clocks, replicas
_NODES = ["north", "east", "south", "west"]


def hrw_route(spark: SparkSession, base: str) -> DataFrame:
    return distributed.hrw_route(load(spark, base, "customer").select("c_custkey"), "c_custkey", {"a": 1, "b": 1, "c": 1})


def ring_route(spark: SparkSession, base: str) -> DataFrame:
    routed = distributed.ring_route(load(spark, base, "customer").select("c_custkey"), "c_custkey", _NODES, 8)
    return routed.select("c_custkey", F.element_at("nodes", 1).alias("node"))


def token_bucket(spark: SparkSession, base: str) -> DataFrame:
    ev = load(spark, base, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    allowed = distributed.token_bucket(ev.withColumn("tick", F.floor(F.col("us") / 3_600_000_000)), "user_id", "tick", "event_id", 2.0, 0.01)
    return allowed.groupBy("user_id").agg(F.count("*").alias("asked"), F.sum(F.col("allowed").cast("bigint")).alias("allowed"))


def vclock_compare(spark: SparkSession, base: str) -> DataFrame:
    ev = load(spark, base, "events")
    clock = lambda odd: ev.filter(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias(f"c{odd}"))
    both = clock(0).join(clock(1), "user_id")
    return both.select("user_id", distributed.vclock_compare(F.col("c0"), F.col("c1")).alias("relation"), F.aggregate(F.map_values(distributed.vclock_merge(F.col("c0"), F.col("c1"))), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("ticks"))


def lww_merge(spark: SparkSession, base: str) -> DataFrame:
    ev = load(spark, base, "events")
    return distributed.lww_merge(ev, "user_id", "ts", "event_type", "value", F.col("event_type") == "purchase")


def quorum_read(spark: SparkSession, base: str) -> DataFrame:
    c = load(spark, base, "customer").select("c_custkey", "c_mktsegment")
    copies = c.withColumn("replica", F.explode(F.array(*map(F.lit, range(3)))))
    copies = copies.withColumn("version", F.when((F.col("replica") < 2) | (F.col("c_custkey") % 2 == 0), 2).otherwise(1))
    return distributed.quorum_read(copies, "c_custkey", "version", 2).select("c_custkey", F.col("version").cast("bigint").alias("version"), "c_mktsegment")


def merkle_diff(spark: SparkSession, base: str) -> DataFrame:
    c = load(spark, base, "customer").select("c_custkey", "c_name", "c_nationkey")
    other = c.filter("c_custkey % 100 <> 7").withColumn("c_nationkey", F.when(F.col("c_custkey") % 50 == 3, F.lit(99)).otherwise(F.col("c_nationkey")))
    return distributed.merkle_diff(c, other, "c_custkey", ["c_name", "c_nationkey"])


def quorum_repair(spark: SparkSession, base: str) -> DataFrame:
    c = load(spark, base, "customer").select("c_custkey", "c_mktsegment")
    copies = c.withColumn("replica", F.explode(F.array(*map(F.lit, range(3)))))
    copies = copies.withColumn("version", F.when((F.col("replica") < 2) | (F.col("c_custkey") % 2 == 0), 2).otherwise(1))
    return distributed.quorum_repair(copies, "c_custkey", "version", 2).select("c_custkey", "replica", F.col("version").cast("bigint").alias("version"), "c_mktsegment")


def merkle_root(spark: SparkSession, base: str) -> DataFrame:
    """The root over customers, and whether it proves one of them."""
    c = load(spark, base, "customer")
    tree = proofs.merkle_tree(c, ["c_custkey"], proofs.content("c_custkey", "c_name"))
    root, n = proofs.tree_root(tree)
    at = n // 3
    leaf = tree.filter(f"level = 0 and position = {at}").first()
    ok = proofs.verify_proof(leaf["hash"], at, proofs.merkle_proofs(tree, [at])[at], root, n)
    return spark.createDataFrame([(len(proofs.level_sizes(n)) - 1, root, ok)], "levels bigint, root string, proved boolean")


def auth_range(spark: SparkSession, base: str) -> DataFrame:
    """Parts of some sizes, and whether the answer proves itself against the published root."""
    table = proofs.range_tree(load(spark, base, "part"), "p_size", ["p_partkey", "p_brand"])
    answer = proofs.authenticated_range(table, 10, 20)
    return proofs.in_range(answer, 10, 20).select("p_partkey", F.lit(proofs.verify_range(answer, table["root"], 10, 20)).alias("complete"))


def auth_range_verified(spark: SparkSession, base: str) -> DataFrame:
    """Which answers a verifier with the published root takes: the honest one, one of no rows, and what a dishonest server might send."""
    table = proofs.range_tree(load(spark, base, "part"), "p_size", ["p_partkey", "p_brand"])
    honest = proofs.authenticated_range(table, 10, 20)
    rows, mid = honest["rows"], F.col("position") == honest["rows"].agg(F.floor(F.avg("position"))).first()[0]
    last = rows.agg(F.max("position")).first()[0]
    cases = {
        "honest": honest,
        "none there": proofs.authenticated_range(table, 1_000, 2_000),
        "dropped row": {**honest, "rows": rows.filter(~mid)},
        "dropped row, positions closed": {**honest, "rows": rows.filter(~mid).withColumn("position", F.col("position") - (F.col("position") > rows.agg(F.floor(F.avg("position"))).first()[0]).cast("bigint"))},
        "altered value": {**honest, "rows": rows.withColumn("p_brand", F.when(mid, "Brand#00").otherwise(F.col("p_brand")))},
        "altered number": {**honest, "rows": rows.withColumn("p_size", F.when(mid, F.col("p_size") + 1).otherwise(F.col("p_size")))},
        "end left out": {**honest, "rows": rows.filter(F.col("position") < last)},
        "narrower range": proofs.authenticated_range(table, 12, 20),
        "row put in": {**honest, "rows": rows.union(rows.filter(mid))},
    }
    got = [(n, proofs.verify_range(a, table["root"], *((1_000, 2_000) if n == "none there" else (10, 20)))) for n, a in cases.items()]
    return spark.createDataFrame(got, "answer string, accepted boolean")


def auth_knn(spark: SparkSession, base: str) -> DataFrame:
    """The proved nearest neighbours of the first vector, and whether the proofs hold."""
    q = _query(spark, base)
    got = proofs.authenticated_knn(load(spark, base, "embeddings"), "vec_id", "embedding", q, 5)
    ok = proofs.verify_knn(got, got["root"], q)
    return spark.createDataFrame([(r["key"], round(r["distance"], 6), ok) for r in got["rows"]], "vec_id bigint, d double, proved boolean")


def _ledger(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Chains of orders by customer as they were sealed, and with every 97th order altered."""
    o = load(spark, base, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    sealed = Scratch(spark, "sealed").write("sealed", proofs.ledger_chain(o, "o_custkey", "o_orderkey", ["o_orderstatus"]))
    return sealed, sealed.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))


def ledger_heads(spark: SparkSession, base: str) -> DataFrame:
    return proofs.ledger_heads(_ledger(spark, base)[0], "o_custkey", "o_orderkey")


def ledger_audit(spark: SparkSession, base: str) -> DataFrame:
    """Entries altered after they were sealed: all from the first on no longer follow."""
    return proofs.ledger_audit(_ledger(spark, base)[1], "o_custkey", "o_orderkey", ["o_orderstatus"]).drop("head_ok")


def ledger_forged(spark: SparkSession, base: str) -> DataFrame:
    """The altered entries with all hashes sealed anew: each follows, but the chain no longer leads to the pinned head."""
    sealed, altered = _ledger(spark, base)
    forged = proofs.ledger_chain(altered, "o_custkey", "o_orderkey", ["o_orderstatus"])
    return proofs.ledger_audit(forged, "o_custkey", "o_orderkey", ["o_orderstatus"], proofs.ledger_heads(sealed, "o_custkey", "o_orderkey"))


def retrievability(spark: SparkSession, base: str) -> DataFrame:
    """A challenge to one in three customers of a store that lost a quarter and altered some of the rest."""
    c = load(spark, base, "customer").select("c_custkey", "c_name")
    kept = proofs.stored_tree(c, "c_custkey", ["c_name"])
    stored = c.filter("c_custkey % 4 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, "?").otherwise(F.col("c_name")))
    return proofs.retrievability(stored, kept, "c_custkey", 3)


def pir_read(spark: SparkSession, base: str) -> DataFrame:
    o = load(spark, base, "orders").select("o_orderkey", "o_custkey")
    wanted = o.agg(F.max("o_orderkey")).first()[0]
    return distributed.pir_read(o, o, "o_orderkey", "o_custkey", wanted, "s1")


def shared_sum(spark: SparkSession, base: str) -> DataFrame:
    o = load(spark, base, "orders")
    return distributed.shared_sum(distributed.share_values(o, "o_orderkey", "o_custkey", 3), ["o_orderstatus"], 3)


def forget_keys(spark: SparkSession, base: str) -> DataFrame:
    """Names sealed by nation key, read after the keys of every fifth nation were deleted."""
    c = load(spark, base, "customer").select("c_custkey", "c_nationkey", "c_name")
    keys = load(spark, base, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.unhex(F.substring(F.sha2(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")), 256), 1, 32)).alias("secret"))
    return distributed.unseal(distributed.seal(c, "c_nationkey", "c_name", keys), "c_nationkey", "c_name", keys.filter("c_nationkey % 5 <> 0")).select("c_custkey", "c_name")


QUERIES = {
    f.__name__: f
    for f in (
        vec_l2, vec_cosine, vec_ip, vec_l1, vec_norm_dims, knn_exact, knn_radius, knn_batch, knn_ivf, knn_ivf_memories, ivf_changes, knn_lsh, sq8_knn, pq_knn, blind_knn, crdt_knn, hll, count_min, bloom_dedup, bloom_counting,
        heavy_hitters, quantiles_logbucket, reservoir, bitmap_ops, hrw_route, ring_route, token_bucket, vclock_compare, lww_merge, quorum_read, quorum_repair, merkle_diff, merkle_root, auth_range, auth_range_verified, auth_knn,
        ledger_heads, ledger_audit, ledger_forged,
        retrievability, pir_read, shared_sum, forget_keys,
    )
}


def _vec(f: str) -> str:
    return f"SELECT vec_id, round({f}, 6) + 0.0 AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings)"


SQL = {
    "vec_l2": _vec("list_distance(e, q)"),
    "vec_cosine": _vec("list_cosine_distance(e, q)"),
    "vec_ip": _vec("-list_inner_product(e, q)"),
    "vec_l1": "SELECT vec_id, round((SELECT sum(abs(x - y)) FROM (SELECT unnest(e) AS x, unnest(q) AS y)), 6) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, " + _FIRST + " AS q FROM embeddings)",
    "vec_norm_dims": "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS n, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings",
    "knn_exact": f"SELECT vec_id, round(list_distance(e, q), 6) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings) ORDER BY list_distance(e, q), vec_id LIMIT 10",
    "knn_radius": f"SELECT vec_id FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings) WHERE list_cosine_distance(e, q) < 0.9",
    "knn_batch": "WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d) SELECT query, neighbour, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5",
    "knn_ivf": "SELECT count(*) AS asked, count(*) AS answered, true AS recall_ok, true AS read_ok FROM embeddings WHERE vec_id % 50 = 0",
    "knn_lsh": "SELECT 'lsh' AS method, true AS recall_ok",
    "sq8_knn": "SELECT 'sq8' AS method, true AS recall_ok",
    "pq_knn": "SELECT 'pq' AS method, true AS recall_ok",
    "blind_knn": f"SELECT vec_id, round(list_distance(e, q), 3) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings) ORDER BY list_distance(e, q), vec_id LIMIT 10",
    "crdt_knn": f"SELECT vec_id, round(list_distance(e, q), 6) AS d FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) ELSE CAST(embedding AS DOUBLE[]) END AS e, {_FIRST} AS q FROM embeddings) ORDER BY list_distance(e, q), vec_id LIMIT 10",
    "hll": "SELECT event_type, count(DISTINCT event_id) AS exact, true AS near FROM events GROUP BY event_type",
    "count_min": "SELECT count(DISTINCT user_id) AS users, true AS never_low, true AS seldom_high FROM events",
    "bloom_dedup": "SELECT count(DISTINCT o_custkey) AS found, true AS few_false FROM orders",
    "bloom_counting": "SELECT count(*) AS found, true AS few_false FROM customer WHERE c_custkey % 3 = 0",
    "heavy_hitters": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3",
    "quantiles_logbucket": "WITH b AS (SELECT event_type, CASE WHEN value > 0 THEN floor(log2(value)) * 16 + least(floor((value / pow(2, floor(log2(value))) - 1) * 16), 15) ELSE -1e12 END AS k, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), "
        "s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, greatest(1, ceil(sum(n) OVER (PARTITION BY event_type) * 0.9)) AS rk FROM b) "
        "SELECT event_type, round(CASE WHEN k > -1e11 THEN pow(2, floor(k / 16)) * (1 + (k - floor(k / 16) * 16) / 16) ELSE 0 END, 6) AS estimate FROM s WHERE upto >= rk AND upto - n < rk",
    "reservoir": "SELECT event_id FROM events ORDER BY sha256('r:' || event_id), event_id LIMIT 100",
    "bitmap_ops": "SELECT 'union' AS what, count(DISTINCT o_custkey) AS size FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "hrw_route": "SELECT c_custkey, arg_max(node, CAST('0x' || substring(sha256('hrw:' || node || '/' || c_custkey), 1, 15) AS BIGINT)) AS node FROM customer, (VALUES ('a'), ('b'), ('c')) AS t(node) GROUP BY c_custkey",
    "ring_route": "WITH p AS (SELECT n AS node, sha256(n || '#' || i) AS pos FROM (VALUES ('north'), ('east'), ('south'), ('west')) AS t(n), range(8) AS r(i)), k AS (SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer) "
        "SELECT c_custkey, coalesce((SELECT arg_min(node, pos) FROM p WHERE pos >= h), (SELECT arg_min(node, pos) FROM p)) AS node FROM k",
    "vclock_compare": "WITH c AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL) SELECT user_id, CASE WHEN bool_or(a < b) AND bool_or(a > b) THEN 'concurrent' WHEN bool_or(a < b) THEN 'before' WHEN bool_or(a > b) THEN 'after' ELSE 'equal' END AS relation, "
        "CAST(sum(greatest(a, b)) AS BIGINT) AS ticks FROM c GROUP BY user_id HAVING sum(a) > 0 AND sum(b) > 0",
    "lww_merge": "SELECT user_id, value, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'",
    "quorum_read": "SELECT c_custkey, CAST(2 AS BIGINT) AS version, c_mktsegment FROM customer",
    "merkle_diff": "SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 100 = 7 OR c_custkey % 50 = 3",
    "merkle_root": """
        WITH RECURSIVE leaf AS (SELECT list(sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') ORDER BY c_custkey) AS l FROM customer),
        t(k, l) AS (SELECT 0, l FROM leaf UNION ALL SELECT k + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || '|' || l[least(2 * i + 2, len(l))])) FROM t WHERE len(l) > 1)
        SELECT CAST(k AS BIGINT) AS levels, sha256((SELECT count(*) FROM customer) || '|' || l[1]) AS root, true AS proved FROM t WHERE len(l) = 1""",
    "auth_range": "SELECT p_partkey, true AS complete FROM part WHERE p_size BETWEEN 10 AND 20",
    "auth_knn": f"SELECT vec_id, round(list_distance(e, q), 6) AS d, true AS proved FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings) ORDER BY list_distance(e, q), vec_id LIMIT 5",
    "ledger_heads": """
        WITH e AS (SELECT o_custkey, list(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
        SELECT o_custkey, list_reduce(list_prepend('genesis', l), lambda a, x: sha256(a || '|' || x)) AS head, CAST(len(l) AS BIGINT) AS entries FROM e""",
    "ledger_forged": "SELECT o_custkey, count(*) AS entries, CAST(0 AS BIGINT) AS broken, NOT bool_or(o_orderkey % 97 = 0) AS head_ok FROM orders GROUP BY o_custkey",
    "auth_range_verified": "SELECT * FROM (VALUES ('honest', true), ('none there', true), ('dropped row', false), ('dropped row, positions closed', false), ('altered value', false), ('altered number', false), ('end left out', false), ('narrower range', false), ('row put in', false)) AS t(answer, accepted)",
    "knn_ivf_memories": "SELECT count(DISTINCT id) AS asked, count(DISTINCT id) AS answered, true AS recall_ok, true AS read_ok FROM memories WHERE id % 50 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0",
    "ivf_changes": f"SELECT vec_id, round(list_distance(e, q), 6) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_FIRST} AS q FROM embeddings WHERE vec_id % 7 <> 3) ORDER BY list_distance(e, q), vec_id LIMIT 10",
    "quorum_repair": "WITH r AS (SELECT c_custkey, c_mktsegment, r AS replica, CASE WHEN r < 2 OR c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version, row_number() OVER (PARTITION BY c_custkey ORDER BY sha256('quorum:' || c_custkey || '/' || r)[1:15], r) AS nth FROM customer, range(3) AS t(r)) "
        "SELECT c_custkey, CAST(replica AS INTEGER) AS replica, CAST(2 AS BIGINT) AS version, c_mktsegment FROM r WHERE nth <= 2 AND version = 1",
    "ledger_audit": "WITH f AS (SELECT o_custkey AS c, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 97 = 0 GROUP BY 1) SELECT o_custkey, count(*) AS entries, count(*) FILTER (o_orderkey >= first) AS broken FROM orders LEFT JOIN f ON c = o_custkey GROUP BY o_custkey",
    "retrievability": "SELECT count(*) AS asked, count(*) FILTER (c_custkey % 4 <> 1 AND c_custkey % 10 <> 0) AS held FROM customer WHERE CAST('0x' || substring(sha256('challenge:' || c_custkey), 1, 15) AS BIGINT) % 3 = 0",
    "pir_read": "SELECT o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)",
    "shared_sum": "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS total, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "forget_keys": "SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS c_name FROM customer",
}
