import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ann, distributed, proofs
from tidemark.operators.ordering import dense_positions
from tidemark.sketches import summaries
from tidemark.store import secrets


# sketches
def test_hll_merges(spark):
    df = spark.range(20_000).selectExpr("id % 7 k", "id % 5000 v", "id % 3 part")
    parts = summaries.hll_build(df, ["k", "part"], "v")
    est = {r["k"]: r["estimate"] for r in summaries.hll_estimate(summaries.hll_merge(parts, ["k"])).collect()}
    exact = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    assert all(abs(est[k] - exact[k]) <= 0.03 * exact[k] for k in exact)


def test_count_min_never_low_and_merges(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 400 AS STRING) END v")
    cm = summaries.CountMin(0.005, 0.01)
    whole = cm.build(df, "v")
    halves = cm.merge(cm.build(df.limit(2000), "v"), cm.build(df.limit(2000), "v"))
    assert halves.agg(F.sum("n")).first()[0] == 2 * 2000 * cm.depth
    exact = {r["v"]: r["count"] for r in df.groupBy("v").count().collect()}
    est = {r["v"]: r["estimate"] for r in cm.estimate(whole, df.union(spark.createDataFrame([("absent",), (None,)], "v string")), "v").collect()}
    assert all(exact[v] <= est[v] <= exact[v] + 0.005 * 5000 for v in exact) and est["absent"] <= 25


def test_bloom(spark):
    df = spark.range(1000).selectExpr("CAST(id AS STRING) v")
    bloom = summaries.Bloom(1000, 0.01)
    built = bloom.build(df, "v")
    assert bloom.probe(built, df, "v").filter("not maybe").count() == 0
    others = spark.range(1000, 6000).selectExpr("CAST(id AS STRING) v")
    assert bloom.probe(built, others, "v").filter("maybe").count() < 0.03 * 5000
    counters = bloom.counters(df, df.filter("v < '5'"), "v")
    assert bloom.probe_counters(counters, df.filter("v >= '5'"), "v").filter("not maybe").count() == 0
    assert bloom.probe_counters(counters, df.filter("v < '5'"), "v").filter("maybe").count() < 50
    assert bloom.build(df.limit(0), "v").count() == 0


def test_heavy_hitters_and_reservoir(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 4 = 0 THEN 'b' ELSE CAST(id AS STRING) END v")
    assert [tuple(r) for r in summaries.heavy_hitters(df, "v", 2).collect()] == [("a", 1000), ("b", 500)]
    draws = [sorted(r["id"] for r in summaries.reservoir(df.repartition(n), "id", 50).collect()) for n in (1, 6)]
    assert draws[0] == draws[1] and len(draws[0]) == 50
    mean = np.mean([r["id"] for s in "abcd" for r in summaries.reservoir(df, "id", 200, s).collect()])
    assert abs(mean - 1500) < 150


@pytest.mark.parametrize("q", [0.01, 0.5, 0.99])
def test_quantiles(spark, q):
    rnd = random.Random(4)
    values = [rnd.lognormvariate(0, 3) for _ in range(4000)] + [0.0, -3.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = summaries.quantile_estimate(summaries.quantile_sketch(df, [], "v"), [], q).first()[0]
    true = sorted(v for v in values if v is not None and not math.isnan(v))[max(0, math.ceil(q * 4002) - 1)]
    assert got <= true <= got * (1 + 1 / 16) * 1.0001


def test_bitmaps(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "n long") for x in ({1, 2, 70_000, 5}, {2, 5, 99_999}))
    ma, mb = summaries.bitmaps(a.union(a), [], "n"), summaries.bitmaps(b, [], "n")
    assert summaries.bitmap_size(summaries.bitmap_union(ma.union(mb))).first()[0] == 5
    assert summaries.bitmap_size(summaries.bitmap_intersection(ma, mb)).first()[0] == 2
    assert summaries.bitmap_size(ma.limit(0)).first()[0] == 0


# ordering, routing, rates
def test_dense_positions(spark):
    rows = list(range(500))
    random.Random(1).shuffle(rows)
    got = dense_positions(spark.createDataFrame([(r,) for r in rows], "v long").repartition(7), ["v"]).collect()
    assert all(r["position"] == r["v"] for r in got) and len(got) == 500
    assert dense_positions(spark.createDataFrame([], "v long"), ["v"]).count() == 0


def test_routing_moves_few_keys(spark):
    df = spark.range(2000)
    three, four = {"a": 1, "b": 1, "c": 2}, {"a": 1, "b": 1, "c": 2, "d": 1}
    x = {r["id"]: r["node"] for r in distributed.hrw_route(df, "id", three).collect()}
    y = {r["id"]: r["node"] for r in distributed.hrw_route(df, "id", four).collect()}
    assert all(y[i] in (x[i], "d") for i in x) and 0.4 < sum(v == "c" for v in x.values()) / 2000 < 0.6
    nodes = ["a", "b", "c", "d"]
    got = {r["id"]: r["nodes"] for r in distributed.ring_route(df, "id", nodes, 32, 3).collect()}
    less = {r["id"]: r["nodes"] for r in distributed.ring_route(df, "id", nodes[:3], 32, 3).collect()}
    assert all(len(set(v)) == 3 for v in got.values())
    assert all(less[i][0] == v[0] for i, v in got.items() if v[0] != "d")
    at, owners = distributed.ring(nodes, 32)
    h = hashlib.sha256(b"17").hexdigest()
    assert got[17][0] == next((o for p, o in zip(at, owners) if p >= h), owners[0])


def test_token_bucket(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{i % 20}", rnd.randrange(1000), i) for i in range(1500)] + [(None, 5, 9000), ("k1", None, 9001)]
    got = {r["tie"]: r["allowed"] for r in distributed.token_bucket(spark.createDataFrame(rows, "k string, t long, tie long"), "k", "t", "tie", 3.0, 0.05).collect()}
    level, last = {}, {}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] or "", r[1], r[2])):
        now = min(3.0, level.get(k, 3.0) + (t - last.get(k, t)) * 0.05)
        assert got[i] == (now >= 1)
        level[k], last[k] = now - (now >= 1), t
    assert got[9001] is False


# clocks, replicas, trees, audits
def test_vector_clocks(spark):
    rows = [({"a": 1}, {"a": 1, "b": 0}, "equal"), ({"a": 1}, {"a": 2}, "before"), ({"a": 1, "b": 1}, {"a": 1}, "after"), ({"a": 2}, {"a": 1, "b": 1}, "concurrent"), ({}, {}, "equal")]
    df = spark.createDataFrame(rows, "x map<string,long>, y map<string,long>, want string")
    for r in df.select("want", distributed.vclock_compare(F.col("x"), F.col("y")).alias("got"), distributed.vclock_merge(F.col("x"), F.col("y")).alias("m")).collect():
        assert r["got"] == r["want"]


def test_last_write_wins_in_any_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(20), rnd.randrange(5), rnd.choice("ab"), rnd.randrange(9), rnd.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, at long, o string, v long, dead boolean")
    got = {r["k"]: r["v"] for r in distributed.lww_merge(df, "k", "at", "o", "v", F.col("dead")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        w = max((r[1:] for r in rows if r[0] == k))
        if not w[3]:
            want[k] = w[2]
    assert got == want


def test_quorums_overlap(spark):
    rows = [(k, r, 2 if r != k % 3 else 1) for k in range(50) for r in range(3)]  # written to two of three
    got = distributed.quorum_read(spark.createDataFrame(rows, "k long, replica int, version long"), "k", "version", 2).collect()
    assert all(r["version"] == 2 for r in got) and 0 < sum(r["stale"] for r in got) < 50


def test_merkle_diff_and_proofs(spark):
    a = spark.range(600).selectExpr("id k", "id * 2 v")
    b = a.filter("k % 100 <> 5").withColumn("v", F.when(F.col("k") % 100 == 7, -1).otherwise(F.col("v"))).union(spark.createDataFrame([(9999, 1)], "k long, v long"))
    got = {r["k"]: r["change"] for r in distributed.merkle_diff(a, b, "k", ["v"]).collect()}
    assert got == {**{k: "removed" for k in range(5, 600, 100)}, **{k: "changed" for k in range(7, 600, 100)}, 9999: "added"}
    assert distributed.merkle_diff(a, a.repartition(5), "k", ["v"]).count() == 0
    root = lambda x: distributed.merkle_buckets(x, "k", ["v"]).filter("level = 0").first()["digest"]
    assert root(a) == root(a.repartition(3)) != root(b)
    for n in (1, 2, 5, 8, 600):
        tree = proofs.merkle_tree(a.filter(f"k < {n}"), ["k"], proofs.content("k", "v"))
        root, leaves = proofs.tree_root(tree)
        assert leaves == n and tree.count() == sum(proofs.level_sizes(n))
        leaf = {r["position"]: r["hash"] for r in tree.filter("level = 0").collect()}
        asked = range(n) if n < 10 else [0, 1, 298, 599]
        for p, proof in proofs.merkle_proofs(tree, list(asked)).items():
            assert proofs.verify_proof(leaf[p], p, proof, root, n) and not proofs.verify_proof("x" + leaf[p][1:], p, proof, root, n)
            assert not proofs.verify_proof(leaf[p], p, proof, root, n + 1) and not proofs.verify_proof(leaf[p], n, proof, root, n)
            if n > 1:
                assert not proofs.verify_proof(leaf[p], p ^ 1, proof, root, n)
    assert proofs.tree_root(proofs.merkle_tree(a.limit(0), ["k"], proofs.content("k", "v"))) == (None, 0)
    assert [distributed.digits_for(n) for n in (0, 64, 65, 1024, 1025, 10**9)] == [0, 0, 1, 1, 2, 6]


@pytest.mark.parametrize("levels", [2, 14])
def test_a_tree_folded_in_rounds_is_the_same(spark, monkeypatch, levels):
    """The root doesn't depend on how many levels a task folds."""
    monkeypatch.setattr(proofs, "LEVELS", levels)
    nodes = [proofs.hashlib.sha256(str(i).encode()).hexdigest() for i in range(37)]
    batch = proofs.pa.RecordBatch.from_arrays([proofs.pa.array(range(37)), proofs.pa.array(nodes)], names=["position", "hash"])
    got, first = nodes, 0
    sizes = proofs.level_sizes(37)
    while first < len(sizes) - 1:
        out = [x for b in proofs._fold(first, sizes, {})(iter([batch])) for x in zip(*(b.column(i).to_pylist() for i in range(3)))]
        first = min(first + levels, len(sizes) - 1)
        got = [h for k, _, h in sorted(out) if k == first]
        batch = proofs.pa.RecordBatch.from_arrays([proofs.pa.array(range(len(got))), proofs.pa.array(got)], names=["position", "hash"])
    want = nodes
    while len(want) > 1:
        want = want + want[-1:] if len(want) & 1 else want
        want = [proofs._pair(x, y) for x, y in zip(want[::2], want[1::2])]
    assert got == want


def test_authenticated_range(spark):
    df = spark.range(41).selectExpr("id k", "nullif(id % 10, 9) v", "if(id % 3 = 0, null, 'x|y') body")
    table = proofs.range_tree(df, "v", ["k", "body"])
    for low, high, n in ((3, 4, 8), (0, 8, 37), (-5, -1, 0), (50, 60, 0), (8, 8, 4), (0, 0, 5)):
        answer = proofs.authenticated_range(table, low, high)
        assert proofs.in_range(answer, low, high).count() == n and proofs.verify_range(answer, table["root"], low, high)
        assert not proofs.verify_range(answer, "0" * 64, low, high)
        assert not proofs.verify_range({**answer, "n": 36}, table["root"], low, high)
    answer = proofs.authenticated_range(table, 3, 4)
    forged = {**answer, "rows": answer["rows"].withColumn("v", F.when(F.col("v") == 3, 4).otherwise(F.col("v")))}
    shorter = {**answer, "rows": answer["rows"].filter("v > 3")}
    nulled = {**answer, "rows": answer["rows"].withColumn("body", F.coalesce("body", F.lit("")))}
    assert not any(proofs.verify_range(x, table["root"], 3, 4) for x in (forged, shorter, nulled, {**answer, "rows": answer["rows"].limit(0)}))
    empty = proofs.range_tree(df.limit(0), "v", ["k"])
    assert proofs.verify_range(proofs.authenticated_range(empty, 1, 2), empty["root"], 1, 2)


def test_authenticated_knn(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)] + [(99, None)], "id long, e array<float>")
    q = [0.5] * 8
    got = proofs.authenticated_knn(df, "id", "e", q, 5)
    assert len(got["rows"]) == 5 and proofs.verify_knn(got, got["root"], q)
    assert not proofs.verify_knn(got, "0" * 64, q)
    forged = {**got, "rows": [{**got["rows"][0], "vector": [0.5] * 8}, *got["rows"][1:]]}
    assert not proofs.verify_knn(forged, got["root"], q)
    swapped = {**got, "rows": got["rows"][::-1]}
    assert not proofs.verify_knn(swapped, got["root"], q)


@pytest.mark.parametrize("segment", [7, 4096])
def test_ledger(spark, monkeypatch, segment):
    """One chain holds most entries; a chain cut into segments still commits every entry to all before it."""
    monkeypatch.setattr(proofs, "SEGMENT", segment)
    df = spark.range(200).selectExpr("if(id % 8 < 6, 0, id % 8) chain", "id seq", "nullif(CAST(id * 3 AS STRING), '30') body")
    seal = lambda x: proofs.ledger_chain(x, "chain", "seq", ["body"])
    audit = lambda x, h=None: {r["chain"]: (r["broken"], r["head_ok"]) for r in proofs.ledger_audit(x, "chain", "seq", ["body"], h).collect()}
    sealed = seal(df).cache()
    heads = proofs.ledger_heads(sealed, "chain", "seq").cache()
    assert audit(sealed, heads) == {0: (0, True), 6: (0, True), 7: (0, True)}
    rows = sorted((r["seq"], r["hash"]) for r in sealed.filter("chain = 0").collect())
    assert len({h for _, h in rows}) == len(rows) == 150
    grown = {r["seq"]: r["hash"] for r in seal(df.union(spark.createDataFrame([(0, 900, "new"), (6, 901, "new")], "chain long, seq long, body string"))).filter("chain = 0").collect()}
    assert all(grown[q] == h for q, h in rows)  # appending changes no entry
    bad = sealed.withColumn("body", F.when(F.col("seq") == 50, "x").otherwise(F.col("body")))
    after = sum(q >= 50 for q, _ in rows)
    assert audit(bad)[0] == (after, None) and audit(bad)[6] == (0, None)
    assert audit(seal(bad), heads) == {0: (0, False), 6: (0, True), 7: (0, True)}  # forged and sealed anew
    assert audit(sealed.filter("seq <> 51"), heads)[0] == (after - 2, False)
    assert audit(sealed.filter("seq < 190"), heads)[0] == (0, False)  # cut off at the end
    assert audit(sealed.filter("chain <> 7"), heads)[7] == (0, False)  # a whole chain gone
    assert audit(sealed.filter("seq is null"), heads.limit(0)) == {}


def test_private_reads_and_shares(spark):
    df = spark.range(300).selectExpr("id pos", "id * id + 7 v")
    for want in (0, 17, 299):
        assert distributed.pir_read(df, df, "pos", "v", want, "s").first()[0] == want * want + 7
    signed = df.withColumn("k", F.col("pos") % 3).withColumn("v", F.when(F.col("k") == 1, -F.col("v")).when(F.col("pos") == 3, None).otherwise(F.col("v")))
    shared = distributed.share_values(signed, "pos", "v", 3)
    got = {r["k"]: (r["total"], r["n"]) for r in distributed.shared_sum(shared, ["k"], 3).collect()}
    want = {k: (sum((i * i + 7) * (-1 if k == 1 else 1) for i in range(k, 300, 3) if i != 3), 100 - (k == 0)) for k in range(3)}
    assert got == want
    one = distributed.share_values(signed, "pos", "v", 2).agg(F.countDistinct("share_0"), F.min("share_0"), F.max("share_1")).first()
    assert one[0] == 299 and one[1] >= 0 and one[2] < distributed.MODULUS
    assert distributed.share_values(signed, "pos", "v", 2).first()["share_0"] != distributed.share_values(signed, "pos", "v", 2).first()["share_0"]
    assert proofs.detection_chance(0.5, 3) == 0.875


def test_retrievability_and_forgetting(spark):
    df = spark.range(400).selectExpr("id k", "CAST(id AS STRING) body")
    kept = proofs.stored_tree(df, "k", ["body"])
    ask = lambda stored, one_in=4: tuple(proofs.retrievability(stored, kept, "k", one_in).first())
    asked, held = ask(df)
    assert asked == held > 50 and ask(df, 1) == (400, 400)
    assert ask(df.filter("k % 2 = 0"), 1) == (400, 200)
    assert ask(df.withColumn("body", F.when(F.col("k") == 7, "forged").otherwise(F.col("body"))), 1) == (400, 399)
    forged = {**kept, "tree": kept["tree"].withColumn("hash", F.when(F.col("level") == 3, "0").otherwise(F.col("hash")))}
    assert tuple(proofs.retrievability(df, forged, "k", 1).first()) == (400, 0)  # proofs that don't lead to the root
    keys = spark.range(4).selectExpr("id who", "unhex(substring(sha2(CAST(id AS STRING), 256), 1, 32)) secret")
    text = df.selectExpr("k", "k % 4 who", "body")
    sealed = distributed.seal(text, "who", "body", keys)
    assert sealed.filter("CAST(body AS STRING) = CAST(k AS STRING)").count() == 0
    open_ = distributed.unseal(sealed, "who", "body", keys.filter("who <> 2"))
    assert open_.filter("body = CAST(k AS STRING)").count() == 300 and open_.filter("body is null").count() == 100


def test_secrets():
    assert secrets.password_matches("p", secrets.password_record("p")) and not secrets.password_matches("q", secrets.password_record("p"))
    token = secrets.issue_token(b"k", {"tenant": "a", "expires": 10})
    assert secrets.read_token(b"k", token, 9)["tenant"] == "a"
    for key, t, now in ((b"z", token, 0), (b"k", token, 10), (b"k", "00" + token[2:], 0)):
        with pytest.raises(ValueError):
            secrets.read_token(key, t, now)
    shares = secrets.split_secret(b"secret \x00\xff", 5, 3)
    assert secrets.join_secret(shares[1:4]) == secrets.join_secret([shares[4], shares[0], shares[2]]) == b"secret \x00\xff"
    assert secrets.join_secret(shares[:2]) != b"secret \x00\xff"
    log = secrets.ForwardLog(b"first")
    for e in (b"a", b"b"):
        log.append(e)
    assert secrets.ForwardLog.verify(b"first", log.entries) and not secrets.ForwardLog.verify(b"first", log.entries[::-1])


# vectors
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((25, 16)) * 3
    x = (centres[rng.integers(0, 25, 1500)] + rng.standard_normal((1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id long, e array<float>")
    df.cache().count()
    return df, x.astype(float)


def brute(x, q, k, metric):
    return np.argsort(np.round(ann.block_distances(q[None, :], x, metric)[0], 9), kind="stable")[:k].tolist()


@pytest.mark.parametrize("metric", ann.METRICS)
def test_exact_and_blocked_agree(spark, vectors, metric):
    df, x = vectors
    got = [r["id"] for r in ann.knn(df, "e", x[3].tolist(), 10, metric, "id").collect()]
    assert got == brute(x, x[3], 10, metric)
    rows = ann.knn_batch(df, df.filter("id % 500 = 0"), "id", "e", 4, metric, query_block=2).collect()
    for q in (0, 500, 1000):
        assert [r["neighbour"] for r in sorted((r for r in rows if r["query"] == q), key=lambda r: r["rank"])] == brute(x, x[q], 4, metric)


def test_indexes_recall(spark, vectors):
    df, x = vectors
    ivf, lsh = ann.IvfIndex.build(df, "e", "id"), ann.LshIndex(df, "e")
    sq, pq = ann.ScalarQuantizer.fit(df, "e"), ann.ProductQuantizer.fit(df, "e", 8)
    si, pi = sq.index(df, "e"), pq.index(df, "e")
    asked = range(0, 1500, 150)
    searches = {
        "ivf": (lambda q: ivf.search(q, 10), "<->"), "lsh": (lambda q: lsh.search(q, 10, 20, tie="id"), "<=>"),
        "sq8": (lambda q: ann.search_codes(si, sq, "e", q, 10, 5, "id"), "<->"), "pq": (lambda q: ann.search_codes(pi, pq, "e", q, 10, 10, "id"), "<->"),
    }
    for name, (search, metric) in searches.items():
        hit = 0
        for i in asked:
            got = [r["id"] for r in search(x[i].tolist()).collect()]
            assert got[0] == i and len(got) == len(set(got)) == 10  # a vector finds itself, and no row twice
            hit += len(set(got) & set(brute(x, x[i], 10, metric)))
        assert hit >= 0.9 * 10 * len(asked), name
    more = [len(set(r["id"] for r in ivf.search(x[7].tolist(), 10, probes=p).collect()) & set(brute(x, x[7], 10, "<->"))) for p in (1, 10, 38)]
    assert more == sorted(more) and more[-1] == 10


def test_quantizer_follows_drift():
    rng = np.random.default_rng(8)
    first = rng.standard_normal((128, 12))
    fixed, moving = (ann.ScalarQuantizer(first.min(axis=0), first.max(axis=0)) for _ in range(2))
    stream = rng.standard_normal((1500, 12)) * np.linspace(1, 30, 1500)[:, None]
    for v in stream:
        moving.observe(v[None, :])
    assert 0 < moving.recalibrated < 0.02 * 1500
    queries = stream[rng.integers(0, 1500, 64)] + rng.standard_normal((64, 12)) * 0.1

    def recall(q):
        codes = q.decode(q.encode(stream))
        return np.mean([len(set(brute(codes, v, 10, "<->")) & set(brute(stream, v, 10, "<->"))) / 10 for v in queries])

    assert recall(moving) > 0.85 > recall(fixed)


def test_rotation_keeps_distances(spark, vectors):
    df, x = vectors
    turned = ann.rotate(df, "e", 5, 16).toPandas().sort_values("id")
    y = np.stack(turned["e"].to_numpy())
    assert not np.allclose(y[0], x[0]) and np.allclose(ann.block_distances(y[:5], y, "<->"), ann.block_distances(x[:5], x, "<->"), atol=1e-5)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "id long, e array<float>")
    assert ann.knn(df, "e", [1.0], 3).count() == 0 and ann.knn_batch(df, df, "id", "e", 3).count() == 0
    assert ann.IvfIndex.build(df, "e", "id").search([1.0], 3).count() == 0


def test_an_index_is_kept_and_follows_changes(spark, tmp_path):
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((40, 16)) * 4
    x = (centres[rng.integers(0, 40, 2000)] + rng.standard_normal((2000, 16)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id long, e array<float>").repartition(3).cache()
    built = ann.IvfIndex.build(df.filter("id < 1500 or id > 4000"), "e", "id", path=f"file://{tmp_path}/index")
    built.insert(df.filter("id >= 1500 and id < 4000"))
    built.remove(spark.range(0, 2000, 10))
    moved = spark.createDataFrame([(10, x[3].tolist()), (11, x[4].tolist())], "id long, e array<float>")
    built.insert(moved)  # 10 comes back, 11 moves
    index = ann.IvfIndex(spark, built.path)
    x[10], x[11] = x[3], x[4]
    gone = set(range(0, 2000, 10)) - {10}
    assert index.rows().count() == 2000 - len(gone) and index.probes < len(index.centroids) / 4
    asked = df.filter("id % 50 = 7 or id = 5000")
    found: dict = {}
    for r in index.search_batch(asked, 10).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["read"]))
    hits = 0
    for q, got in found.items():
        d = np.linalg.norm(x.astype(float) - x[q].astype(float), axis=1)
        d[list(gone)] = np.inf
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and got[0][2] < 600
        hits += len({g[1] for g in got} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(found) == 40 and hits >= 0.9 * 400
    assert index.search_batch(asked.limit(0), 3).count() == 0


def test_an_index_is_built_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    x, c = rng.standard_normal((20_000, 8)), rng.standard_normal((1_000, 8))
    tracemalloc.start()
    try:
        probes = ann.IvfIndex._calibrated(x, c, "<=>", 0.95)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 1 <= probes <= 1_000 and peak < 120e6  # a table of all distances alone has 160 MB


@pytest.mark.parametrize("metric", ["<=>", "<->"])
def test_more_queries_than_a_block_and_bounds(spark, metric):
    rng = np.random.default_rng(31)
    near = rng.standard_normal((40, 16))[rng.integers(0, 40, 1200)] + rng.standard_normal((1200, 16)) * 0.05
    x = np.concatenate([near, rng.standard_normal((300, 16)), np.zeros((3, 16)), np.repeat(near[:1], 30, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [float("nan")] * 16)], "id long, e array<float>").repartition(3).cache()
    asked = df.filter("id % 50 = 0 or id >= 1498")
    ids = [q for q in range(len(x)) if q % 50 == 0 or q >= 1498]

    def lists(rows):
        out: dict = {}
        for r in sorted(rows.collect(), key=lambda r: (r["query"], r["rank"])):
            out.setdefault(r["query"], []).append(r["neighbour"])
        return out

    want = {q: brute(x.astype(float), x[q].astype(float), 5, metric) for q in ids}
    exact = ann.knn_batch(df, asked, "id", "e", 5, metric)
    assert lists(exact) == want
    far = exact.filter("rank = 5").selectExpr("query as id", "distance as most")
    assert lists(ann.knn_batch(df, asked.join(far, "id", "left"), "id", "e", 5, metric, query_block=20, most="most")) == want
    none = ann.knn_batch(df, asked.withColumn("most", F.lit(-1.0)), "id", "e", 5, metric, most="most")
    assert none.count() == 0  # a bound that is too small shortens lists and lets nothing else in
    index = ann.IvfIndex.build(df, "e", "id", metric)
    cells = len(index.centroids)
    assert cells > 8 and lists(index.search_batch(asked, 5, probes=cells, query_block=20)) == want
    assert {r["read"] for r in index.search_batch(asked, 5, probes=cells).collect()} == {len(x)}
