import numpy as np
import pytest

from tidemark.llm.cluster import cluster_vectors
from tidemark.llm.vectors import components

SCHEMA = "id long, embedding array<float>, unit string"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in e] if e is not None else None, "clash") for i, e in zip(ids, x)], SCHEMA).repartition(3)


def truth(ids, x, least=0.86, members=5):
    one = {}
    for i, e in zip(ids, x):
        if e is not None and len(e) == 64 and np.isfinite(e).all() and np.any(e):
            one.setdefault(int(i), np.asarray(e, dtype=np.float32).astype(float))
    names = np.array(sorted(one))
    if not len(names):
        return set()
    u = unit(np.stack([one[n] for n in names]))
    i, j = np.nonzero(u @ u.T >= least)
    label = components(len(names), i, j)
    size = np.bincount(label, minlength=len(names))
    return {(int(names[k]), int(names[label[k]])) for k in range(len(names)) if size[label[k]] >= members}


def blob(rng, n, noise, centre=None):
    c = rng.standard_normal(64) if centre is None else centre
    return c / np.linalg.norm(c) + rng.standard_normal((n, 64)) * noise


def arc(n, step, axes=(0, 1)):
    """Points along a circle: neighbours are similar, the ends are not."""
    out = np.zeros((n, 64))
    out[:, axes[0]], out[:, axes[1]] = np.cos(np.arange(n) * step), np.sin(np.arange(n) * step)
    return out


def got(spark, ids, x, **kw):
    return {tuple(r) for r in cluster_vectors(frame(spark, ids, x), **kw).members.collect()}


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(7)
    parts = [blob(rng, n, 0.02) for n in (400, 60, 20, 9, 6, 5, 4, 3, 2)] + [rng.standard_normal((150, 64))]
    parts += [arc(30, 0.2, (2, 3)), arc(12, 0.5, (4, 5)), blob(rng, 40, 0.055)]
    x = np.concatenate(parts)
    ids = rng.permutation(len(x)) + 10
    return ids, x


def test_matches_brute_force(spark, mixed):
    ids, x = mixed
    assert got(spark, ids, x) == truth(ids, x)


def test_chains_without_any_seed(spark, mixed):
    """With hardly any seeds nearly all is left to the exact check, and comes out the same."""
    ids, x = mixed
    assert got(spark, ids, x, rounds=1, steps=0) == truth(ids, x)


def test_wide_clusters_join_over_cores(spark):
    """Two dense groups and a bridge between them are one cluster."""
    rng = np.random.default_rng(8)
    a, b = np.zeros(64), np.zeros(64)
    a[0] = 1
    b[0], b[1] = np.cos(0.62), np.sin(0.62)
    x = np.concatenate([blob(rng, 80, 0.01, a), blob(rng, 80, 0.01, b), blob(rng, 10, 0.01, a + b), rng.standard_normal((60, 64))])
    ids = np.arange(len(x))
    want = truth(ids, x)
    assert len({c for _, c in want}) == 1 and got(spark, ids, x) == want
    y = np.concatenate([x[:160], x[170:]])  # without the bridge: near, and linked only where two vectors are
    assert got(spark, np.arange(len(y)), y) == truth(np.arange(len(y)), y)


def test_thin_chains_of_loose_vectors_stay_whole(spark, monkeypatch):
    """Many chains of five whose links are barely similar, in many small blocks (before: cells of pivots)."""
    import tidemark.llm.cluster as cluster

    for name, value in (("LOOSE", 700), ("PER_PIVOT", 4), ("PROBES", 4)):
        monkeypatch.setattr(cluster, name, value, raising=False)
    rng = np.random.default_rng(12)
    parts = []
    for _ in range(500):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        parts.append(np.outer(np.cos(np.arange(5) * 0.52), a) + np.outer(np.sin(np.arange(5) * 0.52), b))
    x = np.concatenate(parts)
    ids = rng.permutation(len(x))
    want = truth(ids, x)
    assert len(want) == 2500 and got(spark, ids, x) == want


def test_dirty_and_repeated_rows(spark):
    rng = np.random.default_rng(9)
    x = list(blob(rng, 4, 0.01)) + list(blob(rng, 5, 0.01))
    ids = list(range(9))
    x += [x[0], x[0], x[5], None, [0.0] * 64, [float("nan")] * 64, [1.0] * 3]  # re-deliveries make no fifth member
    ids += [0, 0, 5, 20, 21, 22, 23]
    assert got(spark, ids, x) == truth(ids, x) == {(i, 4) for i in range(4, 9)}


def test_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([np.tile(rng.standard_normal(64), (1000, 1)), blob(rng, 1000, 0.02), rng.standard_normal((1000, 64))])
    ids = np.arange(3000)
    assert got(spark, ids, x) == truth(ids, x)


def test_sizes_and_typical_members(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([blob(rng, 50, 0.02), blob(rng, 7, 0.02)])
    res = cluster_vectors(frame(spark, range(57), x))
    rows = {r["cluster_id"]: r for r in res.clusters.collect()}
    assert {k: r["size"] for k, r in rows.items()} == {0: 50, 50: 7}
    u = unit(x[:50].astype(np.float32).astype(float))
    centre = u.sum(axis=0)
    assert list(rows[0]["typical"]) == np.argsort(-(u @ centre), kind="stable")[:3].tolist()


def test_typical_members_of_clusters_without_a_seed(spark, mixed):
    """Chains and small clusters have no centre of k-means; their members are ranked by their own centroid."""
    ids, x = mixed
    want, at = {}, {int(n): i for i, n in enumerate(ids)}
    for i, c in truth(ids, x):
        want.setdefault(c, []).append(i)
    u = unit(x.astype(np.float32).astype(float))
    rows = cluster_vectors(frame(spark, ids, x), rounds=1, steps=0).clusters.collect()
    assert {r["cluster_id"]: r["size"] for r in rows} == {c: len(m) for c, m in want.items()}
    for r in rows:
        names = np.array(sorted(want[r["cluster_id"]]))
        own = u[[at[n] for n in names]]
        total = own.sum(axis=0)
        far = -np.round(own @ total / np.linalg.norm(total), 9)
        assert list(r["typical"]) == names[np.lexsort((names, far))][:3].tolist()


def test_nothing_usable(spark):
    res = cluster_vectors(frame(spark, [1, 2], [None, [0.0] * 64]))
    assert res.members.count() == 0 and res.clusters.count() == 0


def run_batches(f, columns, rows=1000):
    import pyarrow as pa

    return list(f(iter(pa.table(columns).to_batches(max_chunksize=rows))))


def sent(x):
    from types import SimpleNamespace

    return SimpleNamespace(value=x)


def test_loose_vectors_reach_cores_with_members_only(monkeypatch):
    """Before, every loose vector was sent to every empty core, all of a table's in one batch."""
    import pyarrow as pa

    import tidemark.llm.cluster as cluster
    from tidemark.llm.vectors import pack

    monkeypatch.setattr(cluster, "BLOCK", 64)
    rng = np.random.default_rng(21)
    x = np.concatenate([blob(rng, 300, 0.06, np.eye(64)[0]), rng.standard_normal((200, 64))]).astype(np.float32)
    centres = unit(np.concatenate([blob(rng, 6, 0.05, np.eye(64)[0]), rng.standard_normal((20, 64))])).astype(np.float32)
    radius = np.where(np.arange(26) % 3 == 1, -np.pi, 0.2)
    theta = float(np.arccos(0.86))
    out = run_batches(cluster._reach_loose(sent(centres), sent(radius), theta, 64), {"id": pa.array(np.arange(500)), "vec": pack(x)})
    got_ = [(n, c) for b in out for n, c in zip(b.column("node").to_pylist(), b.column("unit").to_pylist())]
    far = np.arccos(np.clip(unit(x) @ centres.T, -1, 1))
    want = {(int(n), int(c)) for n, c in zip(*np.nonzero((far <= radius + theta) & (radius >= 0)))}
    assert len(want) >= 1000 and len(got_) == len(set(got_)) and set(got_) == want
    assert max(b.num_rows for b in out) <= 64


def test_equal_cores_are_compared_in_little_memory():
    """Two blocks of which all pairs are similar. Before, all 16 million pairs were held at once."""
    import tracemalloc

    import pyarrow as pa

    import tidemark.llm.cluster as cluster
    from tidemark.llm.vectors import pack

    n = cluster.BLOCK
    columns = {
        "place": pa.array(["p-0-1/0/0"] * (2 * n)),
        "node": pa.array(np.repeat([5, 3], n)),
        "side": pa.array(np.repeat([0, 1], n), pa.int32()),
        "vec": pack(np.ones((2 * n, 64), dtype=np.float32)),
    }
    tracemalloc.start()
    try:
        out = run_batches(cluster._compare(0.86, 64), columns)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(b.column("a").to_pylist(), b.column("b").to_pylist()) for b in out] == [([5], [3])]
    assert peak < 200e6


def test_sums_come_in_small_batches(monkeypatch):
    import pyarrow as pa

    import tidemark.llm.cluster as cluster
    from tidemark.llm.vectors import pack

    monkeypatch.setattr(cluster, "BLOCK", 16)
    x = np.eye(64, dtype=np.float32)
    x = np.repeat(x, 3, axis=0)
    out = run_batches(cluster._sums(sent(np.eye(64, dtype=np.float32)), 64), {"id": pa.array(np.arange(192)), "vec": pack(x)})
    assert max(b.num_rows for b in out) <= 16 and sum(sum(b.column("n").to_pylist()) for b in out) == 192
