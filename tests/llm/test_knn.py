import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import knn
from tidemark.llm.knn import Curves, hilbert, nearest, similar_pairs
from tidemark.llm.vectors import pack, unpack, usable

SCHEMA = "id long, tenant string, embedding array<float>, vec string"


def blobs(rng, sizes, noise=0.03, width=64):
    out = []
    for n in sizes:
        c = rng.standard_normal(width)
        c /= np.linalg.norm(c)
        out.append((c + rng.standard_normal((n, width)) * noise) * rng.uniform(0.1, 9, (n, 1)))
    return np.concatenate(out)


def frame(spark, ids, tenants, x):
    return spark.createDataFrame([(int(i), t, [float(v) for v in e] if e is not None else None, "clash") for i, t, e in zip(ids, tenants, x)], SCHEMA)


def brute(ids, tenants, x, k=5, least=0.86):
    out = set()
    norm = lambda t: t.strip().lower() if t and t.strip() else None
    ok = [i for i, e in enumerate(x) if e is not None and len(e) == 64 and np.isfinite(np.float32(e)).all() and np.any(np.float32(e)) and norm(tenants[i])]
    for t in {norm(tenants[i]) for i in ok}:
        mine = {}
        for i in ok:
            if norm(tenants[i]) == t:
                mine.setdefault(ids[i], np.asarray(x[i], dtype=np.float32).astype(float))
        names = sorted(mine)
        u = np.stack([mine[n] / np.linalg.norm(mine[n]) for n in names])
        s = np.round(u @ u.T, 9)
        for a in range(len(names)):
            near = sorted((j for j in range(len(names)) if j != a and s[a, j] >= least), key=lambda j: (-s[a, j], names[j]))[:k]
            out |= {(min(names[a], names[j]), max(names[a], names[j])) for j in near}
    return out


def test_hilbert_visits_neighbours():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    order = cells[np.argsort(hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    assert len(set(hilbert(cells, 3).tolist())) == side**3


def test_pack_loses_nothing():
    x = np.random.default_rng(1).standard_normal((50, 64)).astype(np.float32)
    x[:20] = x[:20].astype(np.float16)
    x[3] *= 1e-30
    x[4] *= 1e30
    u = unpack(pack(x), 64, np.float64)
    y = x.astype(float) / np.abs(x).max(axis=1, keepdims=True)
    assert np.allclose(u, y / np.linalg.norm(y, axis=1, keepdims=True), atol=1e-12)


def test_dirty_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    x = list(blobs(rng, [9, 6, 1, 1]))
    x += [x[0]] * 8  # ties
    ids = list(range(len(x)))
    tenants = [["A", " a ", "a"][i % 3] for i in ids]
    x += [None, [1.0] * 32, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, x[1], x[2]]
    ids += [100, 101, 102, 103, 104, 1, 105]
    tenants += ["a"] * 5 + [" A", None]
    got = [tuple(r)[:2] for r in similar_pairs(frame(spark, ids, tenants, x)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ids, tenants, x)


def test_no_rows(spark):
    assert similar_pairs(frame(spark, [], [], [])).count() == 0
    assert similar_pairs(frame(spark, [1, 2], ["a", None], [None, [1.0] * 64])).count() == 0


def recall(got, want):
    return len(got & want) / len(want), len(got & want) / max(1, len(got))


def test_recall_in_a_task():
    rng = np.random.default_rng(3)
    x = blobs(rng, [2500] + [40] * 60 + [3] * 100 + [1] * 500)
    order = rng.permutation(len(x))
    u = x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
    a, b, _ = nearest(np.arange(len(u)), u, Curves(4), range(4))
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    r, p = recall(got, brute(list(range(len(u))), ["t"] * len(u), u))
    assert r > 0.99 and p > 0.99


@pytest.mark.parametrize("part_rows", [900, 65_536])
def test_a_tenant_of_most_rows(spark, part_rows):
    """A hot tenant is cut into parts along both curves; windows over the cuts keep its lists whole."""
    rng = np.random.default_rng(5)
    x = blobs(rng, [30] * 80 + [2] * 60 + [1] * 300)
    order = rng.permutation(len(x))
    x = x[order]
    tenants = ["hot" if i % 3 else f"t{i % 40}" for i in range(len(x))]
    got = {tuple(r)[:2] for r in similar_pairs(frame(spark, range(len(x)), tenants, x), part_rows=part_rows).collect()}
    r, p = recall(got, brute(list(range(len(x))), tenants, x))
    assert r > 0.999 and p > 0.999


def test_blocks_of_a_run_overlap():
    """Rows come out in blocks of one tenant and curve, each but a run's first with the halo before it."""
    import pyarrow as pa

    n = [3, knn.BLOCK + 10, 2 * knn.BLOCK, 5]
    names = np.repeat(["a", "b", "c", "d"], n)
    batch = pa.record_batch({"id": np.arange(sum(n)), "tenant": pa.array(names), "curve": pa.array(np.zeros(sum(n), dtype=np.int32))})
    got = list(knn._runs(iter([batch.slice(a, 10_000) for a in range(0, sum(n), 10_000)]), "curve"))
    assert [t.num_rows for t in got] == [3, knn.BLOCK, knn.HALO + 10, knn.BLOCK, knn.HALO + knn.BLOCK, 5]
    assert all(len(set(t.column("tenant").to_pylist())) == 1 for t in got)
    assert sorted({i for t in got for i in t.column("id").to_pylist()}) == list(range(sum(n)))


def scattered(rng, n, similarity, width=64):
    """Pairs, threes and fours at about ``similarity`` among as many vectors that are like no other."""
    noise = np.sqrt((1 / similarity - 1) / width)
    parts = []
    for size in (2, 3, 4):
        c = rng.standard_normal((n // (6 * size), width))
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        parts.append(np.repeat(c, size, axis=0) + rng.standard_normal((len(c) * size, width)) * noise)
    x = np.concatenate([*parts, rng.standard_normal((n - sum(map(len, parts)), width))])
    return x[rng.permutation(n)]


@pytest.mark.parametrize(("similarity", "tile", "low"), [(0.88, 1024, 0.9999), (0.92, 1024, 0.9999), (0.88, 128, 0.93), (0.96, 128, 0.985)])
def test_small_groups_among_many_others(monkeypatch, similarity, tile, low):
    """Windows that hold the tenant give exact lists; windows of a tenth of it nearly all."""
    monkeypatch.setattr(knn, "TILE", tile)
    u = scattered(np.random.default_rng(12), 5000, similarity)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b, _ = nearest(np.arange(len(u)), u, Curves(4), range(4))
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    want = brute(list(range(len(u))), ["t"] * len(u), u)
    assert len(got & want) >= low * len(want)
    assert tile < 1024 or got == want


@pytest.mark.parametrize("part_rows", [600, 65_536])
def test_many_equal_vectors_have_the_least_ids(spark, part_rows):
    """Copies of a vector, some re-delivered, are a third of a tenant; another copy-rich vector lies in two tenants."""
    rng = np.random.default_rng(14)
    equal, other = rng.standard_normal(64), rng.standard_normal(64)
    x = np.concatenate([scattered(rng, 1200, 0.9), np.tile(equal, (700, 1)), equal + rng.standard_normal((10, 64)) * 0.02, np.tile(other, (40, 1))])
    ids = rng.permutation(len(x))
    tenants = np.where(np.arange(len(x)) % 40 < 39, "hot", "cold")
    again = rng.integers(0, len(x), 300)
    x, ids, tenants = np.concatenate([x, x[again]]), np.concatenate([ids, ids[again]]), np.concatenate([tenants, tenants[again]])
    order = rng.permutation(len(x))
    x, ids, tenants = x[order], ids[order].tolist(), tenants[order].tolist()
    got = [tuple(r)[:2] for r in similar_pairs(frame(spark, ids, tenants, x), part_rows=part_rows).collect()]
    want = brute(ids, tenants, x)
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.998 * len(want)
    assert part_rows == 600 or set(got) == want  # parts shorter than a window lose a few


def test_one_memory_delivered_very_often(spark):
    rng = np.random.default_rng(15)
    x = blobs(rng, [6, 4])
    ids = [0] * 500 + list(range(10))
    x = np.concatenate([np.tile(x[0], (500, 1)), x])
    got = [tuple(r)[:2] for r in similar_pairs(frame(spark, ids, ["t"] * len(x), x)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ids, ["t"] * len(x), x)


def test_usable_reads_slices():
    import pyarrow as pa

    a = pa.array([[1.0] * 64, None, [2.0] * 3, [0.0] * 64, [3.0] * 64], pa.list_(pa.float32()))
    at, v = usable(a.slice(1))
    assert at.tolist() == [3] and v.shape == (1, 64)
    assert F is not None
