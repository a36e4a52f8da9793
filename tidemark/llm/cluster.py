"""Clusters of mutually similar vectors by distributed k-means, with an exact check of what joins.

The components of a vector are weighted features. They are hashed with random
signs into half as many, in which the nearest of many centres is searched; the
similarity to the centre found is then taken over the full vectors, so hashing
decides where to look and never what is similar.

Seeding is parallel and oversampled: in each round every vector not yet similar
to a seed is drawn with a chance in proportion to its squared distance from
the seeds. Seeds that are similar to each other become one centre, weighted by
the vectors they cover, and Lloyd steps over all vectors move the centres.

Two vectors within half the angle of similarity of one centroid are similar,
so such vectors of a cell, its core, are joined without comparing pairs. What
is not certain from centroids is compared: vectors of no core all among each
other, as every two blocks of them meet, and against the cores that the
triangle inequality leaves in reach; cores against cores in reach of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.vectors import WIDTH, components, groups, pack, tables, unpack, usable
from tidemark.session import Scratch

SIMILAR = 0.86
LEAST_MEMBERS = 5
#: Seeds drawn in a round: SEEDS times the root of the rows, at most MOST_SEEDS (16 MB of vectors); rounds; Lloyd steps.
SEEDS, MOST_SEEDS, ROUNDS, STEPS = 4, 65_536, 5, 2
#: Tasks that compare the seeds with each other, at most.
MERGERS = 64
#: Features that the components of a vector are hashed into.
FEATURES = 32
#: Loose vectors in a block, rows of a tile of two blocks, rows of a block at a core, and what single precision may be off by.
LOOSE, TILE, BLOCK, OFF = 32_768, 1_024, 4_096, 4e-6
#: Units are nodes from here up, loose vectors are nodes by their id; ids may not be that low.
UNITS = -(2**63)
_EPS = 1e-6


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = usable(batch.column("embedding"), width)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pack(values)], names=["id", "vec"])

    return run


def hashed_features(width: int, features: int = FEATURES, seed: int = 13) -> np.ndarray:
    """The matrix of a signed feature hash: every component goes to one feature, with a sign."""
    rng = np.random.default_rng(seed)
    out = np.zeros((width, features), dtype=np.float32)
    # every feature gets its share of the components, so that none is crowded
    out[np.arange(width), rng.permutation(width) % features] = rng.choice(np.float32([-1, 1]), width)
    return out


def _top(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to each row by hashed features, and the full similarity to it, in blocks that stay in cache."""
    table = hashed_features(unit.shape[1])
    rows, marks = unit @ table, centres @ table
    marks /= np.maximum(np.linalg.norm(marks, axis=1, keepdims=True), np.float32(1e-12))
    best = np.full(len(unit), -np.inf, dtype=np.float32)
    who = np.zeros(len(unit), dtype=np.int64)
    for c in range(0, len(centres), 2048):
        for a in range(0, len(unit), 512):
            s = rows[a : a + 512] @ marks[c : c + 2048].T
            j = s.argmax(axis=1)
            v = s[np.arange(len(s)), j]
            better = v > best[a : a + 512]
            best[a : a + 512][better] = v[better]
            who[a : a + 512][better] = j[better] + c
    return who, np.einsum("ij,ij->i", unit, centres[who])


def _cover(seeds, first: int, least: float, width: int):
    """Vectors similar to a seed get its number; the others keep their vector and the distance to the nearest seed so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            unit = unpack(table.column("vec"), width)
            who, sim = _top(unit, seeds.value)
            hit = sim >= least + _EPS
            d2 = np.minimum(table.column("d2").to_numpy(), 2 - 2 * sim.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").combine_chunks(),
                    pa.array(np.where(hit, None, table.column("vec").to_numpy(zero_copy_only=False)).tolist(), pa.binary()),
                    pa.array(np.maximum(d2, 0)),
                    pa.array(who + first, mask=~hit),
                ],
                names=["id", "vec", "d2", "seed"],
            )

    return run


def _sums(centres, width: int):
    """Of one task: per cell the number of vectors and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres.value)
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, width))
        for table in tables(batches):
            unit = unpack(table.column("vec"), width)
            who, _ = _top(unit, centres.value)
            n += np.bincount(who, minlength=k)
            order = np.argsort(who, kind="stable")
            cells, at = np.unique(who[order], return_index=True)
            if len(cells):
                total[cells] += np.add.reduceat(unit[order].astype(np.float64), at, axis=0)
        use = np.flatnonzero(n)
        for a in range(0, len(use), BLOCK):
            some = use[a : a + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array([r.tobytes() for r in total[some]], pa.binary())], names=["cell", "n", "total"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the cells of one partition added up."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, k, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n[c] = n.get(c, 0) + k
            v = np.frombuffer(b)
            total[c] = total[c] + v if c in total else v
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        names=["cell", "n", "total"],
    )


def _final(centres, core: float, width: int):
    """Each vector's cell and similarity to its centroid; loose ones keep their vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            unit = unpack(table.column("vec"), width)
            if len(centres.value):
                who, sim = _top(unit, centres.value)
            else:
                who, sim = np.zeros(len(unit), dtype=np.int64), np.full(len(unit), -1, dtype=np.float32)
            inside = sim >= core + _EPS
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").combine_chunks(),
                    pa.array(who, mask=~inside),
                    pa.array(sim.astype(np.float64)),
                    pa.array(np.where(inside, None, table.column("vec").to_numpy(zero_copy_only=False)).tolist(), pa.binary()),
                ],
                names=["id", "unit", "sim", "vec"],
            )

    return run


def _cluster_sums(width: int):
    """Per cluster the number and the sum of its vectors, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            unit = unpack(table.column("vec"), width, np.float64)
            names, code, n = np.unique(table.column("cluster_id").to_numpy(), return_inverse=True, return_counts=True)
            total = np.add.reduceat(unit[np.argsort(code, kind="stable")], np.cumsum(n) - n, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n), pa.array([r.tobytes() for r in total], pa.binary())], names=["cell", "n", "total"])

    return run


def _to_centroid(width: int):
    """Members with the similarity to their cluster's centroid, rounded so that equal ones don't hang on the order of a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            unit = unpack(table.column("vec"), width, np.float64)
            centre = np.frombuffer(b"".join(table.column("total").to_pylist())).reshape(len(unit), width)
            sim = np.einsum("ij,ij->i", unit, centre) / np.maximum(np.linalg.norm(centre, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in ("id", "cluster_id", "size")), pa.array(np.round(sim, 9))], names=["id", "cluster_id", "size", "sim"]
            )

    return run


def _angle(cos):
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _meet_loose(least: float, width: int):
    """Per place: which loose vectors of two blocks, or of one if there is one side only, are similar, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            unit = unpack(table.column("vec"), width, np.float64)
            names, code = np.unique(table.column("node").to_numpy(), return_inverse=True)
            side = table.column("side").to_numpy()
            rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            one = not len(cols)
            cols = rows if one else cols
            left, right = unit[rows].astype(np.float32), unit[cols].astype(np.float32)
            label = np.arange(len(names))
            for a in range(0, len(rows), TILE):
                for b in range(a if one else 0, len(cols), TILE):
                    right_ = right[b : b + TILE]
                    hit = np.flatnonzero((left[a : a + TILE] @ right_.T).ravel() >= least - OFF)
                    i, j = rows[a + hit // len(right_)], cols[b + hit % len(right_)]
                    open_ = label[code[i]] != label[code[j]]
                    i, j = i[open_], j[open_]
                    for c in range(0, len(i), 1 << 16):
                        x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                        alike = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                        label = components(len(names), code[x[alike]], code[y[alike]], label)
            own = np.flatnonzero(label != np.arange(len(names)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[label[own]])], names=["a", "b"])

    return run


def _reach_loose(centres, radius, theta: float, width: int):
    """Loose vectors at every core that may hold a similar one, at most BLOCK rows in a batch; an empty core, of negative radius, holds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.where(radius.value < 0, np.inf, np.cos(np.minimum(radius.value + theta, np.pi)) - 1e-5)
        for table in tables(batches):
            unit = unpack(table.column("vec"), width)
            ids, vecs = table.column("id").combine_chunks(), table.column("vec").combine_chunks()
            for a in range(0, len(unit), TILE):
                for c in range(0, len(centres.value), 4096):
                    s = unit[a : a + TILE] @ centres.value[c : c + 4096].T
                    r, j = np.nonzero(s >= limit[c : c + 4096])
                    for b in range(0, len(r), BLOCK):
                        row, cell = r[b : b + BLOCK], j[b : b + BLOCK]
                        at = pa.array(row + a)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(at), vecs.take(at), pa.array(cell + c), pa.array(_angle(s[row, cell]).astype(np.float64))],
                            names=["node", "vec", "unit", "far"],
                        )

    return run


def _cores(centres, touching, closest, core: float, width: int):
    """Core vectors of units in reach of another, and those that a loose vector in reach leaves open.

    ``closest`` is per unit the least angle to its centroid that a loose vector
    in reach leaves open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            unit = unpack(table.column("vec"), width)
            who, sim = _top(unit, centres.value)
            inside = sim >= core + _EPS
            open_ = inside & (_angle(sim) >= closest.value[who] - 1e-5)
            row = np.flatnonzero(open_ | (inside & touching.value[who]))
            if len(row):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [table.column("id").combine_chunks().take(take), pa.array(who[row]), pa.array(open_[row]), table.column("vec").combine_chunks().take(take)],
                    names=["tie", "unit", "open", "vec"],
                )

    return run


def _within(centres, radius, theta: float, width: int):
    """Of core vectors next to a unit in reach of theirs, those that may be similar to a vector of its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.column("other").to_numpy()
            far = _angle(np.einsum("ij,ij->i", unpack(batch.column("vec"), width), centres.value[other]))
            yield batch.filter(pa.array(far <= radius.value[other] + theta + 1e-5))

    return run


def _in_reach(centres, radius, theta: float):
    """Of the units in blocks of TILE: pairs ``a < b`` whose cores may hold similar vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, rad = centres.value, radius.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                a = block * TILE
                mine = x[a : a + TILE].astype(np.float64)
                for c in range(a, len(x), TILE):
                    angle = _angle(mine @ x[c : c + TILE].T.astype(np.float64))
                    i, j = np.nonzero(angle <= rad[a : a + TILE, None] + rad[None, c : c + TILE] + theta + 1e-5)
                    keep = (i + a < j + c) & (rad[i + a] >= 0) & (rad[j + c] >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(i[keep] + a), pa.array(j[keep] + c)], names=["a", "b"])

    return run


def _compare(least: float, width: int):
    """Per place: which nodes of its two sides hold similar vectors, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            unit = unpack(table.column("vec"), width, np.float64)
            nodes = table.column("node").to_numpy()
            side = table.column("side").to_numpy()
            rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            names, code = np.unique(nodes, return_inverse=True)
            label = np.arange(len(names))
            for a in range(0, len(rows), TILE):
                for b in range(0, len(cols), TILE):
                    i, j = np.nonzero(unit[rows[a : a + TILE]] @ unit[cols[b : b + TILE]].T >= least)
                    x, y = code[rows[i + a]], code[cols[j + b]]
                    open_ = label[x] != label[y]
                    label = components(len(names), x[open_], y[open_], label)
            own = np.flatnonzero(label != np.arange(len(names)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[label[own]])], names=["a", "b"])

    return run


def join_edges(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node, comp``: for every node of ``edges`` (a, b) the least node it is joined to.

    Rounds of hooking every node to the least of its neighbours' labels and
    their labels' labels; each is written, and the number of rounds is about
    the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write("edges", both)
    labels = scratch.write("labels0", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    for i in range(1, most_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hook = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("to"))
        # what a label's own root was told holds for all that carry the label
        roots = hook.groupBy("comp").agg(F.min("to").alias("root"))
        step = hook.join(roots, "comp").select("node", F.least("to", "root").alias("comp"), (F.least("to", "root") < F.col("comp")).alias("moved"))
        new = scratch.write(f"labels{i}", step)
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"labels{i - 1}")
        labels = new.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError("components didn't settle")


class Clusters:
    """The result of :func:`cluster_vectors`: per memory its cluster, and the clusters."""

    def __init__(self, members: DataFrame, clusters: DataFrame, centroids: np.ndarray):
        self.members, self.clusters, self.centroids = members, clusters, centroids


def _seed(vectors: DataFrame, rows: int, scratch: Scratch, least: float, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and how many vectors each covered, after the rounds of oversampling."""
    spark = vectors.sparkSession
    draw = int(min(MOST_SEEDS, max(16, SEEDS * math.sqrt(rows))))
    pool = vectors.withColumn("d2", F.lit(4.0))
    seeds, weights = [], []
    first, left, cost = 0, rows, 4.0 * rows
    for r in range(rounds):
        u = (F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        waits = pool.select("vec", (-F.log(u) / F.greatest("d2", F.lit(1e-12))).alias("wait"))
        if left > 8 * draw:  # about four times as many as are drawn wait less than this, however many tasks there are
            waits = waits.filter(F.col("wait") < 4 * draw / cost)
        drawn = waits.orderBy("wait").limit(draw).select("vec").collect()
        if not drawn:
            break
        now = np.unique(unpack(pa.array([bytes(x[0]) for x in drawn], pa.binary()), width), axis=0)
        sent = spark.sparkContext.broadcast(now)  # at most MOST_SEEDS vectors
        covered = scratch.write(f"round{r}", pool.select("id", "vec", "d2").mapInArrow(_cover(sent, first, least, width), "id bigint, vec binary, d2 double, seed bigint"))
        count = np.zeros(len(now), dtype=np.int64)
        left, cost = 0, 0.0
        for row in covered.groupBy("seed").agg(F.count("*").alias("n"), F.sum("d2").alias("cost")).collect():  # at most one row per seed and one
            if row["seed"] is None:
                left, cost = row["n"], row["cost"]
            else:
                count[row["seed"] - first] = row["n"]
        seeds.append(now)
        weights.append(count)
        if r:
            scratch.drop(f"round{r - 1}")
        pool = covered.filter("seed is null")
        first += len(now)
    if not seeds:
        return np.empty((0, width), dtype=np.float32), np.empty(0, dtype=np.int64)
    return np.concatenate(seeds), np.concatenate(weights)


def _alike(seeds, least: float):
    """Of the seeds' rows that one task has, in blocks of TILE: which are similar to a seed at or after the block, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = seeds.value
        label = np.arange(len(x))
        for batch in batches:
            for block in batch.column(0).to_pylist():
                a = block * TILE
                for c in range(a, len(x), TILE):
                    i, j = np.nonzero(x[a : a + TILE] @ x[c : c + TILE].T >= least)
                    label = components(len(x), i + a, j + c, label)
        own = np.flatnonzero(label != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(label[own])], names=["a", "b"])

    return run


def _centres(spark: SparkSession, seeds: np.ndarray, weights: np.ndarray, least: float, members: int) -> np.ndarray:
    """Similar seeds as one centre each, their weighted mean; those that cover fewer than ``members`` vectors are none.

    Tasks compare the seeds, blocks dealt in turn; at most MERGERS forests of them come back.
    """
    if not len(seeds):
        return seeds
    blocks = -(-len(seeds) // TILE)
    parts = min(MERGERS, blocks)
    sent = spark.sparkContext.broadcast(seeds)  # at most ROUNDS times MOST_SEEDS vectors
    dealt = spark.range(0, blocks, 1, blocks).repartition(parts, F.col("id") % parts)
    found = dealt.mapInArrow(_alike(sent, least), "a bigint, b bigint").toArrow()
    label = components(len(seeds), found.column("a").to_numpy(), found.column("b").to_numpy())
    names, code = np.unique(label, return_inverse=True)
    weight = np.bincount(code, weights=weights, minlength=len(names))
    mean = np.zeros((len(names), seeds.shape[1]))
    np.add.at(mean, code, seeds * np.maximum(weights, 1)[:, None])
    mean = mean[weight >= members]
    return (mean / np.linalg.norm(mean, axis=1, keepdims=True)).astype(np.float32)


def cluster_vectors(
    memories: DataFrame,
    least: float = SIMILAR,
    members: int = LEAST_MEMBERS,
    typical: int = 3,
    width: int = WIDTH,
    rounds: int = ROUNDS,
    steps: int = STEPS,
    scratch: Scratch | None = None,
) -> Clusters:
    """Clusters of at least ``members`` memories joined by similarities of ``least`` or more, directly or over others.

    ``members`` of the result has ``id, cluster_id``, the smallest id of the
    cluster; ``clusters`` has ``cluster_id, size, typical``, the ids nearest to
    the cluster's own centroid, nearest first. Memories without usable embedding, or like
    fewer than ``members`` others, are in none. Re-delivered rows count once.
    No usable embedding at all gives empty results. All rows take part in the
    seeding, in every Lloyd step and in the check.
    """
    spark = memories.sparkSession
    sc = spark.sparkContext
    scratch = scratch or Scratch(spark, "cluster")
    theta = math.acos(least)
    core = math.cos(theta / 2)
    vectors = scratch.write("vectors", memories.filter("id is not null").select("id", "embedding").mapInArrow(_packed(width), "id bigint, vec binary"))
    rows = vectors.count()
    seeds, weights = _seed(vectors, rows, scratch, least, width, rounds)
    centres = _centres(spark, seeds, weights, least, members)
    for _ in range(steps if len(centres) else 0):
        sent = sc.broadcast(centres)
        summed = vectors.mapInArrow(_sums(sent, width), "cell bigint, n bigint, total binary").repartition("cell").mapInArrow(_add, "cell bigint, n bigint, total binary")
        centres = centres.copy()
        for row in summed.collect():  # one row per centre
            v = np.frombuffer(bytes(row["total"]))
            if (norm := np.linalg.norm(v)) > 0:
                centres[row["cell"]] = v / norm
    sent = sc.broadcast(centres)
    final = scratch.write("final", vectors.mapInArrow(_final(sent, core, width), "id bigint, unit bigint, sim double, vec binary"))
    loose = final.filter("unit is null").select("id", "vec")
    radius = np.full(len(centres), -1.0)
    for row in final.filter("unit is not null").groupBy("unit").agg(F.min("sim").alias("low")).collect():  # one row per centre
        radius[row["unit"]] = float(_angle(row["low"]))
    edges = _loose_edges(loose, scratch, least, width)
    edges = edges.union(_core_edges(vectors, loose, sent, radius, scratch, least, theta, core, width))
    comps = join_edges(scratch.write("links", edges), scratch)
    comps = scratch.write("comps", comps)

    single = final.select("id", F.coalesce(F.col("unit") + UNITS, "id").alias("node"), "unit").dropDuplicates(["id"])
    of_units = comps.filter(F.col("node") < UNITS + max(1, len(centres)))  # at most one row per centre
    in_core = single.filter("unit is not null").join(F.broadcast(of_units), "node", "left")
    others = single.filter("unit is null").join(comps, "node", "left")
    labelled = scratch.write("labelled", in_core.union(others.select(in_core.columns)).select("id", F.coalesce("comp", "node").alias("comp")))
    sizes = scratch.write("sizes", labelled.groupBy("comp").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id")).filter(F.col("size") >= members))
    with_unit = F.col("comp") < UNITS + max(1, len(centres))
    named = labelled.filter(with_unit).join(F.broadcast(sizes.filter(with_unit)), "comp")  # at most one row per centre
    named = named.union(labelled.filter(~with_unit).join(sizes.filter(~with_unit), "comp").select(named.columns))
    # each cluster's own centroid, from sums by task; only the clusters' table reads this
    own = named.select("id", "cluster_id", "size").join(vectors.dropDuplicates(["id"]), "id")
    total = "cell bigint, n bigint, total binary"
    summed = own.select("cluster_id", "vec").mapInArrow(_cluster_sums(width), total).repartition("cell").mapInArrow(_add, total)
    near = own.join(summed.select(F.col("cell").alias("cluster_id"), "total"), "cluster_id")
    near = near.mapInArrow(_to_centroid(width), "id bigint, cluster_id bigint, size bigint, sim double")
    # the best of every lane, then of every cluster
    ranked = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, typical)
    lane = F.pmod(F.xxhash64("id"), F.lit(max(1, rows // 10_000)))
    best = F.struct((-F.col("sim")).alias("far"), "id")
    in_lane = near.groupBy("cluster_id", "size", lane.alias("lane")).agg(ranked(best).alias("top"))
    spread = in_lane.select("cluster_id", "size", F.explode("top").alias("x")).groupBy("cluster_id", "size").agg(ranked("x").alias("top"))
    clusters = spread.select("cluster_id", "size", F.transform("top", lambda x: x["id"]).alias("typical"))
    return Clusters(named.select("id", "cluster_id"), clusters, centres)


def _loose_edges(loose: DataFrame, scratch: Scratch, least: float, width: int) -> DataFrame:
    """Forests of the similar loose vectors. Every two blocks of them meet, so each is sent to as many places as there are blocks."""
    n = loose.count()
    if not n:
        return loose.sparkSession.createDataFrame([], "a bigint, b bigint")
    blocks = -(-n // LOOSE)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = loose.select(F.col("id").alias("node"), "vec", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    place = F.concat_ws("/", F.least("own", "other"), F.greatest("own", "other"))
    met = dealt.select(place.alias("place"), "node", (F.col("own") > F.col("other")).cast("int").alias("side"), "vec")
    parts = max(int(loose.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)
    return met.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(_meet_loose(least, width), "a bigint, b bigint")


def _core_edges(vectors: DataFrame, loose: DataFrame, centres, radius: np.ndarray, scratch: Scratch, least: float, theta: float, core: float, width: int) -> DataFrame:
    """Edges of cores with loose vectors and with each other, where the triangle inequality leaves any open."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    none = spark.createDataFrame([], "a bigint, b bigint")
    k = len(centres.value)
    if not k:
        return none
    rad = sc.broadcast(np.where(radius < 0, -np.pi, radius))
    blocks = -(-k // TILE)
    pairs = scratch.write("pairs", spark.range(0, blocks, 1, blocks).mapInArrow(_in_reach(centres, rad, theta), "a bigint, b bigint"))
    touching = np.zeros(k, dtype=bool)
    for row in pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct().collect():  # one row per centre
        touching[row["unit"]] = True
    near = scratch.write("near", loose.mapInArrow(_reach_loose(centres, rad, theta, width), "node bigint, vec binary, unit bigint, far double"))
    closest = np.full(k, np.inf)
    for row in near.groupBy("unit").agg(F.min("far").alias("far")).collect():  # one row per centre
        closest[row["unit"]] = row["far"] - theta
    if not touching.any() and not np.isfinite(closest).any():
        return none
    kept = "tie bigint, unit bigint, open boolean, vec binary"
    cores = scratch.write("cores", vectors.mapInArrow(_cores(centres, sc.broadcast(touching), sc.broadcast(closest), core, width), kept))
    columns = lambda place, side: (place.alias("place"), (F.col("unit") + UNITS).alias("node"), side.alias("side"), "vec", "tie")
    sides = cores.filter("open").select(*columns(F.concat(F.lit("u"), "unit"), F.lit(1)))
    ends = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), F.lit(0).alias("side"), F.concat_ws("-", F.lit("p"), "a", "b").alias("place"))
    ends = ends.union(pairs.select("b", "a", F.lit(1), F.concat_ws("-", F.lit("p"), "a", "b")))
    beside = cores.join(ends, "unit").select("tie", "unit", "vec", "other", "side", "place")  # Spark broadcasts the pairs if they are few
    beside = beside.mapInArrow(_within(centres, rad, theta, width), "tie bigint, unit bigint, vec binary, other bigint, side int, place string")
    sides = sides.union(beside.select(*columns(F.col("place"), F.col("side"))))
    loose_side = near.select(F.concat(F.lit("u"), "unit").alias("place"), "node", F.lit(0).alias("side"), "vec", F.col("node").alias("tie"))
    met = scratch.write("met", sides.unionByName(loose_side))
    # of a place with many rows each side is cut, and every two cuts meet
    cuts = met.groupBy("place").agg(*(F.ceil(F.sum((F.col("side") == s).cast("int")) / BLOCK).alias(f"n{s}") for s in (0, 1))).filter("n0 > 0 and n1 > 0")
    cut = F.pmod(F.xxhash64("tie"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")).cast("int") - 1))
    placed = met.join(cuts, "place").select("place", "node", "side", "vec", cut.cast("int").alias("own"), other.alias("other"))
    key = F.when(F.col("side") == 0, F.concat_ws("/", "place", "own", "other")).otherwise(F.concat_ws("/", "place", "other", "own"))
    return (
        placed.select(key.alias("place"), "node", "side", "vec")
        .repartition("place")
        .sortWithinPartitions("place")
        .mapInArrow(_compare(least, width), "a bigint, b bigint")
    )
