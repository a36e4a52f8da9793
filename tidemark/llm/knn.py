"""The most similar vectors of every vector, by shifted space-filling curves.

A vector is projected at random to a few axes, shifted, and placed on a Hilbert
curve; vectors that lie close in space mostly lie close on the curve, and where
one curve cuts a neighbourhood another, of other axes and shift, doesn't.

All vectors of all tenants, whatever their number, go the same way. Spark
range-partitions them by curve, tenant and key, so a tenant may share a task
with others or be cut into many. A task streams its part of a curve through in
blocks. In a block every vector meets a window of neighbouring keys on each
side, on this curve and on further ones over the block; products in single
precision choose what is ranked again in double. Where a cut between two tasks
runs through a tenant, the rows on both sides of it, a window each, meet once
more. The lists that a vector got from windows and curves are then merged.

Equal vectors of a tenant have one key on every curve and would fill windows.
Of more than a list holds only the least ids are searched; the others share
the list of the last of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import WIDTH, pack, unpack, usable
from tidemark.operators.skew import join_groups, least_of_group
from tidemark.operators.treeagg import tenant_key
from tidemark.session import Scratch

NEIGHBOURS = 5
SIMILAR = 0.86
#: Axes and bits of a curve; curves along which Spark cuts, and orders in a block for each of them, the curve among them.
AXES, BITS, SPLITS, ORDERS = 6, 7, 2, 2
#: Rows of a tile, tiles that a tile meets on each side, rows of a block, and tasks of a curve pass at most (tasks then get longer, not blocks).
TILE, BAND, BLOCK, MOST_TASKS = 1_024, 4, 65_536, 20_000
HALO = TILE * BAND
#: Hits a row of a tile may have before they are cut to its best.
DENSE = 8
#: What single precision may be off by, and the units of a list's distances.
OFF, UNITS = 4e-6, 1_000_000_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, one row each, of ``bits`` bits an axis."""
    x = [c.astype(np.int64) for c in cells.T]
    q = np.int64(1) << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = np.int64(1) << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


class Curves:
    """``n`` Hilbert curves over unit vectors, each with its own axes and shift."""

    def __init__(self, n: int, width: int = WIDTH, axes: int = AXES, bits: int = BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        axes = min(axes, width)
        self.bits = bits
        self.axes = [np.linalg.qr(rng.standard_normal((width, axes)))[0].astype(np.float32) for _ in range(n)]
        self.shift = rng.random((n, axes)).astype(np.float32)
        self.reach = np.float32(4 / np.sqrt(width))  # of a coordinate, in both directions

    def keys(self, unit: np.ndarray, which: int) -> np.ndarray:
        cells = (unit @ self.axes[which] / self.reach + 1 + self.shift[which]) / 3 * (1 << self.bits)
        return hilbert(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def _first(r: np.ndarray, c: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries row, column, value: each row's ``k`` best, equal ones by column; and which of the row's each is."""
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    keep = nth < k
    return r[keep], c[keep], v[keep], nth[keep]


class Lists:
    """The best ``k`` of each of some vectors, in the order of ids, as windows show them."""

    def __init__(self, unit: np.ndarray, k: int, least: float):
        self.unit, self.single, self.k, self.least = unit, unit.astype(np.float32), k, least
        self.who = np.full((len(unit), k), -1)
        self.value = np.full((len(unit), k), -np.inf)
        self.bound = np.full(len(unit), least - OFF, dtype=np.float32)  # a similarity below changes nothing in the row's list

    def along(self, order: np.ndarray, band: int = BAND) -> bool:
        """Every tile of ``order`` meets itself and the ``band`` tiles after it. Tells if every two vectors have met."""
        n = len(order)
        held = self.single[order]
        for a in range(0, n, TILE):
            for b in range(a, min(n, a + (band + 1) * TILE), TILE):
                sims = held[a : a + TILE] @ held[b : b + TILE].T
                if a == b:
                    np.fill_diagonal(sims, -2)
                self._show(sims, order[a : a + TILE], order[b : b + TILE], a == b)
        return n <= (band + 1) * TILE

    def _hits(self, sims: np.ndarray, most: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``sims``, by row, that may change the row's list; where most would, only those about as good as its best ``k``."""
        hit = np.flatnonzero(most >= self.bound[rows])
        if not len(hit):
            return hit, hit
        part, floor = np.ascontiguousarray(sims[hit]), self.bound[rows[hit]]
        at = np.flatnonzero(part >= floor[:, None])
        if len(at) > DENSE * len(hit) and part.shape[1] > self.k:
            best = np.partition(part, -self.k, axis=1)[:, -self.k] - np.float32(2 * OFF)
            at = np.flatnonzero(part >= np.maximum(best, floor)[:, None])
        return hit[at // part.shape[1]], at % part.shape[1]

    def _show(self, sims: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
        """Two tiles' similarities, to the lists of both."""
        i, j = self._hits(sims, sims.max(axis=1), rows)
        r, c = rows[i], cols[j]
        if not same:
            j, i = self._hits(sims.T, sims.max(axis=0), cols)
            r, c = np.append(r, cols[j]), np.append(c, rows[i])
        if not len(r):
            return
        v = np.round(np.einsum("ij,ij->i", self.unit[r], self.unit[c]), 9)  # the same wherever the two meet
        good = v >= np.maximum(self.value[r, -1], self.least)
        r, c, v = r[good], c[good], v[good]
        if not len(r):
            return
        at = np.unique(r)
        old = self.who[at] >= 0
        r, c, v = np.append(r, np.repeat(at, self.k)[old.ravel()]), np.append(c, self.who[at][old]), np.append(v, self.value[at][old])
        once = np.unique(r * len(self.unit) + c, return_index=True)[1]
        r, c, v, nth = _first(r[once], c[once], v[once], self.k)
        self.who[at], self.value[at] = -1, -np.inf
        self.who[r, nth], self.value[r, nth] = c, v
        self.bound[at] = np.maximum(self.value[at, -1], self.least) - OFF

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, nth = np.nonzero(self.who >= 0)
        return r, self.who[r, nth], self.value[r, nth]


def nearest(ids: np.ndarray, unit: np.ndarray, curves: Curves, which: range | list[int], k: int = NEIGHBOURS, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, neighbour, similarity)`` of the ``k`` most similar vectors that windows on the curves ``which`` show.

    ``ids`` are distinct and ascend. Similarities are rounded to nine decimals,
    equal ones go to the smaller id. Curves on which no new window would be
    seen, as one held all vectors, are left out.
    """
    lists = Lists(unit, k, least)
    for w in which:
        if lists.along(np.argsort(curves.keys(lists.single, w), kind="stable")):
            break
    r, c, v = lists.entries()
    return ids[r], ids[c], v


_KEYED = "id bigint, tenant string, vec binary, keys array<bigint>"


def _prepare(width: int, curves: Curves, which: list[int]):
    """Usable vectors, packed, with their keys on some curves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = usable(batch.column("embedding"), width)
            take, vec = pa.array(at), pack(values)
            unit = unpack(vec, width)
            keys = np.stack([curves.keys(unit, w) for w in which], axis=1) if len(at) else np.empty((0, len(which)), dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(which), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tenant").take(take), vec, lists], names=["id", "tenant", "vec", "keys"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], *whole: str) -> Iterator[pa.Table]:
    """Rows sorted by ``whole`` and tenant as blocks of one value of each.

    A block is at most BLOCK rows and, but for a run's first, the HALO rows before.
    """
    held: list[pa.Table] = []
    size, carried, last = 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        tenant = table.column("tenant").combine_chunks().dictionary_encode()
        code = tenant.indices.to_numpy(zero_copy_only=False)
        others = [table.column(c).to_numpy() for c in whole]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in [code, *others]], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]):
            name = (tenant.dictionary[int(code[a])].as_py(), *(int(x[a]) for x in others))
            if held and name != last:
                yield pa.concat_tables(held)
                held, size, carried = [], 0, 0
            last = name
            while a < b:
                if size - carried >= BLOCK:
                    block = pa.concat_tables(held)
                    yield block
                    held, size, carried = [block.slice(size - HALO)], HALO, HALO
                n = min(b - a, BLOCK + carried - size)
                held.append(table.slice(a, n))
                size += n
                a += n
    if held:
        yield pa.concat_tables(held)


_FOUND = "a bigint, b bigint, far int, cut int, curve int, id bigint, tenant string, vec binary"


def _listed(table: pa.Table, curves: Curves, which: list[int], width: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
    if len(ids) < 2:
        return None
    unit = unpack(table.column("vec").combine_chunks().take(pa.array(first)), width, np.float64)
    a, b, v = nearest(ids, unit, curves, which, k, least)
    return a, b, np.rint((1 - v) * UNITS).astype(np.int32)


def _entries(parts: list, names: list[str]) -> pa.RecordBatch:
    a, b, far = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(a, kind="stable")
    got = {"a": pa.array(a[order]), "b": pa.array(b[order]), "far": pa.array(far[order])}
    kinds = {"cut": pa.int32(), "curve": pa.int32(), "id": pa.int64(), "tenant": pa.string(), "vec": pa.binary()}
    return pa.RecordBatch.from_arrays([got[n] if n in got else pa.nulls(len(a), kinds[n]) for n in names], names=names)


def _search(curves: Curves, width: int, k: int, least: float, orders: int):
    """Of one part of the curves, in order: lists of all vectors, and the rows of a window next to a cut that runs through a tenant."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        first, last = True, None

        def edge(table: pa.Table, cut: int) -> pa.RecordBatch:
            n = table.num_rows
            own = {c: table.column(c).combine_chunks() for c in ("curve", "id", "tenant", "vec")}
            own["cut"] = pa.array(np.full(n, cut, dtype=np.int32))
            none = {"a": pa.int64(), "b": pa.int64(), "far": pa.int32()}
            return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, none[c]) for c in names], names=names)

        for table in _runs(batches, "curve"):
            part, curve = table.column("part")[0].as_py(), table.column("curve")[0].as_py()
            if first:
                yield edge(table.slice(0, HALO), part - 1)
                first = False
            last = table, part
            got = _listed(table, curves, [curve * orders + i for i in range(orders)], width, k, least)
            if got is not None:
                out.append(got)
                size += len(got[0])
            if size > 200_000:
                yield _entries(out, names)
                out, size = [], 0
        if size:
            yield _entries(out, names)
        if last is not None:
            table, part = last
            yield edge(table.slice(max(0, table.num_rows - HALO)), part)

    return run


def _seams(curves: Curves, width: int, k: int, least: float, orders: int):
    """Lists of the rows on both sides of a cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "cut", "curve"):
            curve = table.column("curve")[0].as_py()
            got = _listed(table, curves, [curve * orders], width, k, least)
            if got is not None and len(got[0]):
                yield _entries([got], ["a", "b", "far"])

    return run


def similar_pairs(
    memories: DataFrame, k: int = NEIGHBOURS, least: float = SIMILAR, width: int = WIDTH, scratch: Scratch | None = None, splits: int = SPLITS, orders: int = ORDERS, part_rows: int = BLOCK
) -> DataFrame:
    """``id_a, id_b, similarity`` (``id_a < id_b``): of each memory the ``k`` most similar of its tenant, at ``least`` or more.

    Memories without tenant or without usable embedding have no partners.
    Re-delivered rows count once. Every vector is indexed and queried, along
    ``splits`` curves in Spark and ``orders`` in a block for each. A vector
    meets at least HALO neighbours on both sides of each, so tenants of up to
    HALO vectors have exact lists; in larger ones a neighbour that lies
    farther on all curves is lost. ``part_rows`` is about what a task gets.
    """
    spark = memories.sparkSession
    scratch = scratch or Scratch(spark, "knn")
    rows = memories.filter("id is not null").select("id", tenant_key().alias("tenant"), "embedding").filter("tenant is not null")
    total = memories.count()
    curves = Curves(splits * orders, width)
    which = [s * orders for s in range(splits)]
    like = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), "embedding")), 16, "0") for i in range(2)))  # 128 bits tell vectors apart
    plain = rows.filter("embedding is not null").withColumn("like", like)
    equal = scratch.write("equal", plain.groupBy("tenant", "like").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1))
    some = bool(equal.limit(1).count())
    if some:
        few = least_of_group(join_groups(plain, equal, ["tenant", "like"], equal, total), ["tenant", "like"], "id", ["embedding"], k + 1, total)
        firsts = scratch.write("firsts", few.withColumnRenamed("values", "ids"))  # per group the least ids and the vector
        back = firsts.select(F.explode("ids").alias("id"), "tenant", "embedding")
        rows = plain.join(equal.select("tenant", "like"), ["tenant", "like"], "left_anti").select("id", "tenant", "embedding").union(back)
    keyed = rows.mapInArrow(_prepare(width, curves, which), _KEYED)
    parts = max(1, min(spark.sparkContext.defaultParallelism, total * splits // (4 * HALO)), min(MOST_TASKS, total * splits // part_rows))
    placed = keyed.select("id", "tenant", "vec", F.posexplode("keys").alias("curve", "key"))
    ordered = placed.repartitionByRange(parts, "curve", "tenant", "key", "id").sortWithinPartitions("curve", "tenant", "key", "id")
    ordered = ordered.select("id", "tenant", "vec", "curve", F.spark_partition_id().alias("part"))
    found = scratch.write("found", ordered.mapInArrow(_search(curves, width, k, least, orders), _FOUND))
    cuts = found.filter("cut is not null and cut >= 0 and id is not null")
    seams = cuts.select("id", "tenant", "vec", "curve", "cut").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4), "cut")
    seams = seams.sortWithinPartitions("cut", "curve", "tenant").mapInArrow(_seams(curves, width, k, least, orders), "a bigint, b bigint, far int")
    lists = found.filter("a is not null").select("a", "b", "far").union(seams)
    best = lists.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("far", "b"))), 1, k).alias("best"))  # at most k of each window
    if some:
        best = scratch.write("best", best)
        shared = firsts.filter(F.size("ids") > k).join(best.withColumnRenamed("a", "last"), F.element_at("ids", k + 1) == F.col("last")).select("tenant", "like", "ids", "best")
        others = join_groups(plain.drop("embedding"), shared, ["tenant", "like"], equal, total).filter(~F.array_contains("ids", F.col("id")))
        best = best.union(others.select("id", "best").dropDuplicates(["id"]))
    each = best.select("a", F.explode("best").alias("x"))
    pairs = each.select(F.least("a", "x.b").alias("id_a"), F.greatest("a", "x.b").alias("id_b"), "x.far").distinct()
    return pairs.select("id_a", "id_b", F.round(1 - F.col("far") / UNITS, 9).alias("similarity"))
