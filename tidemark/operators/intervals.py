"""Continuous periods and gaps of half-open intervals, by dyadic blocks.

Times are whole units on a line of 2**LEVELS units. Every interval is the
disjoint union of at most 2 * LEVELS dyadic blocks ``[i * 2**l, (i + 1) * 2**l)``.
Two blocks are nested or disjoint, so a union is found by dropping blocks that
an ancestor covers, joining sibling pairs to their parent, and coalescing what
touches.

Blocks below ``bucket_level`` lie in one bucket of the line, so an entity is
split over (entity, bucket) and no task ever holds all rows of a heavy entity.
What remains per entity is two edge runs a bucket and the blocks of whole
buckets, which is bounded by the length of the line and not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch

#: 2**39 seconds hold the years 1 to 9999 around the epoch; the end of the line is "open".
LEVELS = 39
ORIGIN = 1 << 38
OPEN = 1 << LEVELS
#: Buckets of 2**22 seconds, about 48 days.
BUCKET_LEVEL = 22
_KEY = LEVELS + 1  # bits a time takes in a key of group and time; groups take the rest


def decompose(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks (group, start, level) of non-empty intervals."""
    gs, ss, ls = [], [], []
    g, s, e = group, start.copy(), end.copy()
    for level in range(LEVELS + 1):
        bit = np.int64(1) << level
        low = (s & bit) != 0
        for at, mask in ((s, low), (e - bit, (e & bit) != 0)):
            use = mask & (s < e)
            if use.any():
                gs.append(g[use])
                ss.append(at[use])
                ls.append(np.full(int(use.sum()), level, dtype=np.int64))
            if at is s:
                s = np.where(use, s + bit, s)
            else:
                e = np.where(use, e - bit, e)
        live = s < e
        if not live.all():
            g, s, e = g[live], s[live], e[live]
        if not len(g):
            break
    if not gs:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(gs), np.concatenate(ss), np.concatenate(ls)


def drop_covered(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks without those equal to or below another block of their group, in order of group and start."""
    order = np.lexsort((-level, start, group))
    group, start, level = group[order], start[order], level[order]
    if not len(group):
        return group, start, level
    base = group << _KEY
    reach = np.maximum.accumulate(base + start + (np.int64(1) << level))
    keep = np.append(True, base[1:] + start[1:] >= reach[:-1])
    return group[keep], start[keep], level[keep]


def join_siblings(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint blocks with every pair of siblings replaced by its parent, from the lowest level up."""
    key = (group << _KEY) + start
    done_k, done_l = [], []
    carried = np.empty(0, dtype=np.int64)
    for lv in range(LEVELS + 1):
        mine = np.sort(np.concatenate([carried, key[level == lv]]))
        size = np.int64(1) << lv
        if len(mine) > 1:
            first = ((mine[:-1] & size) == 0) & (mine[1:] == mine[:-1] + size)
            paired = np.append(first, False) | np.append(False, first)
            carried = mine[np.append(first, False)]
            mine = mine[~paired]
        else:
            carried = mine[:0]
        done_k.append(mine)
        done_l.append(np.full(len(mine), lv, dtype=np.int64))
    k, lv = np.concatenate(done_k), np.concatenate(done_l)
    return k >> _KEY, k & ((np.int64(1) << _KEY) - 1), lv


def coalesce(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (group, start, end) of disjoint blocks."""
    order = np.lexsort((start, group))
    group, start = group[order], start[order]
    end = start + (np.int64(1) << level[order])
    if not len(group):
        return group, start, end
    new = np.append(True, (group[1:] != group[:-1]) | (start[1:] != end[:-1]))
    last = np.append(new[1:], True)
    return group[new], start[new], end[last]


def union_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return coalesce(*join_siblings(*drop_covered(*decompose(group, start, end))))


def _seconds(array: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(pc.cast(array, pa.int64()), missing).to_numpy(zero_copy_only=False)


def _local(bucket_level: int):
    """Batches of (entity, s, e) to runs inside buckets and blocks of whole buckets, unions taken batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ent = batch.column("entity").dictionary_encode()
            g = ent.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            g, s, lv = drop_covered(*decompose(g, _seconds(batch.column("s"), 0), _seconds(batch.column("e"), 0)))
            small = lv < bucket_level
            wide_g, wide_s, wide_l = join_siblings(g[~small], s[~small], lv[~small])
            rg, rs, re = coalesce(*join_siblings(g[small], s[small], lv[small]))
            # a run may cross the edges of buckets: cut it there
            first, last = rs >> bucket_level, (re - 1) >> bucket_level
            n = last - first + 1
            at = np.repeat(np.arange(len(rs)), n)
            b = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            rs, re = np.maximum(rs[at], b << bucket_level), np.minimum(re[at], (b + 1) << bucket_level)
            g = np.concatenate([rg[at], wide_g])
            yield pa.RecordBatch.from_arrays(
                [
                    ent.dictionary.take(pa.array(g)).cast(pa.string()),
                    pa.array(np.concatenate([b, np.full(len(wide_g), -1, dtype=np.int64)])),
                    pa.array(np.concatenate([rs, wide_s])),
                    pa.array(np.concatenate([re, wide_s + (np.int64(1) << wide_l)])),
                ],
                names=["entity", "bucket", "s", "e"],
            )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], flush: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches again as tables that hold whole groups."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < flush:
            continue
        same = np.ones(held.num_rows, dtype=bool)
        for k in keys:
            col = held.column(k).to_numpy()
            same &= col == col[-1]
        cut = int(np.argmax(same))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        col = table.column(k).to_numpy()
        change[1:] |= col[1:] != col[:-1]
    return np.cumsum(change, dtype=np.int64)


def _in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (entity, bucket) to the union in each bucket, with the place of a run in its bucket."""
    for table in _grouped(batches, ["entity", "bucket"]):
        code = _codes(table, ["entity", "bucket"])
        g, s, e = union_runs(code, table.column("s").to_numpy(), table.column("e").to_numpy())
        head = np.searchsorted(code, g)
        fresh = np.append(True, g[1:] != g[:-1])
        nth = np.arange(len(g)) - np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
        left = np.bincount(g, minlength=int(code[-1]) + 1)[g] - nth - 1
        follows = np.append(s[1:], 0)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("entity").take(pa.array(head)).combine_chunks(),
                table.column("bucket").take(pa.array(head)).combine_chunks(),
                pa.array(s),
                pa.array(e),
                pa.array(nth),
                pa.array(left),
                pa.array(np.where(left > 0, follows, -1)),
            ],
            names=["entity", "bucket", "s", "e", "nth", "left_over", "next_s"],
        )


def _across(bucket_level: int):
    """Edge runs and whole-bucket blocks of an entity, sorted by entity, to periods, gaps and the covered buckets.

    ``kind`` is 0 for a period, 1 for a gap, 2 for a bucket (in ``s``) that a wider block covers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["entity"]):
            code = _codes(table, ["entity"])
            bucket, s, e = (table.column(c).to_numpy() for c in ("bucket", "s", "e"))
            nth, rest = table.column("nth").to_numpy(), table.column("left_over").to_numpy()
            wide = bucket < 0
            wg, ws, we = union_runs(code[wide], s[wide], e[wide])
            inner = np.flatnonzero(~wide)
            key = (code[inner] << _KEY) + s[inner]
            at = np.searchsorted((wg << _KEY) + ws, key, side="right") - 1
            covered = np.zeros(len(inner), dtype=bool)
            if len(wg):
                covered = (at >= 0) & (key < (wg[at] << _KEY) + we[at])
            edge = inner[~covered]
            # within: a gap to the next row that its own bucket reports
            g = np.concatenate([wg, code[edge]])
            rs, re = np.concatenate([ws, s[edge]]), np.concatenate([we, e[edge]])
            within = np.concatenate([np.zeros(len(wg), dtype=bool), (nth[edge] == 0) & (rest[edge] > 0)])
            order = np.lexsort((rs, g))
            g, rs, re, within = g[order], rs[order], re[order], within[order]
            new = np.append(True, (g[1:] != g[:-1]) | (rs[1:] != re[:-1])) if len(g) else np.empty(0, dtype=bool)
            last = np.append(new[1:], True) if len(g) else new
            pg, ps, pe, tail = g[new], rs[new], re[last], within[last]
            gap = np.flatnonzero((pg[1:] == pg[:-1]) & ~tail[:-1])
            hidden = inner[covered & (nth[inner] == 0) & (rest[inner] > 0)] if len(inner) else inner
            names = table.column("entity")
            first = np.searchsorted(code, np.arange(int(code[-1]) + 1))
            who = np.concatenate([first[pg], first[pg[gap]], hidden])
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(who)).combine_chunks(),
                    pa.array(np.repeat([0, 1, 2], [len(pg), len(gap), len(hidden)]).astype(np.int32)),
                    pa.array(np.concatenate([ps, pe[gap], bucket[hidden]])),
                    pa.array(np.concatenate([pe, ps[gap + 1], np.zeros(len(hidden), dtype=np.int64)])),
                ],
                names=["entity", "kind", "s", "e"],
            )

    return run


def periods_and_gaps(
    frame: DataFrame,
    entity: Column,
    start: Column,
    end: Column,
    scratch: Scratch | None = None,
    bucket_level: int = BUCKET_LEVEL,
) -> DataFrame:
    """``entity, kind, s, e``: the longest covered stretches (``period``) and what lies between them (``gap``).

    ``start`` and ``end`` are timestamps without zone; ``s`` and ``e`` are
    seconds from the epoch, ``e`` null for a period without end. A null ``end``
    is open. Starts are cut down and ends rounded up to whole seconds. Rows
    with a null entity or start, or an end not after the start, cover nothing.
    Repeated rows change nothing; an empty table gives no rows.
    """
    scratch = scratch or Scratch(frame.sparkSession, "intervals")
    micros = lambda c: F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))
    rows = (
        frame.select(entity.alias("entity"), start.alias("from_"), end.alias("to_"))
        .filter("entity is not null and from_ is not null and (to_ is null or to_ > from_)")
        .select(
            "entity",
            (F.floor(micros(F.col("from_")) / 1_000_000) + ORIGIN).alias("s"),
            F.coalesce(F.ceil(micros(F.col("to_")) / 1_000_000) + ORIGIN, F.lit(OPEN)).alias("e"),
        )
    )
    local = rows.mapInArrow(_local(bucket_level), "entity string, bucket bigint, s bigint, e bigint")
    runs = (
        local.repartition("entity", "bucket")
        .sortWithinPartitions("entity", "bucket")
        .mapInArrow(_in_bucket, "entity string, bucket bigint, s bigint, e bigint, nth bigint, left_over bigint, next_s bigint")
    )
    runs = scratch.write("runs", runs)
    edges = runs.filter("bucket < 0 or nth = 0 or left_over = 0").repartition("entity").sortWithinPartitions("entity")
    solved = scratch.write("solved", edges.mapInArrow(_across(bucket_level), "entity string, kind int, s bigint, e bigint"))
    inside = runs.filter("bucket >= 0 and left_over > 0").join(
        solved.filter("kind = 2").select("entity", F.col("s").alias("bucket")), ["entity", "bucket"], "left_anti"
    )
    open_end = F.when(F.col("e") < OPEN, F.col("e") - ORIGIN)
    kind = F.when(F.col("kind") == 0, "period").otherwise("gap")
    return (
        solved.filter("kind < 2")
        .select("entity", "kind", "s", "e")
        .union(inside.filter("nth > 0").select("entity", F.lit(0), "s", "e"))
        .union(inside.select("entity", F.lit(1), "e", "next_s"))
        .select("entity", kind.alias("kind"), (F.col("s") - ORIGIN).alias("s"), open_end.alias("e"))
    )


def second_text(column: str) -> Column:
    """Seconds from the epoch as ``yyyy-MM-dd HH:mm:ss``."""
    return F.expr(f"cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {column}) as string)")


def price_periods(prices: DataFrame) -> DataFrame:
    """``sku, kind, from_at, to_at`` of the validity of each sku, see :func:`periods_and_gaps`.

    ``sku`` is trimmed and upper-cased, null or blank is none; prices don't
    matter. ``to_at`` is ``open`` for a period without end.
    """
    sku = F.nullif(F.upper(F.regexp_replace("sku", r"(?U)^\s+|\s+$", "")), F.lit(""))
    found = periods_and_gaps(prices, sku, F.col("valid_from"), F.col("valid_to"))
    return found.select(
        F.col("entity").alias("sku"),
        "kind",
        second_text("s").alias("from_at"),
        F.coalesce(second_text("e"), F.lit("open")).alias("to_at"),
    )
