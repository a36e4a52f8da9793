"""Answers that prove themselves: Merkle trees, ranges and neighbours with proofs, chained ledgers, challenges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.distributed import sha
from tidemark.operators.ordering import dense_positions
from tidemark.operators.skew import join_groups
from tidemark.session import Scratch
from tidemark.sketches.summaries import hash_bits

#: Levels of a tree that one task folds, and entries of a chain's segment.
LEVELS, SEGMENT = 14, 4_096


def content(*columns: str) -> Column:
    """SHA-256 in hex of ``columns`` with their names; no two different contents are written alike, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _pair(a: str, b: str) -> str:
    return hashlib.sha256(f"{a}|{b}".encode()).hexdigest()


# Merkle trees
def level_sizes(n: int) -> list[int]:
    """Nodes of each level over ``n`` leaves, up to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def _fold(first: int, sizes: list[int], fringe: dict[tuple[int, int], str]):
    """Of one block of nodes of level ``first``, in order: the levels above, up to LEVELS of them.

    A node at the block's edge whose sibling isn't there takes it from
    ``fringe``; the last node of an odd level is paired with itself.
    """

    def levels(at: int, nodes: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        for level in range(first, min(first + LEVELS, len(sizes) - 1)):
            if at & 1:
                at -= 1
                nodes = [fringe.get((level, at), ""), *nodes]
            if len(nodes) & 1:
                last = at + len(nodes)
                nodes = [*nodes, nodes[-1] if last >= sizes[level] else fringe.get((level, last), "")]
            at, nodes = at >> 1, [_pair(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
            yield level + 1, at, nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, begin, nodes = None, 0, []

        def emit() -> Iterator[pa.RecordBatch]:
            for level, at, got in levels(begin, nodes):
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(got), pa.int32()), pa.array(range(at, at + len(got)), pa.int64()), pa.array(got)], names=["level", "position", "hash"])

        for batch in batches:
            for at, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != at >> LEVELS:
                    if nodes:
                        yield from emit()
                    block, begin, nodes = at >> LEVELS, at, []
                nodes.append(h)
        if nodes:
            yield from emit()

    return run


def _rise(leaves: DataFrame, n: int, fringe: dict[tuple[int, int], str], scratch: Scratch) -> list[DataFrame]:
    """The levels above ``leaves`` (``position, hash``), LEVELS of them a round, each round written."""
    sizes = level_sizes(n)
    out, level = [], leaves
    for first in range(0, len(sizes) - 1, LEVELS):
        dealt = level.select("position", "hash").repartition(F.shiftright("position", LEVELS)).sortWithinPartitions("position")
        made = scratch.write(f"above{first}", dealt.mapInArrow(_fold(first, sizes, fringe), "level int, position bigint, hash string"))
        out.append(made)
        level = made.filter(F.col("level") == min(first + LEVELS, len(sizes) - 1))
    return out


def merkle_tree(frame: DataFrame, order: list[str], leaf: Column, scratch: Scratch | None = None) -> DataFrame:
    """``level, position, hash`` of a binary Merkle tree over the rows in ``order``, with ``leaf`` as a row's hash.

    The last node of an odd level is paired with itself. A round folds LEVELS
    levels, so a billion rows take three. No rows give no nodes.
    """
    scratch = scratch or Scratch(frame.sparkSession, "merkle")
    leaves = dense_positions(frame.select(*order, leaf.alias("hash")), order, "position", scratch)
    tree = scratch.write("leaves", leaves.select(F.lit(0).alias("level"), "position", "hash"))
    for made in _rise(tree, tree.count(), {}, scratch):
        tree = tree.union(made)
    return tree


def tree_root(tree: DataFrame) -> tuple[str | None, int]:
    """The root of a tree bound to the number of its leaves, and that number. No leaves have no root."""
    n = tree.filter("level = 0").count()
    if not n:
        return None, 0
    top = tree.filter(F.col("level") == len(level_sizes(n)) - 1).first()["hash"]
    return _pair(str(n), top), n


def siblings(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """``position, proof`` of each ``position`` asked for: levels and hashes of the siblings from leaf to root, by one join."""
    top = tree.agg(F.max("level")).first()[0] or 0
    steps = asked.select("position", F.explode(F.sequence(F.lit(0), F.lit(top - 1)) if top else F.array().cast("array<int>")).alias("level"))
    # the node's own place, and its sibling's
    want = steps.withColumn("at", F.expr("shiftright(position, level) ^ 1"))
    got = want.join(tree.select("level", F.col("position").alias("at"), "hash"), ["level", "at"], "left")
    proofs = got.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("level", "hash"))).alias("proof"))  # a row a level
    return asked.select("position").join(proofs, "position", "left").withColumn("proof", F.coalesce("proof", F.array().cast("array<struct<level:int,hash:string>>")))


def proved_root(leaf: Column, position: Column, proof: Column, n: int) -> Column:
    """The root that a leaf, its position and its proof lead to; a missing sibling is the node itself, as at an odd level's end."""
    ends = F.array(*(F.lit(s) for s in level_sizes(n)))

    def step(h: Column, x: Column) -> Column:
        at = F.call_function("shiftright", position, x["level"])
        alone = (at.bitwiseXOR(F.lit(1).cast("bigint"))) >= F.get(ends, x["level"])
        other = F.when(alone, h).otherwise(F.coalesce(x["hash"], F.lit("")))
        even = at.bitwiseAND(F.lit(1).cast("bigint")) == 0
        return F.sha2(F.when(even, F.concat(h, F.lit("|"), other)).otherwise(F.concat(other, F.lit("|"), h)), 256)

    return F.sha2(F.concat(F.lit(f"{n}|"), F.aggregate(proof, leaf, step)), 256)


def merkle_proofs(tree: DataFrame, positions: list[int]) -> dict[int, list[str | None]]:
    """Per leaf of a stated list the siblings from it to the root; None where an odd level ends."""
    asked = tree.sparkSession.createDataFrame([(p,) for p in positions], "position bigint")
    return {r["position"]: [x["hash"] for x in r["proof"]] for r in siblings(tree, asked).collect()}


def verify_proof(leaf: str, position: int, proof: list[str | None], root: str | None, n: int) -> bool:
    """Whether ``leaf`` is at ``position`` of the tree of ``n`` leaves with this ``root``."""
    sizes = level_sizes(n)
    if not 0 <= position < n or len(proof) != len(sizes) - 1:
        return False
    h = leaf
    for k, sibling in enumerate(proof):
        at = position >> k
        other = h if at ^ 1 >= sizes[k] else sibling or ""
        h = _pair(h, other) if not at & 1 else _pair(other, h)
    return _pair(str(n), h) == root


# ranges
def range_tree(frame: DataFrame, number: str, columns: list[str], scratch: Scratch | None = None) -> dict:
    """What an owner publishes of a table (``root``) and what a server keeps of it (``rows``, ``tree``, ``n``).

    Rows are ordered by ``number`` and ``columns``, and all of these are in a
    row's leaf. Rows with a null ``number`` are in no range and left out.
    """
    spark = frame.sparkSession
    scratch = scratch or Scratch(spark, "range")
    every = list(dict.fromkeys([number, *columns]))
    rows = dense_positions(frame.filter(F.col(number).isNotNull()).select(*every), every, "position", scratch)
    rows = scratch.write("rows", rows)
    tree = merkle_tree(rows.select("position", *every), ["position"], content(*every), Scratch(spark, "range-tree"))
    root, n = tree_root(tree)
    return {"rows": rows, "tree": tree, "root": root, "n": n, "columns": every, "number": number}


def authenticated_range(table: dict, low, high) -> dict:
    """A server's answer: the rows from ``low`` to ``high``, the row before and the row after, and the hashes beside them.

    The hashes are two a level at most, however many rows the range has.
    """
    rows, number, n = table["rows"], F.col(table["number"]), table["n"]
    got = rows.agg(F.sum((number < low).cast("bigint")).alias("below"), F.sum((number <= high).cast("bigint")).alias("upto")).first()
    first, last = max(0, (got["below"] or 0) - 1), min(n - 1, got["upto"] or 0)
    shown = rows.filter(F.col("position").between(first, last))
    want, a, b = set(), first, last
    for level, size in enumerate(level_sizes(n)[:-1]):
        if a & 1:
            want.add((level, a - 1))
        if not b & 1 and b + 1 < size:
            want.add((level, b + 1))
        a, b = a >> 1, b >> 1
    fringe = {}
    if want:
        ask = rows.sparkSession.createDataFrame(sorted(want), "level int, position bigint")
        fringe = {(r["level"], r["position"]): r["hash"] for r in table["tree"].join(F.broadcast(ask), ["level", "position"]).collect()}
    return {"rows": shown, "fringe": fringe, "n": n, "columns": table["columns"], "number": table["number"]}


def in_range(answer: dict, low, high) -> DataFrame:
    """The rows of an answer without those shown beside the range."""
    return answer["rows"].filter(F.col(answer["number"]).between(low, high)).drop("position")


def verify_range(answer: dict, root: str | None, low, high, scratch: Scratch | None = None) -> bool:
    """Whether an answer is sound and complete for the table with this published ``root``.

    The rows shown must fill their positions without a hole, must reach beyond
    the range or the table's end on both sides, and must fold to the root.
    Nothing is taken on the server's word; the tree isn't read.
    """
    rows, number, n = answer["rows"], F.col(answer["number"]), answer["n"]
    if not n:
        return root is None and rows.limit(1).count() == 0
    seen = rows.agg(
        F.count("*").alias("rows"), F.countDistinct("position").alias("places"), F.min("position").alias("a"), F.max("position").alias("b"),
        F.sum(((number >= low) & (number <= high)).cast("bigint")).alias("inside"),
        F.min(F.when((number >= low) & (number <= high), F.col("position"))).alias("first"), F.max(F.when((number >= low) & (number <= high), F.col("position"))).alias("last"),
        F.min(number).alias("least"), F.max(number).alias("most"), F.sum(number.isNull().cast("int")).alias("nulls"),
    ).first()
    if not seen["rows"] or seen["nulls"] or seen["rows"] != seen["places"] or seen["b"] - seen["a"] + 1 != seen["rows"]:
        return False
    if not (seen["a"] == 0 or seen["least"] < low) or not (seen["b"] == n - 1 or seen["most"] > high):
        return False
    scratch = scratch or Scratch(rows.sparkSession, "verify")
    leaves = rows.select("position", content(*answer["columns"]).alias("hash"))
    top = leaves
    for made in _rise(leaves, n, answer["fringe"], scratch):
        top = made
    depth = len(level_sizes(n)) - 1
    found = (top.filter(F.col("level") == depth) if depth else top).select("hash").collect()  # one row
    return len(found) == 1 and _pair(str(n), found[0]["hash"]) == root


# neighbours
def vector_leaf(key, vector: list[float]) -> str:
    """The Merkle leaf of a keyed vector, as :func:`authenticated_knn` makes it: the key and the bits of the components."""
    bits = np.asarray(vector, dtype=">f4").tobytes().hex().upper()
    return hashlib.sha256(f"{key}|{bits}".encode()).hexdigest()


def authenticated_knn(frame: DataFrame, key: str, column: str, query: list[float], k: int, metric: str = "<->", scratch: Scratch | None = None) -> dict:
    """The ``k`` nearest rows, each with its position and proof, and the ``root`` they are proved against.

    The proofs are of what is shown; that nothing nearer was left out is the
    server's word, as a proof of that would be as long as the table.
    """
    from tidemark.operators import ann

    scratch = scratch or Scratch(frame.sparkSession, "auth-knn")

    @F.pandas_udf("string")
    def bits(v):
        import pandas as pd

        return pd.Series([np.asarray(x, dtype=">f4").tobytes().hex().upper() for x in v])

    rows = dense_positions(frame.select(key, column).filter(F.col(column).isNotNull()), [key], "position", scratch)
    rows = scratch.write("rows", rows.withColumn("bits", bits(column)))
    tree = merkle_tree(rows, ["position"], sha(key, "bits"), Scratch(frame.sparkSession, "auth-knn-tree"))
    found = ann.knn(rows.select(key, column, "position"), column, query, k, metric, key).collect()
    root, n = tree_root(tree)
    proofs = merkle_proofs(tree, [r["position"] for r in found])
    return {"root": root, "n": n, "rows": [{"key": r[key], "vector": list(r[column]), "distance": r["distance"], "position": r["position"], "proof": proofs[r["position"]]} for r in found]}


def verify_knn(answer: dict, root: str | None, query: list[float], metric: str = "<->") -> bool:
    """Whether every row is proved by ``root`` and the distances are right and in order."""
    from tidemark.operators import ann

    rows = answer["rows"]
    if not all(verify_proof(vector_leaf(r["key"], r["vector"]), r["position"], r["proof"], root, answer["n"]) for r in rows):
        return False
    if not rows:
        return True
    real = ann.block_distances(np.asarray([query], dtype=np.float32).astype(float), np.asarray([r["vector"] for r in rows], dtype=np.float32).astype(float), metric)[0]
    return bool(np.allclose(real, [r["distance"] for r in rows], atol=1e-6) and (np.diff(real) >= -1e-9).all())


# ledgers
def _chained(first: str, head_only: bool):
    """Sorted entries of segments: each entry's ``prev_hash`` and ``hash``, or the segment's last hash only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h, heads = None, "", []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: i for i, n in enumerate(batch.schema.names)}
            chain, segment, own = (batch.column(at[c]).to_pylist() for c in ("_chain", "_segment", "_own"))
            start = batch.column(at["_start"]).to_pylist() if "_start" in at else [first] * len(own)
            before, after = [], []
            for c, s, o, x in zip(chain, segment, own, start):
                if (c, s) != last:
                    if last is not None and head_only:
                        heads.append((*last, h))
                    last, h = (c, s), x
                before.append(h)
                h = _pair(h, o)
                after.append(h)
            if not head_only:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(after)], names=[*batch.schema.names, "prev_hash", "hash"])
        if head_only:
            if last is not None:
                heads.append((*last, h))
            c, s, x = zip(*heads) if heads else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(s, pa.int64()), pa.array(x, pa.string())], names=["_chain", "_segment", "_head"])

    return run


def ledger_chain(frame: DataFrame, chain: str, seq: str, columns: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``frame`` with ``prev_hash`` and ``hash``; an entry's hash covers its contents and all entries of its chain before it.

    A chain is cut into segments of SEGMENT entries. Segments are folded on
    their own; what a segment begins with is folded from the segments before,
    one step for each, and the entries are folded again from there. So a chain
    with most of the entries is spread over tasks, and only its segments, one
    in SEGMENT entries, are folded in a row. ``seq`` tells a chain's entries
    apart; null chains are one chain.
    """
    spark = frame.sparkSession
    scratch = scratch or Scratch(spark, "ledger")
    frame = frame.drop("prev_hash", "hash")
    own = frame.withColumn("_own", content(*dict.fromkeys([chain, seq, *columns]))).withColumn("_chain", F.coalesce(F.to_json(F.struct(chain)), F.lit("{}")))
    placed = scratch.write("placed", dense_positions(own, ["_chain", seq, "_own"], "_at", scratch))
    firsts = placed.groupBy("_chain").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    firsts = scratch.write("firsts", firsts)
    total = placed.count()
    entries = join_groups(placed, firsts.drop("n"), ["_chain"], firsts, total).withColumn("_segment", F.floor((F.col("_at") - F.col("_first")) / SEGMENT)).drop("_first")
    entries = scratch.write("entries", entries)
    fold = lambda x, keys, run, schema: x.repartition(*keys).sortWithinPartitions("_chain", "_segment", "_at").mapInArrow(run, schema)
    digests = scratch.write("digests", fold(entries.select("_chain", "_segment", "_at", "_own"), ["_chain", "_segment"], _chained("segment", True), "_chain string, _segment bigint, _head string"))
    # a row per segment: what it begins with commits to all segments before
    heads = digests.select("_chain", F.lit(0).cast("bigint").alias("_segment"), F.col("_segment").alias("_at"), F.col("_head").alias("_own"))
    starts = fold(heads, ["_chain"], _chained("genesis", False), "_chain string, _segment bigint, _at bigint, _own string, prev_hash string, hash string")
    starts = scratch.write("starts", starts.select("_chain", F.col("_at").alias("_segment"), F.col("prev_hash").alias("_start")))
    names = entries.columns
    linked = entries.join(starts, ["_chain", "_segment"]).select(*names, "_start")  # a segment is SEGMENT rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.schema)
    sealed = fold(linked, ["_chain", "_segment"], _chained("", False), f"{schema}, prev_hash string, hash string")
    return sealed.select(*frame.columns, "prev_hash", "hash")


def ledger_heads(sealed: DataFrame, chain: str, seq: str) -> DataFrame:
    """``chain, head, entries``: what an owner pins; the head is the hash of a chain's last entry and covers all of them."""
    return sealed.groupBy(chain).agg(F.max_by("hash", F.struct(seq, "hash")).alias("head"), F.count("*").alias("entries"))


def ledger_audit(frame: DataFrame, chain: str, seq: str, columns: list[str], heads: DataFrame | None = None) -> DataFrame:
    """``chain, entries, broken, head_ok`` of stored entries, hashed anew from their contents.

    ``broken`` are the entries whose stored hashes don't follow from the
    contents up to them: all from the first that was altered, put in or taken
    out. Whoever altered an entry and sealed all after it anew shows none;
    ``head_ok`` then tells, as it holds only if the chain leads to its head in
    ``heads`` (:func:`ledger_heads`). Chains without a pinned head, and pinned
    chains of which nothing is left, aren't ok; without ``heads`` it is null.
    """
    stored = frame.withColumn("_prev", F.col("prev_hash")).withColumn("_hash", F.col("hash"))
    again = ledger_chain(stored, chain, seq, columns)
    good = F.coalesce((F.col("_prev") == F.col("prev_hash")) & (F.col("_hash") == F.col("hash")), F.lit(False))
    out = again.groupBy(chain).agg(F.count("*").alias("entries"), F.sum((~good).cast("bigint")).alias("broken"), F.max_by("hash", F.struct(seq, "hash")).alias("_head"))
    if heads is None:
        return out.select(chain, "entries", "broken", F.lit(None).cast("boolean").alias("head_ok"))
    pinned = heads.select(F.col(chain).alias("_pinned"), F.col("head"))
    out = out.join(pinned, F.col(chain).eqNullSafe(F.col("_pinned")), "full")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.coalesce(chain, "_pinned").alias(chain), F.coalesce("entries", zero).alias("entries"), F.coalesce("broken", zero).alias("broken"),
        F.coalesce(F.col("_head") == F.col("head"), F.lit(False)).alias("head_ok"),
    )


# challenges
def stored_tree(frame: DataFrame, key: str, columns: list[str], scratch: Scratch | None = None) -> dict:
    """What an owner keeps of rows given away: ``root``, ``n`` and the position of each ``key``; and the ``tree`` that goes along."""
    spark = frame.sparkSession
    scratch = scratch or Scratch(spark, "stored")
    every = list(dict.fromkeys([key, *columns]))
    rows = scratch.write("rows", dense_positions(frame.select(*every), every, "position", scratch))
    tree = merkle_tree(rows, ["position"], content(*every), Scratch(spark, "stored-tree"))
    root, n = tree_root(tree)
    return {"places": rows.select(key, "position"), "tree": tree, "root": root, "n": n, "columns": every}


def retrievability(stored: DataFrame, kept: dict, key: str, one_in: int, seed: str = "challenge") -> DataFrame:
    """``asked, held``: a challenge to about one in ``one_in`` keys; an answer is a row whose proof leads to the owner's root."""
    asked = kept["places"].filter(F.pmod(hash_bits(key, seed), F.lit(one_in)) == 0)
    answers = asked.join(stored.select(*kept["columns"], F.lit(True).alias("_there")), key, "left").join(siblings(kept["tree"], asked), "position", "left")
    leaf = F.when(F.col("_there"), content(*kept["columns"]))
    got = proved_root(leaf, F.col("position"), F.col("proof"), kept["n"])
    return answers.agg(F.count("*").alias("asked"), F.coalesce(F.sum((got == kept["root"]).cast("bigint")), F.lit(0)).alias("held"))


def detection_chance(lost: float, asked: int) -> float:
    """The chance that a challenge to ``asked`` rows meets one of a share ``lost``."""
    return 1 - (1 - lost) ** asked
