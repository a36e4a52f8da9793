"""Structures of distributed stores as Spark plans: routing, clocks, replicas and private reads."""

from __future__ import annotations

from collections.abc import Iterator
from secrets import token_hex

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sketches.summaries import hash_bits


def sha(*parts: str | Column) -> Column:
    """SHA-256 in hex over the texts of ``parts``, joined by ``|``; nulls are left out."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)), 256)


# routing
def hrw_route(frame: DataFrame, key: str, nodes: dict[str, float]) -> DataFrame:
    """``frame`` with the ``node`` of highest score for its key (rendezvous); heavier nodes get more keys.

    The node list is part of the expression, so rows stay where they are.
    """
    unit = lambda n: (hash_bits(F.concat_ws("/", F.lit(n), F.col(key).cast("string")), "hrw") + 1) / float((1 << 60) + 1)
    scores = F.array(*(F.struct((F.lit(float(w)) / -F.log(unit(n))).alias("score"), F.lit(n).alias("node")) for n, w in sorted(nodes.items())))
    return frame.withColumn("node", F.array_max(scores)["node"])


def ring(nodes: list[str], points: int) -> tuple[list[str], list[str]]:
    """Positions of a consistent hash ring in order, and their nodes."""
    import hashlib

    at = sorted((hashlib.sha256(f"{n}#{i}".encode()).hexdigest(), n) for n in nodes for i in range(points))
    return [p for p, _ in at], [n for _, n in at]


def ring_route(frame: DataFrame, key: str, nodes: list[str], points: int = 64, copies: int = 1) -> DataFrame:
    """``frame`` with ``nodes``, the first ``copies`` distinct nodes at or after the key's position on the ring.

    What follows each position of the ring is laid out once; a key is one search among them.
    """
    positions, owners = ring(nodes, points)
    want = min(copies, len(nodes))
    after = []
    for i in range(len(owners)):
        after.append(list(dict.fromkeys(owners[i:] + owners[:i]))[:want])
    order = pa.array([*after, after[0]] if after else [[]], pa.list_(pa.string()))  # beyond the last comes the first
    at = np.array(positions)

    @F.pandas_udf("array<string>")
    def place(h):
        import pandas as pd

        start = np.searchsorted(at, h.to_numpy(dtype=str)) if len(at) else np.zeros(len(h), dtype=int)
        return pd.Series(order.take(pa.array(start)).to_pandas())

    return frame.withColumn("nodes", place(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256)))


# rates
def token_bucket(frame: DataFrame, key: str, tick: str, tie: str, capacity: float, per_tick: float) -> DataFrame:
    """``key, tick, tie, allowed`` under a bucket of ``capacity`` tokens that refills ``per_tick``; every row asks for one.

    Rows stream by in order of key and time, with one level held per key, so a
    heavy key takes time but no memory. Null keys form a bucket of their own;
    rows with a null tick are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level, at = object(), 0.0, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None:
                    allowed.append(False)
                    continue
                if k != last:
                    last, level, at = k, capacity, t
                level = min(capacity, level + (t - at) * per_tick)
                at = t
                allowed.append(level >= 1)
                level -= level >= 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=[*batch.schema.names, "allowed"])

    rows = frame.select(key, F.col(tick).cast("bigint").alias(tick), tie)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(key).sortWithinPartitions(key, tick, tie).mapInArrow(run, f"{schema}, allowed boolean")


# clocks and replicas
def vclock_compare(a: Column, b: Column) -> Column:
    """``equal``, ``before``, ``after`` or ``concurrent`` of two maps of counters; a missing counter is 0."""
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    diff = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.signum(zero(x) - zero(y))))
    less, more = F.exists(diff, lambda d: d < 0), F.exists(diff, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def vclock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def lww_merge(frame: DataFrame, key: str, at: str, origin: str, value: str, gone: Column | None = None) -> DataFrame:
    """``key, value, at, origin`` of each key's last write: the latest, then the larger origin, then the larger value.

    Where the last write is a tombstone the key is left out. Merging is
    associative, so replicas may be merged in any order.
    """
    gone = gone if gone is not None else F.lit(False)
    last = frame.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(origin).alias("origin"), F.col(value).alias("value"), gone.alias("gone"))).alias("w"))
    return last.filter("not w.gone").select(key, F.col("w.value").alias(value), F.col("w.at").alias(at), F.col("w.origin").alias(origin))


def _asked(replicas: DataFrame, key: str, read: int) -> DataFrame:
    """The rows of the ``read`` replicas that are asked for each key: the first by hash of key and replica."""
    turn = hash_bits(F.concat_ws("/", F.col(key).cast("string"), F.col("replica").cast("string")), "quorum")
    w = Window.partitionBy(key).orderBy(turn, "replica")  # a key has as many rows as replicas
    return replicas.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= read).drop("_nth")


def quorum_read(replicas: DataFrame, key: str, version: str, read: int) -> DataFrame:
    """Per key the newest row among the ``read`` replicas asked, and ``stale``, how many of them hold an older one.

    ``replicas`` has a column ``replica``; which are asked changes with the key.
    """
    asked = _asked(replicas, key, read)
    rest = [c for c in replicas.columns if c not in (key, "replica")]
    best = asked.groupBy(key).agg(F.max(F.struct(version, *(c for c in rest if c != version))).alias("w"), F.collect_list(version).alias("seen"))
    stale = F.size(F.filter("seen", lambda v: v < F.col(f"w.{version}")))
    return best.select(key, *(F.col(f"w.{c}").alias(c) for c in rest), stale.alias("stale"))


def quorum_repair(replicas: DataFrame, key: str, version: str, read: int) -> DataFrame:
    """What a quorum read writes back: per asked replica that holds an older row, ``replica`` and the newest row asked for."""
    best = quorum_read(replicas, key, version, read).drop("stale")
    old = _asked(replicas, key, read).select(key, "replica", F.col(version).alias("_held"))
    return old.join(best, key).filter(F.col("_held") < F.col(version)).drop("_held")


# replicas compared
#: Rows in a leaf of a comparison tree, about.
LEAF_ROWS = 64


def digits_for(rows: int) -> int:
    """Figures of base 16 that number the leaves of a tree over ``rows`` rows."""
    n = 0
    while 16**n * LEAF_ROWS < rows:
        n += 1
    return n


def merkle_buckets(frame: DataFrame, key: str, columns: list[str], digits: int = 3) -> DataFrame:
    """``level, prefix, digest`` of a tree over key hashes: 16**digits leaves, each parent over its 16 children.

    A leaf's digest is a count and an exclusive or over its rows' hashes, which
    combine before the shuffle and don't depend on the order of rows.
    """
    h = sha(key)
    row = sha(key, *columns)
    parts = [F.bit_xor(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("bigint")).alias(f"x{i}") for i in range(4)]
    leaf = frame.groupBy(F.substring(h, 1, digits).alias("prefix")).agg(F.count("*").alias("n"), *parts)
    level = leaf.select(F.lit(digits).alias("level"), "prefix", sha("n", "x0", "x1", "x2", "x3").alias("digest"))
    out = level
    for d in range(digits - 1, -1, -1):
        kids = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], x["digest"]))
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(F.concat_ws("|", kids), 256).alias("digest"))
        level = level.select(F.lit(d).alias("level"), "prefix", "digest")
        out = out.union(level)
    return out


def merkle_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change``: what must go from ``a`` to ``b`` to make them equal (``added``, ``removed``, ``changed``).

    The tree has as many leaves as keep one at about LEAF_ROWS rows, and only
    the rows of leaves whose digests differ are compared.
    """
    digits = digits_for(max(a.count(), b.count()))
    ta, tb = (merkle_buckets(x, key, columns, digits).filter(F.col("level") == digits).select("prefix", "digest") for x in (a, b))
    differ = ta.join(tb.withColumnRenamed("digest", "other"), "prefix", "full").filter("not digest <=> other").select("prefix")
    pick = lambda x, n: x.select(F.col(key), sha(key, *columns).alias(n), F.substring(sha(key), 1, digits).alias("prefix")).join(differ, "prefix", "left_semi").drop("prefix")
    both = pick(a, "ha").join(pick(b, "hb"), key, "full").filter("not ha <=> hb")
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").otherwise("changed")
    return both.select(key, change.alias("change"))


# private reads
def pir_answer(frame: DataFrame, position: str, value: str, chosen: Column) -> DataFrame:
    """A server's answer to a private read: the exclusive or of the chosen rows' values."""
    return frame.agg(F.coalesce(F.bit_xor(F.when(chosen, F.col(value))), F.lit(0)).alias("answer"))


def pir_read(server_a: DataFrame, server_b: DataFrame, position: str, value: str, wanted: int, seed: str) -> DataFrame:
    """``value`` at ``wanted``, from two servers of which neither learns the position: their sets differ in it alone."""
    base = F.pmod(hash_bits(position, f"pir-{seed}"), F.lit(2)) == 0
    a = pir_answer(server_a, position, value, base).withColumnRenamed("answer", "a")
    b = pir_answer(server_b, position, value, base != (F.col(position) == wanted)).withColumnRenamed("answer", "b")
    return a.join(F.broadcast(b)).select(F.expr("a ^ b").alias(value))  # one row each


#: Shares are numbers modulo this; sums of values must stay below half of it in size.
MODULUS = 1 << 60


def share_values(frame: DataFrame, key: str, value: str, parties: int, secrets: list[str] | None = None) -> DataFrame:
    """``frame`` with columns ``share_0 ...`` that add to ``value`` modulo MODULUS; any of them but one say nothing of it.

    All shares but the last are drawn from a secret of their own, by default a
    fresh one, and the key; keys must not recur. A null value has null shares.
    """
    secrets = secrets or [token_hex(16) for _ in range(parties - 1)]
    random = [F.when(F.col(value).isNotNull(), hash_bits(key, f"share-{s}", 60)) for s in secrets]
    rest = F.pmod(F.col(value).cast("bigint"), F.lit(MODULUS))
    for r in random:
        rest = F.pmod(rest - r, F.lit(MODULUS))
    return frame.withColumns({f"share_{i}": r for i, r in enumerate(random)} | {f"share_{parties - 1}": rest})


def shared_sum(shared: DataFrame, keys: list[str], parties: int) -> DataFrame:
    """``keys, total, n``: each party adds its own shares, and only the sums are put together."""
    each = lambda i: F.pmod(F.sum(F.col(f"share_{i}").cast("decimal(28,0)")), F.lit(MODULUS).cast("decimal(38,0)")).cast("bigint")
    sums = shared.groupBy(*keys).agg(F.count("share_0").alias("n"), *(each(i).alias(f"s{i}") for i in range(parties)))
    total = F.col("s0")
    for i in range(1, parties):
        total = F.pmod(total + F.col(f"s{i}"), F.lit(MODULUS))
    total = F.when(total >= MODULUS // 2, total - MODULUS).otherwise(total)
    return sums.select(*keys, total.alias("total"), "n")


# forgetting
def seal(frame: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """``text`` encrypted under the entity's own key from ``keys`` (``key, secret``); null where there is no key."""
    return frame.join(keys, key, "left").withColumn(text, F.expr(f"aes_encrypt(CAST(`{text}` AS BINARY), secret, 'GCM', 'DEFAULT')")).drop("secret")


def unseal(sealed: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """What can still be read: rows of entities whose key was deleted come out null, for good."""
    return sealed.join(keys, key, "left").withColumn(text, F.expr(f"CAST(aes_decrypt(`{text}`, secret, 'GCM', 'DEFAULT') AS STRING)")).drop("secret")
