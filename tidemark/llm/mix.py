"""A mix of sources in which each gives its target share of all tokens.

Token sizes are summed per cell of source, language and topic. Iterative
proportional fitting rakes the cells to the target of each source and to the
shares of languages and topics, with no cell repeated more often than its
source allows. A document's weight is that of its cell: the whole part is how
often it surely occurs, the fraction is its chance of one more. The chances of
a source are then calibrated on its own documents, so that the sizes drawn meet
the target and not only their mean does; the last few documents are those that
fill what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.encode import VOCABULARIES, VOCABULARY, spread, token_counts
from tidemark.session import Scratch

#: Bins of a source's documents by chance, rounds in which the bin at the mark is cut again, and documents that may fill what is left.
BINS, CUTS, FILLS = 4_096, 3, 16
#: Passes over the turns; in all but the first only documents that fit what is left count.
PASSES = 3
#: A source is filled up to this part of its target; and meets it within CLOSE.
ENOUGH, CLOSE = 0.001, 0.01
#: What a file is for, by the first folder of its path that says so.
TOPICS = {
    "tests": "test tests spec",
    "vendored": "vendor vendored third_party extern external",
    "generated": "gen generated build dist out static assets target",
    "documentation": "doc docs documentation examples",
    "tools": "tool tools script scripts bin",
    "library": "lib libs pkg packages",
    "application": "src app cmd",
}


_SPANS = "spans array<struct<low:double,high:double,most:double>>"


def _taken() -> Column:
    """Whether a document's turn lies in a span of its source that takes documents of its size."""
    return F.coalesce(F.expr("exists(spans, x -> turn >= x.low and turn < x.high and tokens <= x.most)"), F.lit(False))


def rake(size: np.ndarray, cap: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Weights per cell, at most ``cap``, that fit ``size * weight`` to the marginal ``targets`` of each axis.

    ``axes`` hold, for each axis, every cell's place on it, so only cells that
    occur are kept. The first axis is fitted last, so that its targets are met
    wherever the caps allow; the others are met as nearly as that leaves them.
    """
    weight = np.where(size > 0, np.minimum(1.0, cap), 0.0)
    for _ in range(rounds):
        before = weight
        for a in [*range(1, len(axes)), 0]:
            for _ in range(20 if a == 0 else 1):  # what hits its cap leaves its share to the others
                now = np.bincount(axes[a], weights=size * weight, minlength=len(targets[a]))
                factor = np.divide(targets[a], now, out=np.ones_like(now), where=now > 0)
                if np.abs(factor - 1).max(initial=0.0) < 1e-12:
                    break
                weight = np.minimum(weight * factor[axes[a]], cap)
        if np.abs(weight - before).max(initial=0.0) < tolerance:
            break
    return weight


def topic(path: str = "path") -> Column:
    """What a file is for: one of TOPICS, ``licence``, or ``other``, by its folders from the first on."""
    folder = {f: t for t, names in TOPICS.items() for f in names.split()}
    known = F.create_map(*(F.lit(x) for pair in folder.items() for x in pair))
    low = F.lower(F.coalesce(F.col(path), F.lit("")))
    told = F.filter(F.transform(F.split(low, "/"), lambda f: F.element_at(known, f)), lambda t: t.isNotNull())
    licence = F.element_at(F.split(low, "/"), -1).rlike(r"^(licen[cs]e|copying|notice)\b")
    return F.when(licence, "licence").otherwise(F.coalesce(F.get(told, 0), F.lit("other")))


def _prepared(documents: DataFrame, targets: DataFrame, vocabulary: str, folder: str, scratch: Scratch) -> DataFrame:
    """``doc_id, source, language, topic, tokens`` of the documents of listed sources."""
    listed = F.broadcast(targets.select("source").filter("source is not null").distinct())  # the catalogue of sources
    language = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("(none)"))
    rows = spread(documents.select("doc_id", "source", "lang", "path", "text")).join(listed, "source", "left_semi")
    columns = [F.col("doc_id"), F.col("source"), language.alias("language"), topic().alias("topic")]
    return scratch.write("sized", token_counts(rows, columns, "text", vocabulary, folder))


def mix_documents(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    language_shares: dict[str, float] | None = None,
    topic_shares: dict[str, float] | None = None,
    vocabulary: str = VOCABULARY,
    folder: str = VOCABULARIES,
    seed: int = 17,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix ``doc_id, source, language, topic, tokens, copies`` and its report, one row per listed source.

    ``total_tokens`` is the size aimed at; by default the largest at which
    every source that has tokens can meet its target. Languages and topics
    (what a file is for, by its folders) are raked to the given shares, by
    default to those of the listed documents; all languages that occur are
    kept apart. No document occurs more than ``max_repeats`` times (null or
    less than one: once at most, or not at all for 0). Documents of sources
    that aren't listed, or without tokens, take no part. The report has
    ``source, target_share, actual_share, target_tokens, actual_tokens,
    deviation, available_tokens, most_tokens, documents, copies, most_copies,
    reachable, met``: ``deviation`` is the part of the target by which the
    source misses it, ``reachable`` tells if its caps allow the target, and
    ``met`` if the mix has it within CLOSE. Empty inputs give an empty mix and
    a report of zeros.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    plan = {
        r["source"]: (float(r["share"] or 0), int(1 if r["most"] is None else max(0, r["most"])))
        for r in targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).collect()
    }
    sources = sorted(plan)
    sized = _prepared(documents, targets, vocabulary, folder, scratch)
    cells = sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("n")).filter("n > 0").collect()  # listed sources x languages x topics
    names = [sources, sorted({r["language"] for r in cells}), sorted({r["topic"] for r in cells})]
    axes = [np.array([n.index(r[c]) for r in cells], dtype=np.int64) for n, c in zip(names, ("source", "language", "topic"))]
    size = np.array([r["n"] for r in cells], dtype=float)
    share = np.array([plan[s][0] for s in sources])
    most = np.array([plan[s][1] for s in sources], dtype=float)
    available = np.bincount(axes[0], weights=size, minlength=len(sources)) if len(cells) else np.zeros(len(sources))
    reach = available * most
    live = (reach > 0) & (share > 0)
    total = float(total_tokens) if total_tokens is not None else float((reach[live] / share[live]).min()) if live.any() else 0.0
    aim = np.minimum(share * total, reach)
    wanted = [share * total]
    for axis, given in ((1, language_shares), (2, topic_shares)):
        own = np.bincount(axes[axis], weights=size, minlength=len(names[axis])) if len(cells) else np.zeros(0)
        shares = own / own.sum() if own.sum() else own
        if given is not None:
            shares = np.array([given.get(n, 0.0) for n in names[axis]])
        wanted.append(shares * aim.sum())
    weight = rake(size, most[axes[0]] if len(cells) else size, axes, wanted) if len(cells) else size
    sure = np.floor(weight + 1e-9)
    rows = [(r["source"], r["language"], r["topic"], float(s), float(max(0.0, w - s))) for r, s, w in zip(cells, sure, weight)]
    table = spark.createDataFrame(rows, "source string, language string, topic string, sure double, chance double")  # a row a cell
    caps = spark.createDataFrame([(s, plan[s][1]) for s in sources], "source string, most int")
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    placed = sized.filter("tokens > 0").join(F.broadcast(table), ["source", "language", "topic"]).join(F.broadcast(caps), "source")
    # in the mix once more if below the source's mark
    placed = scratch.write("placed", placed.withColumn("turn", F.when((F.col("chance") > 0) & (F.col("sure") < F.col("most")), draw / F.col("chance"))))
    need = {s: float(n) for s, n in zip(sources, aim)}
    for r in placed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("sure")).alias("n")).collect():
        need[r["source"]] -= r["n"]
    enough = {s: ENOUGH * n for s, n in zip(sources, aim.tolist())}
    spans: dict[str, list[tuple[float, float, float]]] = {s: [] for s in sources}
    taken: dict[str, list[int]] = {s: [] for s in sources}
    for p in range(PASSES):
        todo = {s: n for s, n in need.items() if n >= max(1.0, enough[s])}
        if todo:
            limit = {s: n if p else float("inf") for s, n in todo.items()}
            for s, (low, high, left) in _marks(spark, placed, todo, {s: spans[s][-1][1] if spans[s] else 0.0 for s in todo}, limit, taken).items():
                spans[s].append((low, high, limit[s]))
                need[s] = left
            _fill(spark, placed, spans, need, enough, taken)
    more = [d for ids in taken.values() for d in ids]
    marks = F.broadcast(spark.createDataFrame(list(spans.items()), f"source string, {_SPANS}"))
    extra = F.broadcast(spark.createDataFrame([(d, 1) for d in more], "doc_id bigint, more int"))  # at most PASSES x FILLS a source
    once = F.when(_taken(), 1).otherwise(F.coalesce("more", F.lit(0)))
    mixed = placed.join(marks, "source").join(extra, "doc_id", "left").withColumn("copies", F.least(F.col("sure") + once, F.col("most")).cast("bigint")).filter("copies > 0")
    mixed = scratch.write("mixed", mixed.select("doc_id", "source", "language", "topic", "tokens", "copies"))
    got = {
        r["source"]: r
        for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most")).collect()
    }
    whole = sum(r["n"] for r in got.values()) or 1
    report = []
    for i, s in enumerate(sources):
        n, docs, copies, top = (int(got[s][c]) for c in ("n", "docs", "copies", "most")) if s in got else (0, 0, 0, 0)
        target = float(share[i] * total)
        off = (n - target) / target if target else 0.0
        report.append((s, share[i].item(), n / whole, target, n, off, int(available[i]), int(reach[i]), docs, copies, top, bool(reach[i] >= target * (1 - 1e-9)), abs(off) <= CLOSE))
    schema = (
        "source string, target_share double, actual_share double, target_tokens double, actual_tokens bigint, deviation double, available_tokens bigint, "
        "most_tokens bigint, documents bigint, copies bigint, most_copies bigint, reachable boolean, met boolean"
    )
    return mixed, spark.createDataFrame(report, schema)


def _marks(spark: SparkSession, placed: DataFrame, need: dict[str, float], start: dict[str, float], limit: dict[str, float], taken: dict[str, list[int]]) -> dict[str, tuple[float, float, float]]:
    """Per source where the turns that are taken begin and end, so that their tokens don't exceed the need; and what is left of it.

    Only documents of up to ``limit`` tokens that aren't ``taken`` count. Turns are counted in bins,
    and the bin at the end is cut again, for all sources at once: after CUTS
    rounds a bin is a BINS ** CUTS-th of the turns.
    """
    low, width, left = dict(start), {s: (4.0 - start[s]) / BINS for s in need}, dict(need)
    for _ in range(CUTS):
        at = F.broadcast(spark.createDataFrame([(s, low[s], width[s], limit[s], taken[s]) for s in need], "source string, low double, width double, limit double, taken array<bigint>"))
        turn = F.floor((F.col("turn") - F.col("low")) / F.col("width"))
        fits = placed.filter("turn is not null").join(at, "source").filter((F.col("turn") >= F.col("low")) & (F.col("tokens") <= F.col("limit")) & F.expr("not array_contains(taken, doc_id)"))
        by: dict[str, list] = {}
        for r in fits.groupBy("source", F.least(turn, F.lit(BINS)).alias("bin")).agg(F.sum("tokens").alias("n")).collect():  # at most BINS + 1 rows per source
            by.setdefault(r["source"], []).append((r["bin"], r["n"]))
        for s in need:
            edge = BINS
            for b, n in sorted(by.get(s, [])):
                if n > left[s]:
                    edge = b
                    break
                left[s] -= n
            low[s] += edge * width[s]
            width[s] /= BINS
    return {s: (start[s], low[s], left[s]) for s in need}


def _fill(spark: SparkSession, placed: DataFrame, spans: dict[str, list], left: dict[str, float], enough: dict[str, float], taken: dict[str, list[int]]) -> None:
    """Take documents in no span that fill what a source lacks: each time the largest that fits, of equal ones the first by turn."""
    done: set[str] = set()
    for _ in range(FILLS):
        short = [(s, spans[s], float(left[s]), taken[s]) for s in spans if s not in done and left[s] >= max(1.0, enough[s])]
        if not short:
            break
        at = F.broadcast(spark.createDataFrame(short, f"source string, {_SPANS}, room double, taken array<bigint>"))
        free = placed.filter("sure < most").join(at, "source").filter(~_taken() & F.expr("tokens <= room and not array_contains(taken, doc_id)"))
        best = F.max_by(F.struct("doc_id", "tokens"), F.struct("tokens", -F.coalesce("turn", F.lit(1e300)), -F.col("doc_id"))).alias("x")
        found = free.groupBy("source").agg(best).collect()  # a row a source
        for r in found:
            taken[r["source"]].append(r["x"]["doc_id"])
            left[r["source"]] -= r["x"]["tokens"]
        done |= {x[0] for x in short} - {r["source"] for r in found}  # nothing fits
