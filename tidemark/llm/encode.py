"""Token ids of a whole corpus by replaying the merges of a byte-pair vocabulary.

Texts are cut into words by the vocabulary's pattern and every distinct word of
a block of the corpus is laid out once, as bytes, in one array. An inverted
index from pairs of neighbouring tokens to their positions then gives, in order
of rank, the places where a merge applies; a merge touches its two neighbours
only, whose new pairs go into the index. Ranks are taken in bands so that many
merges run as one array operation: in a band each word merges its own lowest
rank first, which is the order of ranks, as words don't touch each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies are, and the one used; both are parameters of every operator.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern that cuts a text into words before the merges, its white space named by property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Characters of text handled at once, and words whose ids a worker keeps between blocks.
BLOCK_CHARS = 2_000_000
KEPT_WORDS = 1_000_000
_NONE = np.int32(1 << 20)  # a rank beyond all ranks


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the bytes: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary: the token of each byte and, by pair of tokens, rank and result."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        vocab, merges = model["vocab"], model["merges"]
        names = _byte_names()
        self.byte = np.zeros(256, dtype=np.int32)
        for name, b in names.items():
            self.byte[b] = vocab[name]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.double = left == right
        key = (left << 32) | right
        # of a pair that is listed twice the last rank counts
        order = np.lexsort((np.arange(len(key)), key))
        last = np.append(key[order][1:] != key[order][:-1], True) if len(key) else np.empty(0, dtype=bool)
        self.key, self.rank = key[order][last], order[last].astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        if not len(self.key):
            return np.full(len(key), _NONE)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def bands(self) -> list[int]:
        edges = [64]
        while edges[-1] < len(self.made):
            edges.append(edges[-1] * 2)
        return edges

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        token = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(words), dtype=np.int64), size)
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        ends = np.cumsum(size)[size > 0]
        after[ends - 1] = -1
        before[ends - size[size > 0]] = -1
        pair = np.full(n, _NONE, dtype=np.int32)  # the rank of the pair that begins here
        at = np.flatnonzero(after >= 0)
        pair[at] = self.ranks(token[at], token[after[at]])
        waiting = at[pair[at] < _NONE]
        for edge in self.bands():
            due = pair[waiting] < edge
            queue, waiting = waiting[due], waiting[~due]
            later = []
            while len(queue):
                queue = queue[np.lexsort((queue, pair[queue], word[queue]))]
                w, r = word[queue], pair[queue]
                new = np.append(True, w[1:] != w[:-1])
                lowest = r[np.maximum.accumulate(np.where(new, np.arange(len(queue)), 0))]
                take = r == lowest
                if self.double[r[take]].any():  # of x x x the first two
                    chain = np.append(False, take[1:] & take[:-1] & (after[queue[:-1]] == queue[1:]))
                    begin = np.maximum.accumulate(np.where(chain, 0, np.arange(len(queue))))
                    take &= (np.arange(len(queue)) - begin) % 2 == 0
                here, rest = queue[take], queue[~take]
                gone = after[here]
                token[here] = self.made[pair[here]]
                beyond = after[gone]
                after[here] = beyond
                has = beyond >= 0
                before[beyond[has]] = here[has]
                token[gone] = -1
                pair[gone] = _NONE
                left = before[here]
                touched = np.unique(np.concatenate([here, left[left >= 0]]))
                nxt = after[touched]
                got = np.full(len(touched), _NONE, dtype=np.int32)
                inner = nxt >= 0
                got[inner] = self.ranks(token[touched[inner]], token[nxt[inner]])
                pair[touched] = got
                later.append(touched[(got >= edge) & (got < _NONE)])
                queue = np.unique(np.concatenate([rest[pair[rest] < edge], touched[got < edge]]))
            if later:
                waiting = np.unique(np.concatenate([waiting, *later]))
            waiting = waiting[pair[waiting] < _NONE]
        alive = token >= 0
        return token[alive], np.bincount(word[alive], minlength=len(words))


#: Kinds of characters that the pattern tells apart, and the one that a space or an apostrophe is.
_OTHER, _LETTER, _FIGURE, _BLANK = range(4)
_SPACE, _QUOTE = 0x20, 0x27
#: What follows an apostrophe in a contraction.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point, as the pattern's properties have it."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((_LETTER, "L"), (_FIGURE, "N"), (_BLANK, "White_Space")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            low, high = ord(m[0][0]), ord(m[0][-1]) + 1
            out[low:high] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in a row of code points; ``first`` marks where texts do. The same cuts as by PATTERN, all at once."""
    n = len(points)
    kind = _kinds()[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # of blanks before a word the last is cut off, and a space goes with the word
    after = np.flatnonzero(start & ~first & (kind != _BLANK))
    after = after[kind[after - 1] == _BLANK]
    start[after - 1] = True
    start[after[points[after - 1] == _SPACE]] = False
    quote = np.flatnonzero(start & (points == _QUOTE))
    for ending in ENDINGS:
        at = quote[quote + len(ending) < n]
        for i, c in enumerate(ending, 1):
            at = at[(points[at + i] == ord(c)) & ~first[at + i]]
        start[at + 1] = False
        beyond = at + len(ending) + 1
        start[beyond[beyond < n]] = True
    return np.flatnonzero(start)


_BETWEEN = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


def pieces(text: str, most: int | None = None) -> list[str]:
    """A long text in pieces of about ``most`` characters, cut before blanks, where no word goes on: the words are the same."""
    most, out, at = most or BLOCK_CHARS, [], 0
    while len(text) - at > most and (m := _BETWEEN.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Encoder:
    """Ids of texts, block by block; the ids of words seen are kept between blocks, up to a bound.

    Equal words are found by a sum of powers over their characters, and then
    compared character by character, so the sum decides nothing.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        rng = np.random.default_rng(11)
        self.base = int(rng.integers(1 << 62)) | 1
        self.power = self.inverse = np.empty(0, dtype=np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}  # by sum
        self.words: list[str] = []
        self.ids = np.empty(0, dtype=np.int32)
        self.count = np.empty(0, dtype=np.int64)
        self.start = np.empty(0, dtype=np.int64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n + 1:
            with np.errstate(over="ignore"):
                for name, x in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                    row = np.full(n + 1, x, dtype=np.uint64)
                    row[0] = 1
                    setattr(self, name, np.cumprod(row, dtype=np.uint64))

    def _coded(self, text: str, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of each word of a block; new words get the next numbers."""
        n = len(points)
        end = np.append(begin[1:], n)
        self._powers(n)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((points.astype(np.uint64) + 1) * self.power[:n], out=total[1:])
            mark = (total[end] - total[begin]) * self.inverse[begin]
        marks, one, of = np.unique(mark, return_index=True, return_inverse=True)
        same = np.repeat(begin[one][of] - begin, end - begin) + np.arange(n)
        if not (end - begin == (end - begin)[one][of]).all() or not (points[np.minimum(same, n - 1)] == points).all():
            return self._plain([text[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        code = np.empty(len(marks), dtype=np.int64)
        for i, (m, a, b) in enumerate(zip(marks.tolist(), begin[one].tolist(), end[one].tolist())):
            word = text[a:b]
            at = self.known.get(m)
            if at is None:
                at = self.known[m] = len(self.words)
                self.words.append(word)
            elif self.words[at] != word:
                return self._plain([text[x:y] for x, y in zip(begin.tolist(), end.tolist())])
            code[i] = at
        return code[of]

    def _plain(self, words: list[str]) -> np.ndarray:
        """The same by the words themselves, for the case that sums of different words are equal."""
        number: dict[str, int] = {}
        for at, word in enumerate(self.words):
            number.setdefault(word, at)
        out = []
        for word in words:
            if word not in number:
                number[word] = len(self.words)
                self.words.append(word)
            out.append(number[word])
        return np.array(out, dtype=np.int64)

    def block(self, texts: list[str], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of each text; with ``counts_only`` the ids are left out."""
        if any(len(x) > BLOCK_CHARS for x in texts):
            parts = [self._piece(p, counts_only) for x in texts for p in [pieces(x)]]
            return np.concatenate([i for i, _ in parts]), np.array([n for _, n in parts], dtype=np.int64)
        return self._block(texts, counts_only)

    def _piece(self, parts: list[str], counts_only: bool) -> tuple[np.ndarray, int]:
        got = [self._block([x], counts_only) for x in parts]
        return np.concatenate([i for i, _ in got]), int(sum(n.sum() for _, n in got))

    def _block(self, texts: list[str], counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KEPT_WORDS:
            self._clear()
        length = np.array([len(x) for x in texts], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(length)])
        if not edge[-1]:
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(points), dtype=bool)
        first[edge[:-1][length > 0]] = True
        begin = word_starts(points, first)
        held = len(self.count)
        use = self._coded(text, points, begin)
        if len(self.words) > held:
            ids, count = self.merges.replay([w.encode() for w in self.words[held:]])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.ids = np.concatenate([self.ids, ids])
            self.count = np.concatenate([self.count, count])
        n = self.count[use]
        total = np.concatenate([[0], np.cumsum(n)])
        lengths = np.diff(total[np.searchsorted(begin, edge)])
        if counts_only:
            return np.empty(0, dtype=np.int32), lengths
        at = np.repeat(self.start[use] - total[:-1], n) + np.arange(total[-1])
        return self.ids[at], lengths


_ENCODERS: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Merges(raw))
    return _ENCODERS[key]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK_CHARS characters, null as empty; a long text is a run of its own, whole."""
    held, chars, first = [], 0, 0
    for i, text in enumerate(texts):
        s = text.as_py() or ""
        held.append(s)
        chars += len(s)
        if chars >= BLOCK_CHARS:
            yield first, held
            held, chars, first = [], 0, i + 1
    if held:
        yield first, held


def _encode(raw, column: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value)
        for batch in batches:
            texts = batch.column(column)
            others = [n for n in batch.schema.names if n != column]
            for first, block in _blocks(texts):
                ids, sizes = encoder.block(block, counts_only)
                if counts_only:
                    out = pa.array(sizes, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
                part = batch.slice(first, len(block))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in others), out], names=[*others, "result_"])

    return run


def _raw(spark: SparkSession, vocabulary: str, folder: str):
    """The vocabulary file, a fixed 1.5 MB, sent to each executor once."""
    with open(f"{folder}/{vocabulary}.json", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def spread(frame: DataFrame) -> DataFrame:
    """A scan of few splits in as many partitions as there are cores. What has shuffles is left as it is: asking would run it."""
    run = frame._jdf.queryExecution()
    if "Adaptive" in run.executedPlan().getClass().getSimpleName():
        return frame
    want = frame.sparkSession.sparkContext.defaultParallelism
    return frame if run.toRdd().getNumPartitions() >= want else frame.repartition(want)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``ids``, the token ids of each text without special tokens.

    Null and empty texts have an empty list. Special tokens written out in a
    text are ordinary text. Whole texts are encoded where they lie.
    """
    raw = _raw(documents.sparkSession, vocabulary, folder)
    rows = spread(documents.select(F.col(key).alias("key_"), F.col(text).alias("text_")))
    kind = documents.schema[key].dataType.simpleString()
    out = rows.mapInArrow(_encode(raw, "text_", False), f"key_ {kind}, result_ array<int>")
    return out.select(F.col("key_").alias(key), F.col("result_").alias("ids"))


def token_counts(documents: DataFrame, columns: list[Column], text: str = "text", vocabulary: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``columns`` of each document and ``tokens``, how many ids its text has; null and empty texts have none."""
    raw = _raw(documents.sparkSession, vocabulary, folder)
    rows = spread(documents.select(*columns, F.col(text).alias("text_")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text_")
    return rows.mapInArrow(_encode(raw, "text_", True), f"{schema}, result_ bigint").withColumnRenamed("result_", "tokens")
