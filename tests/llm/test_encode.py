import base64

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encode import PATTERN, VOCABULARIES, VOCABULARY, Encoder, Merges, token_counts, token_ids
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def merges():
    with open(f"{VOCABULARIES}/{VOCABULARY}.json", "rb") as f:
        return Merges(f.read())


@pytest.fixture(scope="module")
def oracle():
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/{VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = [
    "", " ", "\n\n  \t x", "it's we'll I'D", "<|endoftext|> stays text", "a" * 5000, "ab" * 3000 + "c", "   " * 1000, "=-=" * 999, "aaa aaaa aaaaa aaaaaa", "日本語" * 300, "\U0001f600" * 100,
    "def f(x):\n    return x + 1\r\n", "\x1c\x85　x", "Ünïcödé naïve", "0123456789" * 50, "x" * 60_000,
]


def encode(merges, texts):
    ids, sizes = Encoder(merges).block(texts)
    out, at = [], 0
    for n in sizes.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_known_texts(merges, oracle):
    assert encode(merges, TEXTS) == [oracle(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_text(merges, oracle, texts):
    assert encode(merges, texts) == [oracle(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abt he\n", max_size=200))
def test_dense_merges(merges, oracle, text):
    assert encode(merges, [text]) == [oracle(text)]


def test_agrees_with_the_rank_file(merges):
    tiktoken = pytest.importorskip("tiktoken")
    from tidemark.llm.encode import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{VOCABULARIES}/{VOCABULARY}.tiktoken", "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN.replace("\\p{White_Space}", "\\s").replace("\\P{White_Space}", "\\S").replace("[^\\s", "[^\\s"), mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS[:8] + TEXTS[12:13]:
        assert encode(merges, [t])[0] == enc.encode_ordinary(t)


def test_words_kept_between_blocks_change_nothing(merges, oracle):
    e = Encoder(merges)
    for _ in range(2):
        ids, sizes = e.block(["some words", "again some words"])
        assert ids.tolist() == oracle("some words") + oracle("again some words")


def test_ids_of_documents(spark, oracle):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "x y " * 5000), (5, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in token_ids(df).collect()}
    assert got == {i: oracle(t or "") for i, t in rows}
    counts = {r["doc_id"]: r["tokens"] for r in token_counts(df, [F.col("doc_id")]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_empty_table(spark):
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _cut(texts):
    from tidemark.llm.encode import word_starts

    text = "".join(texts)
    length = np.array([len(x) for x in texts])
    first = np.zeros(len(text), dtype=bool)
    first[(np.cumsum(length) - length)[length > 0]] = True
    begin = word_starts(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), first).tolist()
    return [text[a:b] for a, b in zip(begin, [*begin[1:], len(text)])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab1 '\n\tstrevlmd. 　éЖ٣²́x\x1c\x85", max_size=30), min_size=1, max_size=5))
def test_words_are_those_of_the_pattern(texts):
    assert not any(texts) or _cut(texts) == [w for t in texts for w in regex.findall(PATTERN, t)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab '\n\ts.　é", max_size=80), st.integers(1, 20))
def test_pieces_have_the_same_words(text, most):
    from tidemark.llm.encode import pieces

    parts = pieces(text, most)
    assert "".join(parts) == text and [w for p in parts for w in regex.findall(PATTERN, p)] == regex.findall(PATTERN, text)


def test_long_texts_and_equal_sums(monkeypatch):
    """A text of several blocks, and sums that tell no two words apart, give the same ids."""
    from tidemark.llm import encode

    with open(f"{VOCABULARIES}/{VOCABULARY}.json", "rb") as f:
        merges = Merges(f.read())
    texts = ["one two  three\n" * 40 + "it's we'll " + "x" * 300, "", "two one", "　é" * 50]
    ids, sizes = encode.Encoder(merges).block(texts)
    monkeypatch.setattr(encode, "BLOCK_CHARS", 100)
    again, same = encode.Encoder(merges).block(texts)
    assert ids.tolist() == again.tolist() and sizes.tolist() == same.tolist()
    poor = encode.Encoder(merges)
    poor.base = 1
    third, also = poor.block(texts)
    assert ids.tolist() == third.tolist() and sizes.tolist() == also.tolist()
