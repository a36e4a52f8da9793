from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.visual import FURTHER, LOOKALIKES, consistent, lookalike_pairs, text_forms


@pytest.mark.parametrize(
    "a, b",
    [
        ("Ａｂｃ１２（", "Abc12("),  # full width
        ("ﾊﾟﾀｰﾝ", "パターン"),  # half width with its mark
        ("é", "é"),
        ("Å", "Å"),
        ("Å", "Å"),
        ("a​b­﻿", "ab"),
        ("a b　c d", "a b c d"),
        ("pаypal", "paypal"),  # mixed script
        ("сор", "cop"),  # wholly Cyrillic
        ("мaл", "мал"),  # a Latin letter in a Cyrillic word
        ("АΒC", "ABC"),
        ("ё", "ë"),  # accented look-alike
        ("x̣́", "x̣́"),  # order of separate marks
    ],
)
def test_same_look(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize(
    "a, b",
    [("A", "a"), ("e", "é"), ("x2", "x²"), ("l", "1"), ("I", "l"), ("O", "0"), ("a b", "a  b"), ("a b", "a\tb"), ("a\n", "a"), ("a\r\n", "a\n"), ("rn", "m"), ("ﬁ", "fi"), ("м", "m"), ("①", "1")],
)
def test_different_look(a, b):
    assert consistent(a) != consistent(b)


@pytest.mark.parametrize("a, b", [("Γород", "Город"), ("Πоле", "Поле"), ("Φакт", "Факт"), ("ΓΑ", "ГА"), ("ΠΟΤ", "ПОТ"), ("ⲔⲞⲦ", "KOT"), ("ⲠⲞⲢⲦ", "ПОРТ")])
def test_same_look_without_latin(a, b):
    assert consistent(a) == consistent(b)


def test_further_table_adds_letters():
    letters = [p[0] for pairs in [*LOOKALIKES.values(), *FURTHER.values()] for p in pairs.split()]
    assert len(letters) == len(set(letters)) and all(len(p) == 2 for pairs in FURTHER.values() for p in pairs.split())


def test_table_is_one_to_one():
    letters = [p[0] for pairs in LOOKALIKES.values() for p in pairs.split()]
    assert len(letters) == len(set(letters)) and all(len(p) == 2 for pairs in LOOKALIKES.values() for p in pairs.split())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_a_form_is_its_own_form(text):
    assert consistent(consistent(text)) == consistent(text)


def test_pairs_match_brute_force(spark):
    texts = ["paypal one", "pаypal one", "pay​pal one", "paypal one", None, "", "​", "   ", "   ", "Paypal one", "x" * 70_000 + "é", "x" * 70_000 + "é"]
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, form_key string")
    got = {tuple(r) for r in lookalike_pairs(df).collect()}
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if a and b and a != b and consistent(a) == consistent(b)}
    assert got == want and len(got) == 7


def test_forms_of_null_empty_and_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "pаy сор")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in text_forms(df).collect()}
    assert rows[1]["form"] is None and rows[1]["form_key"] is None
    assert rows[2]["form"] == "" and rows[2]["mixed_words"] == 0
    assert (rows[3]["form"], rows[3]["mixed_words"], rows[3]["whole_words"]) == ("pay cop", 1, 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lookalike_pairs(df).count() == 0 and text_forms(df).count() == 0


def test_a_hot_form_of_equal_copies_gives_no_pairs(spark):
    df = spark.range(3000).selectExpr("id doc_id", "'same text' text")
    assert lookalike_pairs(df).count() == 0


def test_a_hot_form_with_one_odd_spelling(spark):
    """Copies of one text aren't paired with each other: only the pairs asked for are ever made."""
    df = spark.range(20_001).selectExpr("id doc_id", "if(id = 77, 'same t\u0435xt', 'same text') text")
    got = lookalike_pairs(df)
    assert got.count() == 20_000 == got.distinct().count()
    assert got.filter("doc_id_a = 77 or doc_id_b = 77").count() == 20_000 and got.filter("doc_id_a >= doc_id_b").count() == 0


def test_texts_with_many_copies_each_and_repeated_rows(spark):
    df = spark.range(9_000).selectExpr("id % 8000 doc_id", "element_at(array('p\u0430y', 'pay', 'pa\u0443', 'pay '), cast(id % 8000 % 4 as int) + 1) text")
    got = lookalike_pairs(df)
    assert got.count() == got.distinct().count() == 3 * 2000 * 2000
