import datetime as dt
import random

import pytest

from tidemark.operators.eav import attribute_key, read_boolean, read_date, read_decimal, read_integer, wide_cells, wide_table

FACTS = "fact_id long, subject string, attribute string, value string, asserted_at timestamp_ntz, entity string"
CATALOG = [("seat_count", "integer"), ("spend", "decimal"), ("seen_on", "date"), ("opted", "boolean"), ("zone", "text"), ("never", "text")]


@pytest.mark.parametrize(
    "text, want",
    [("12", "12"), ("+0012", "12"), ("-784", "-784"), ("1,234,567", "1234567"), ("35.00", "35"), ("-0", "0"), ("9007199254741921", "9007199254741921"), ("3.5", None), ("1,23", None), ("12O4", None), ("--5", None), ("1e3", None), ("", None), (".0", None), ("1234,567", None), ("9" * 19, None), ("٣", None)],
)
def test_integers(text, want):
    assert read_integer(text) == want


@pytest.mark.parametrize(
    "text, want",
    [("75.19", "75.19"), ("86.0300", "86.03"), ("8431e-2", "84.31"), ("-49083554E-2", "-490835.54"), ("506,730.13", "506730.13"), ("+7", "7.00"), (".5", "0.50"), ("5.", "5.00"), ("-0.001", "0.00"), ("1e3", "1000.00"), ("9.9.9", None), ("ten", None), ("e5", None), ("1e9999", None), ("1e-9999", "0.00"), ("-", None)],
)
def test_decimals(text, want):
    assert read_decimal(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2021-09-22", "2021-09-22"), ("2024/08/13", "2024-08-13"), ("20250317", "2025-03-17"), ("2019-12-24T13:11:00", "2019-12-24"), ("2024-09-25 06:19:24", "2024-09-25"), ("27 Mar 2020", "2020-03-27"), ("Mar 23, 2020", "2020-03-23"),
        ("16 December 2024", "2024-12-16"), ("December 16, 2024", "2024-12-16"), ("2 june 2024", "2024-06-02"), ("Tue, 3rd Mar 2020", "2020-03-03"), ("25.12.2020", "2020-12-25"), ("12/25/2020", "2020-12-25"), ("04/04/2020", "2020-04-04"),
        ("2024-09-25T06:19:24.123Z", "2024-09-25"), ("2024-09-25 06:19+02:00", "2024-09-25"), ("2020 Mar 5", "2020-03-05"), ("03/04/2020", None), ("2021-02-29", None), ("20210230", None), ("31 June 2020", None), ("last week", None), ("2021-13-01", None), ("21-09-22", None), ("2021", None), ("2021-09/22", None), ("99 Mar 2020", None), ("1 Foo 2020", None),
    ],
)
def test_dates(text, want):
    assert read_date(text) == want


def test_booleans_and_names():
    assert [read_boolean(s) for s in ("YES", "t", "On", "1", "no", "F", "off", "0", "-1", "maybe")] == ["true"] * 4 + ["false"] * 4 + [None] * 2
    assert len({attribute_key(s) for s in ("seat_count", "Seat Count", "seat-count", "seatCount", " SEAT_COUNT ")}) == 1


def brute(rows):
    read = {"integer": read_integer, "decimal": read_decimal, "date": read_date, "boolean": read_boolean, "text": lambda s: s}
    best = {}
    for fid, subject, attribute, value, at, _ in rows:
        if subject is None or not subject.strip() or attribute is None or value is None:
            continue
        hit = [(a, t) for a, t in CATALOG if attribute_key(a) == attribute_key(attribute)]
        v = value.strip()
        if not hit or v.lower() in ("", "n/a", "null", "none", "unknown", "-", "?"):
            continue
        cell = read[hit[0][1]](v)
        if cell is None:
            continue
        rank = (at is not None, at or dt.datetime.min, fid)
        key = (subject.strip(), hit[0][0])
        if key not in best or rank >= best[key][0]:
            best[key] = (rank, cell)
    return {(s, a, c) for (s, a), (_, c) in best.items()}


def test_matches_brute_force_with_a_hot_subject(spark):
    rnd = random.Random(1)
    values = ["5", " 6 ", "7.0", "x", "", None, "N/A", "true", "No", "2020-01-0%d", "3 Mar 2021", "1,000", "12.5", "  ok ", "none", "日本", "z" * 5000]
    names = ["seat_count", "Seat Count", "SPEND", "spend ", "seenOn", "opted", "Zone", "other", None, "??"]
    rows = []
    for i in range(4000):
        subject = "hot" if i % 3 == 0 else rnd.choice(["a", " a", "b ", None, "  ", f"s{rnd.randrange(200)}"])
        v = rnd.choice(values)
        rows.append((i, subject, rnd.choice(names), v % rnd.randrange(1, 9) if v and "%d" in v else v, rnd.choice([None, dt.datetime(2024, 1, rnd.randrange(1, 28))]), "clash"))
    rows += rows[:300]
    df = spark.createDataFrame(rows, FACTS).repartition(6)
    catalog = spark.createDataFrame(CATALOG, "attribute string, value_type string")
    assert {tuple(r) for r in wide_cells(df, catalog).collect()} == brute(rows)
    wide = wide_table(df, catalog, flush=50)
    assert wide.columns == ["subject", *sorted(a for a, _ in CATALOG)] and dict(wide.dtypes)["spend"] == "decimal(38,2)"
    assert wide.count() == len({s for s, _, _ in brute(rows)}) == wide.select("subject").distinct().count()


def test_empty_and_no_catalogue(spark):
    catalog = spark.createDataFrame(CATALOG, "attribute string, value_type string")
    none = spark.createDataFrame([], FACTS)
    assert wide_table(none, catalog).count() == 0 and wide_cells(none, catalog).count() == 0
    facts = spark.createDataFrame([(1, "s", "zone", "v", None, "")], FACTS)
    assert wide_cells(facts, catalog.limit(0)).count() == 0
    with pytest.raises(ValueError):
        wide_table(facts, spark.createDataFrame([("a", "blob")], "attribute string, value_type string"))
