import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.intervals import LEVELS, OPEN, decompose, drop_covered, join_siblings, price_periods, union_runs


def brute(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


pair = st.tuples(st.integers(0, 300), st.integers(1, 80)).map(lambda t: (t[0], t[0] + t[1]))
wide = st.tuples(st.integers(0, OPEN - 1), st.integers(1, OPEN)).map(lambda t: (t[0], min(OPEN, t[0] + t[1])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(pair, wide)), max_size=25))
def test_union_is_the_brute_union(rows):
    g, s, e = (np.array(c, dtype=np.int64) for c in zip(*[(k, a, b) for k, (a, b) in rows])) if rows else (np.empty(0, dtype=np.int64),) * 3
    got = list(zip(*(x.tolist() for x in union_runs(g, s, e))))
    want = [(k, a, b) for k in range(3) for a, b in brute([p for q, p in rows if q == k])]
    assert sorted(got) == want


@settings(max_examples=200, deadline=None)
@given(wide)
def test_canonical_blocks(p):
    s, e = p
    _, start, level = decompose(np.array([0]), np.array([s]), np.array([e]))
    assert len(start) <= 2 * LEVELS and (start % (1 << level) == 0).all()
    order = np.argsort(start)
    assert start[order][0] == s and (start[order] + (1 << level[order]))[-1] == e
    assert (start[order][1:] == (start[order] + (1 << level[order]))[:-1]).all()


def test_blocks_below_others_go_and_siblings_join():
    g, s, lv = drop_covered(np.array([0, 0, 0, 1]), np.array([0, 2, 4, 2]), np.array([2, 0, 2, 0]))
    assert list(zip(g, s, lv)) == [(0, 0, 2), (0, 4, 2), (1, 2, 0)]
    g, s, lv = join_siblings(g, s, lv)
    assert sorted(zip(g, s, lv)) == [(0, 0, 3), (1, 2, 0)]


SCHEMA = "sku string, price long, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, entity string"


def test_prices_match_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(3000):
        sku = "HOT" if i % 3 == 0 else rnd.choice([" ab", "AB ", "cd", None, "  ", f"s{rnd.randrange(60)}"])
        f = base + dt.timedelta(seconds=rnd.randrange(10**8)) if rnd.random() > 0.03 else None
        span = rnd.choice([1, 60, 86_400, 86_400 * 40, -5, 0, 86_400 * 200])
        t = None if rnd.random() < 0.004 else (f or base) + dt.timedelta(seconds=span)
        rows.append((sku, None, f, t, None, "clash"))
    for k in range(400):  # touching and one second apart
        f = base + dt.timedelta(days=3000, seconds=2 * k)
        rows.append(("HOT2", 1, f, f + dt.timedelta(seconds=2 if k % 5 else 1), None, ""))
    rows += rows[:100] + [("old", 1, dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59), None, ""), ("far", 1, dt.datetime(9999, 1, 1), None, None, "")]
    far = dt.datetime(9999, 12, 31, 1)
    by = {}
    for sku, _, f, t, _, _ in rows:
        if sku is not None and sku.strip() and f is not None and (t is None or t > f):
            by.setdefault(sku.strip().upper(), []).append((f, t or far))
    want = set()
    text = lambda x: "open" if x == far else x.strftime("%Y-%m-%d %H:%M:%S").rjust(19, "0")
    for sku, spans in by.items():
        runs = brute(spans)
        want |= {(sku, "period", text(a), text(b)) for a, b in runs} | {(sku, "gap", text(a[1]), text(b[0])) for a, b in zip(runs, runs[1:])}
    got = [tuple(r) for r in price_periods(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    assert price_periods(spark.createDataFrame([], SCHEMA)).count() == 0
    assert price_periods(spark.createDataFrame([("a", 1, None, None, None, "")], SCHEMA)).count() == 0
