import numpy as np
import pytest

from tidemark.llm.mix import mix_documents, rake, topic


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    axes = [x.ravel() for x in np.indices((3, 4, 5))]
    size = rng.integers(50, 100, 60).astype(float)
    want = [np.array([0.5, 0.3, 0.2]) * 1000, np.array([0.4, 0.3, 0.2, 0.1]) * 1000, np.full(5, 200.0)]
    w = rake(size, np.full(60, 50.0), axes, want)
    for at, target in zip(axes, want):
        assert np.allclose(np.bincount(at, weights=size * w), target, rtol=1e-6)


def test_rake_keeps_caps():
    axes = [np.array([0, 0, 1]), np.array([0, 1, 0])]
    w = rake(np.array([10.0, 10.0, 5.0]), np.array([1.0, 1.0, 3.0]), axes, [np.array([20.0, 90.0]), np.array([70.0, 40.0])])
    assert (w <= np.array([1.0, 1.0, 3.0]) + 1e-12).all()
    assert np.isclose(5.0 * w[2], 15.0)  # the most that its cap allows


def test_topics(spark):
    paths = ["src/a.py", "Tests/x/y.go", "licence.md", "docs/LICENSE", "pkg/vendor/b.c", "/tools/a", "x.py", "", None, "licences_of/a.py"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = [r[1] for r in sorted(df.select("i", topic()).collect())]
    assert got == ["application", "tests", "licence", "licence", "library", "tools", "other", "other", "other", "other"]


def test_many_languages_are_all_raked(spark):
    """Each of two hundred languages keeps its share, none is pooled."""
    rows = [(i, "a" if i % 2 else "b", f"lang{i % 200}", "src/x", "word " * (3 + i % 9), 0) for i in range(6000)]
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], TARGETS)
    mixed, report = mix_documents(spark.createDataFrame(rows, DOCS), targets)
    assert all(r["met"] for r in report.collect()) and mixed.select("language").distinct().count() == 200


def test_the_last_documents_fill_the_target(spark):
    """Sizes differ a thousandfold, so a whole document more or less would miss by far."""
    rows = [(i, "a" if i % 3 else "b", "go", "src/x", "word " * (2000 if i % 10 == 0 else 2 + i % 40), 0) for i in range(300)]
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 2)], TARGETS)
    for total in (5_000, 20_000):
        _, report = mix_documents(spark.createDataFrame(rows, DOCS), targets, total_tokens=total)
        assert all(r["met"] and abs(r["deviation"]) < 0.005 for r in report.collect())


DOCS = "doc_id long, source string, lang string, path string, text string, tokens long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(1200):
        source = ["big", "big", "big", "mid", "tiny" if i % 40 == 3 else "big", "unlisted", None][i % 7]
        lang = ["Python", "python ", "go", None][i % 4]
        text = None if i % 97 == 0 else "" if i % 89 == 0 else "word " * (5 + i * 7 % 60)
        rows.append((i, source, lang, f"src{i % 3}/a.py" if i % 5 else None, text, 7))
    return spark.createDataFrame(rows, DOCS)


TARGETS = "source string, target_share double, max_repeats long"


def test_shares_are_met(spark, docs):
    targets = spark.createDataFrame([("big", 0.7, 1), ("mid", 0.2, 3), ("tiny", 0.1, 4), ("absent", 0.0, 2)], TARGETS)
    mixed, report = mix_documents(docs, targets)
    rep = {r["source"]: r for r in report.collect()}
    for s in ("big", "mid"):
        assert rep[s]["met"] and abs(rep[s]["actual_share"] - rep[s]["target_share"]) < 0.02
    assert rep["absent"]["actual_tokens"] == 0
    assert all(rep[s]["most_copies"] <= m for s, m in (("big", 1), ("mid", 3), ("tiny", 4)))
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} <= {"big", "mid", "tiny"}
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(r["actual_tokens"] for r in rep.values())
    assert all(r["tokens"] > 0 for r in rows)


def test_an_unreachable_target_is_reported(spark, docs):
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], TARGETS)
    _, report = mix_documents(docs, targets, total_tokens=20_000)
    rep = {r["source"]: r for r in report.collect()}
    assert not rep["tiny"]["met"] and not rep["tiny"]["reachable"] and rep["tiny"]["actual_tokens"] == rep["tiny"]["most_tokens"]
    assert rep["big"]["met"] and abs(rep["big"]["actual_tokens"] - 10_000) < 200


def test_same_mix_every_time(spark, docs):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], TARGETS)
    once, again = (sorted(map(tuple, mix_documents(docs.repartition(n), targets)[0].collect())) for n in (2, 5))
    assert once == again


def test_empty_inputs(spark, docs):
    targets = spark.createDataFrame([("big", 1.0, None)], TARGETS)
    mixed, report = mix_documents(docs.limit(0), targets)
    assert mixed.count() == 0 and report.first()["actual_tokens"] == 0
    mixed, report = mix_documents(docs, targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


def test_a_capped_source_falls_short_at_twice_the_default(spark, docs, tmp_path):
    from tidemark.llm.queries import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 2)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    short = {r["source"]: r for r in QUERIES["p7_short"](spark, str(tmp_path)).collect()}
    assert all(r["met"] for r in QUERIES["p7_shares"](spark, str(tmp_path)).collect())
    assert not short["tiny"]["met"] and short["tiny"]["actual_tokens"] == short["tiny"]["most_tokens"] < short["tiny"]["target_tokens"]
    assert short["big"]["met"]
