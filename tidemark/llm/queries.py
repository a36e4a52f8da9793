"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cluster, encode, knn, mix, visual
from tidemark.sources import load


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return cluster.cluster_vectors(load(spark, base, "memories")).members


def p2_clusters(spark: SparkSession, base: str) -> DataFrame:
    return cluster.cluster_vectors(load(spark, base, "memories")).clusters


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return knn.similar_pairs(load(spark, base, "memories")).select("id_a", "id_b")


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode.token_ids(load(spark, base, "documents"))


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return mix.mix_documents(load(spark, base, "documents"), load(spark, base, "mix_targets"))[0]


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mix.mix_documents(load(spark, base, "documents"), load(spark, base, "mix_targets"))[1]


def p7_short(spark: SparkSession, base: str) -> DataFrame:
    """The report at twice the default size, where the scarcest source falls short."""
    total = p7_shares(spark, base).agg(F.sum("target_tokens")).first()[0]
    return mix.mix_documents(load(spark, base, "documents"), load(spark, base, "mix_targets"), total_tokens=int(2 * (total or 0)))[1]


def p7_checked(spark: SparkSession, base: str) -> DataFrame:
    """Per listed source the documents with text, and whether the mix keeps its promises: the target within one part in a hundred, repeats within the cap."""
    mixed, report = mix.mix_documents(load(spark, base, "documents"), load(spark, base, "mix_targets"))
    caps = load(spark, base, "mix_targets").select("source", "max_repeats")
    texts = load(spark, base, "documents").filter("text <> ''").groupBy("source").agg(F.count("*").alias("texts"))
    own = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("own"), F.count_distinct("doc_id").alias("ids"), F.count("*").alias("rows"))
    all_ = report.join(caps, "source").join(texts, "source", "left").join(own, "source", "left")
    true = (F.col("own") == F.col("actual_tokens")) & (F.col("ids") == F.col("rows")) & (F.col("documents") == F.col("rows"))
    return all_.select("source", "target_share", "texts", "met", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), true.alias("true_report"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return visual.lookalike_pairs(load(spark, base, "documents"))


def p8_forms(spark: SparkSession, base: str) -> DataFrame:
    return visual.text_forms(load(spark, base, "documents")).select("doc_id", "form", "mixed_words", "whole_words")


QUERIES = {f.__name__: f for f in (p2_found, p2_clusters, p5_found, p6_ids, p7_mix, p7_shares, p7_short, p7_checked, p8_found, p8_forms)}

#: Full-width ASCII and its plain form.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_LOOKS = [p for pairs in visual.LOOKALIKES.values() for p in pairs.split()]
_quoted = lambda s: "'" + s.replace("'", "''") + "'"

SQL = {
    "p2_found": """
        WITH RECURSIVE one AS MATERIALIZED (SELECT id, CAST(first(embedding) AS DOUBLE[]) AS e FROM memories WHERE id IS NOT NULL AND len(embedding) = 64 GROUP BY id),
        u AS MATERIALIZED (SELECT id, CAST(e AS DOUBLE[64]) AS e FROM one WHERE len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        edge AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE array_cosine_similarity(a.e, b.e) >= 0.86),
        both_ AS MATERIALIZED (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
        root AS (SELECT a AS id FROM both_ GROUP BY a HAVING min(b) > a),
        reach(root, id) AS (SELECT id, id FROM root UNION SELECT r.root, n.b FROM reach r JOIN both_ n ON n.a = r.id),
        member AS (SELECT id, min(root) AS cluster_id FROM reach GROUP BY id)
        SELECT id, cluster_id FROM member WHERE cluster_id IN (SELECT cluster_id FROM member GROUP BY cluster_id HAVING count(*) >= 5)""",
    "p5_found": """
        WITH one AS (SELECT id, min(nullif(lower(trim(tenant)), '')) AS tenant, CAST(first(embedding) AS DOUBLE[]) AS e FROM memories WHERE id IS NOT NULL AND len(embedding) = 64 GROUP BY id),
        u AS (SELECT * FROM one WHERE tenant IS NOT NULL AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM u a JOIN u b ON a.tenant = b.tenant AND a.id <> b.id),
        r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s WHERE s >= 0.86)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 5""",
    "p7_checked": "SELECT source, target_share, (SELECT count(*) FROM documents d WHERE d.source = m.source AND text <> '') AS texts, true AS met, true AS capped, true AS true_report FROM mix_targets m",
    "p8_found": f"""
        WITH t AS (SELECT doc_id, text, nfc_normalize(translate(nfc_normalize(translate(regexp_replace(text, '[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]', '', 'g'), {_quoted(_BLANKS + _WIDE)}, {_quoted(" " * len(_BLANKS) + _NARROW)})),
            {_quoted("".join(p[0] for p in _LOOKS))}, {_quoted("".join(p[1] for p in _LOOKS))})) AS form FROM documents WHERE text <> '')
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
