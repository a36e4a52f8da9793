"""Queries of the general data-processing operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import eav, intervals, treeagg
from tidemark.sources import load


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return treeagg.large_tenants(load(spark, base, "memories"))


def p1_tenant_stats(spark: SparkSession, base: str) -> DataFrame:
    return treeagg.memory_stats(load(spark, base, "memories"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return eav.wide_cells(load(spark, base, "facts"), load(spark, base, "attr_catalog"))


def p3_wide(spark: SparkSession, base: str) -> DataFrame:
    return eav.wide_table(load(spark, base, "facts"), load(spark, base, "attr_catalog"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return intervals.price_periods(load(spark, base, "prices"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tenant_stats, p3_found, p3_wide, p4_found)}

_ONE_MEMORY = r"""
    SELECT id, min(nullif(lower(regexp_replace(tenant, '^\s+|\s+$', '', 'g')), '')) AS tenant,
           max(CASE WHEN length(trim(fact)) > 0 THEN 1 ELSE 0 END) AS has_fact,
           min(created_at) AS created_at, min(ingested_at) AS ingested_at
    FROM memories WHERE id IS NOT NULL GROUP BY id"""

SQL = {
    "p1_found": f"""
        WITH one AS ({_ONE_MEMORY})
        SELECT tenant FROM one WHERE tenant IS NOT NULL GROUP BY tenant
        HAVING count(*) * 1000000 >= 20000 * (SELECT count(*) FROM one)""",
    "p1_tenant_stats": f"""
        WITH one AS ({_ONE_MEMORY})
        SELECT tenant, count(*) AS memories, CAST(sum(has_fact) AS BIGINT) AS with_fact,
               min(created_at) AS first_created, max(created_at) AS latest_created,
               max(ingested_at) AS latest_ingested
        FROM one GROUP BY tenant""",
    "p3_found": r"""
        WITH c AS (SELECT attribute, value_type, lower(regexp_replace(attribute, '[^a-zA-Z0-9]', '', 'g')) AS k FROM attr_catalog),
        f AS (SELECT regexp_replace(subject, '^\s+|\s+$', '', 'g') AS subject, c.attribute, c.value_type, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v, asserted_at, fact_id
              FROM facts JOIN c ON c.k = lower(regexp_replace(facts.attribute, '[^a-zA-Z0-9]', '', 'g')) WHERE value IS NOT NULL AND trim(subject) <> ''),
        r AS (SELECT *, CASE value_type
                  WHEN 'text' THEN v
                  WHEN 'integer' THEN CASE WHEN regexp_full_match(v, '[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0*)?')
                      THEN CAST(TRY_CAST(regexp_replace(replace(replace(v, ',', ''), '+', ''), '\..*$', '') AS BIGINT) AS VARCHAR) END
                  WHEN 'decimal' THEN CASE WHEN regexp_full_match(v, '[+-]?(\d+|\d{1,3}(,\d{3})+)(\.\d*)?([eE][+-]?\d+)?')
                      THEN CAST(TRY_CAST(replace(replace(v, ',', ''), '+', '') AS DECIMAL(38, 2)) AS VARCHAR) END
                  WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', 'on', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', 'n', 'off', '0') THEN 'false' END
                  ELSE strftime(coalesce(try_strptime(v, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%d %b %Y', '%b %d, %Y', '%d %B %Y'])), '%Y-%m-%d') END AS cell
              FROM f WHERE lower(v) NOT IN ('', 'n/a', 'null', 'none', 'unknown', '-', '?')),
        n AS (SELECT *, row_number() OVER (PARTITION BY subject, attribute ORDER BY asserted_at DESC NULLS LAST, fact_id DESC) AS i FROM r WHERE cell IS NOT NULL)
        SELECT subject, attribute, cell FROM n WHERE i = 1""",
    "p4_found": r"""
        WITH v AS (
            SELECT nullif(upper(regexp_replace(sku, '^\s+|\s+$', '', 'g')), '') AS sku, valid_from AS f,
                   coalesce(valid_to, TIMESTAMP '9999-01-01') AS t
            FROM prices WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)),
        m AS (
            SELECT *, max(t) OVER (PARTITION BY sku ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
            FROM v WHERE sku IS NOT NULL),
        n AS (SELECT *, sum(CASE WHEN seen IS NULL OR f > seen THEN 1 ELSE 0 END)
                     OVER (PARTITION BY sku ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS g FROM m),
        p AS (SELECT sku, min(f) AS f, max(t) AS t FROM n GROUP BY sku, g),
        x AS (SELECT sku, 'period' AS kind, f, t FROM p
              UNION ALL
              SELECT sku, 'gap', lag(t) OVER w, f FROM p WINDOW w AS (PARTITION BY sku ORDER BY f))
        SELECT sku, kind, strftime(f, '%Y-%m-%d %H:%M:%S') AS from_at,
               CASE WHEN t = TIMESTAMP '9999-01-01' THEN 'open' ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS to_at
        FROM x WHERE f IS NOT NULL""",
}

#: The columns of the wide table, which SQL must name, and their types.
_COLUMNS = {
    "VARCHAR": "display_label escalation_path home_zone locale_tag preferred_tone",
    "BIGINT": "max_recall retry_budget seat_count token_ceiling",
    "DECIMAL(38, 2)": "score_ratio spend_limit unit_cost",
    "DATE": "dormant_since first_contact_on last_seen_on renewal_on",
    "BOOLEAN": "archived dual_control is_trial opted_in",
}
_WIDE = ", ".join(f"CAST(max(cell) FILTER (attribute = '{a}') AS {t}) AS {a}" for t, names in _COLUMNS.items() for a in names.split())
SQL["p3_wide"] = f"SELECT subject, {_WIDE} FROM ({SQL['p3_found']}) GROUP BY subject"
