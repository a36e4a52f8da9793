"""Relational queries, written in the dialect and run through its front end, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.parser import parse
from tidemark.session import Scratch
from tidemark.sources import TABLES, load
from tidemark.store.database import Database, tables_of


def database(spark: SparkSession, base: str, tables: list[str]) -> Database:
    """A database of its own folder that reads ``tables`` of ``base``."""
    db = Database(spark, Scratch(spark, "database").root)
    for t in tables:
        db.attach(t, load(spark, base, t))
    return db


def dialect(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = sorted(tables_of(parse(sql)) & set(TABLES))
    return lambda spark, base: database(spark, base, used).sql(sql)


#: name -> (dialect, SQL twin; None where the dialect's text is the twin's too)
_BOTH: dict[str, tuple[str, str | None]] = {
    "scan_filter_project": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_quantity < 10 AND l_returnflag = 'R'", None),
    "predicates_in_between_like": (
        "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size IN (1, 5, 9, 23) AND p_retailprice BETWEEN 900 AND 1500 AND p_name LIKE '%a%' AND p_type NOT LIKE 'X%' AND p_size NOT IN (9) AND p_partkey NOT BETWEEN 10 AND 20", None),
    "null_three_valued": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 WHERE NOT (o.o_orderstatus = 'F') OR o.o_orderkey IS NULL", None),
    "case_simple_searched": (
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS band FROM orders", None),
    "cast_matrix": (
        "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_discount * 100 :: FLOAT AS d, CAST(l_extendedprice AS INT) AS whole, CAST(l_linenumber AS TEXT) AS t, "
        "CAST(CAST(l_orderkey AS TEXT) AS INT) AS back, CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS midnight, CAST('t' AS BOOL) AS yes, CAST(l_linenumber AS BOOL) AS some FROM lineitem",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round(l_quantity) AS BIGINT) AS q, l_discount * CAST(100 AS DOUBLE) AS d, CAST(round(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS VARCHAR) AS t, "
        "l_orderkey AS back, CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS midnight, true AS yes, l_linenumber <> 0 AS some FROM lineitem"),
    "int_division_mod": (
        "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, MOD(l_orderkey, 7) AS r, -l_orderkey / 2 AS n, l_partkey / l_linenumber AS e FROM lineitem",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r, -(l_orderkey // 2) AS n, l_partkey // l_linenumber AS e FROM lineitem"),
    "string_funcs": (
        "SELECT c_custkey, LENGTH(c_name) AS n, UPPER(c_mktsegment) AS u, LOWER(c_name) AS l, INITCAP(c_mktsegment) AS i, TRIM('  ' || c_mktsegment || ' ') AS t, LTRIM('  x ') AS lt, RTRIM(' x  ') AS rt, SUBSTR(c_name, -3, 4) AS s, "
        "SUBSTRING(c_name, 3) AS s2, RIGHT(c_name, 3) AS r, REPEAT('ab', 2) AS rep, REVERSE(c_name) AS rev, REPLACE(c_name, 'Customer', 'C') AS repl, STRPOS(c_name, '0') AS p, POSITION(c_name, 'zz') AS p0 FROM customer",
        "SELECT c_custkey, length(c_name) AS n, upper(c_mktsegment) AS u, lower(c_name) AS l, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i, c_mktsegment AS t, 'x ' AS lt, ' x' AS rt, substring(c_name, 1, 4) AS s, "
        "substring(c_name, 3) AS s2, right(c_name, 3) AS r, 'abab' AS rep, reverse(c_name) AS rev, replace(c_name, 'Customer', 'C') AS repl, CAST(strpos(c_name, '0') AS BIGINT) AS p, CAST(0 AS BIGINT) AS p0 FROM customer"),
    "math_funcs": (
        "SELECT l_orderkey, l_linenumber, ABS(0 - l_linenumber) AS a, SIGN(l_discount - 0.05) AS sg, ROUND(l_extendedprice, 1) AS r1, ROUND(l_tax * 100) AS r0, TRUNC(l_extendedprice) AS t, FLOOR(l_extendedprice) AS f, CEIL(l_extendedprice) AS c, "
        "ROUND(POWER(l_quantity, 2), 3) AS p, ROUND(SQRT(l_quantity), 6) AS s, ROUND(EXP(l_discount), 6) AS e, ROUND(LN(l_quantity), 6) AS ln, ROUND(LOG(l_quantity), 6) AS lg, ROUND(LOG(2, l_quantity), 6) AS l2 FROM lineitem",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber AS BIGINT) AS a, CAST(sign(l_discount - 0.05::DOUBLE) AS DOUBLE) AS sg, sign(l_extendedprice) * floor(abs(l_extendedprice) * 10 + 0.5) / 10 AS r1, round(l_tax * 100) AS r0, trunc(l_extendedprice) AS t, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, "
        "round(pow(l_quantity, 2), 3) AS p, round(sqrt(l_quantity), 6) AS s, round(exp(l_discount), 6) AS e, round(ln(l_quantity), 6) AS ln, round(log10(l_quantity), 6) AS lg, round(ln(l_quantity) / ln(2), 6) AS l2 FROM lineitem"),
    "date_parts_trunc": (
        "SELECT o_orderkey, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(month FROM o_orderdate) AS m, DATE_PART('day', o_orderdate) AS d, EXTRACT(dow FROM o_orderdate) AS dow, EXTRACT(doy FROM o_orderdate) AS doy, EXTRACT(hour FROM o_orderdate) AS h, "
        "EXTRACT(second FROM o_orderdate) AS s, DATE_TRUNC('month', o_orderdate) AS mon, DATE_TRUNC('year', CAST(o_orderdate AS DATE)) AS yr FROM orders",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, hour(o_orderdate) AS h, second(o_orderdate) AS s, "
        "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS yr FROM orders"),
    "coalesce_nullif_greatest": (
        "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, NULLIF(c_nationkey, 3) AS nk, GREATEST(c_custkey, c_nationkey, NULL) AS g, LEAST(c_nationkey, 5, NULL) AS l FROM customer",
        "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CAST(nullif(c_nationkey, 3) AS BIGINT) AS nk, greatest(c_custkey, c_nationkey) AS g, CAST(least(c_nationkey, 5) AS BIGINT) AS l FROM customer"),
    "concat_null_rules": (
        "SELECT c_custkey, CONCAT(c_name, NULL, '/', c_nationkey) AS c, c_name || NULLIF(c_mktsegment, 'BUILDING') AS p, CONCAT(c_custkey, 1.0, 2.50) AS f FROM customer",
        "SELECT c_custkey, concat(c_name, '/', c_nationkey) AS c, c_name || nullif(c_mktsegment, 'BUILDING') AS p, concat(c_custkey, '1', '2.5') AS f FROM customer"),
    "inner_join": ("SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000", None),
    "left_join": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "right_join": ("SELECT o.o_orderkey, c.c_custkey, c.c_name FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'", None),
    "full_join": (
        "SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 12) AS a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) AS b ON a.k = b.k", None),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "comma_join": ("SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey", None),
    "using_join": (
        "SELECT a.k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a JOIN (SELECT r_regionkey AS k, r_name FROM region) AS b USING (k)", "SELECT CAST(n_regionkey AS BIGINT) AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "natural_join": (
        "SELECT a.k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a NATURAL LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey > 1) AS b",
        "SELECT CAST(n_regionkey AS BIGINT) AS k, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1"),
    "theta_join": (
        "SELECT a.r_name AS a, b.n_name AS b, c.s_suppkey AS s FROM region a JOIN nation b ON a.r_regionkey < b.n_regionkey JOIN supplier c ON c.s_nationkey = b.n_nationkey AND c.s_acctbal > 5000", None),
    "self_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "three_way_join": (
        "SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment", None),
    "agg_group_by": (
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_quantity), 4) AS avg_qty, MIN(l_shipdate) AS first, MAX(l_tax) AS tax, COUNT(*) AS n "
        "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, AVG(l_quantity) AS a, MIN(l_shipdate) AS m, VAR_POP(l_tax) AS v FROM lineitem WHERE l_quantity < 0",
        "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_shipdate) AS m, var_pop(l_tax) AS v FROM lineitem WHERE l_quantity < 0"),
    "agg_distinct": (
        "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS supp, COUNT(DISTINCT l_linenumber) AS lines, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a, ROUND(STDDEV(DISTINCT l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supp, count(DISTINCT l_linenumber) AS lines, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, CAST(sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber) AS BIGINT) AS a, round(stddev_samp(DISTINCT l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag"),
    "agg_stats": (
        "SELECT l_linestatus, ROUND(VAR_POP(l_quantity), 4) AS vp, ROUND(VAR_SAMP(l_quantity), 4) AS vs, ROUND(VARIANCE(l_tax), 8) AS v, ROUND(STDDEV_POP(l_discount), 8) AS sp, ROUND(STDDEV_SAMP(l_discount), 8) AS ss, ROUND(STDDEV(l_extendedprice), 2) AS sd FROM lineitem GROUP BY l_linestatus", None),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 1000000 AND COUNT(*) > 5", None),
    "avg_int_trunc": ("SELECT o_orderpriority, AVG(o_custkey) AS a, SUM(o_custkey) * 2 AS s, COUNT(o_orderkey) AS n FROM orders GROUP BY o_orderpriority",
        "SELECT o_orderpriority, CAST(sum(o_custkey) // count(o_custkey) AS BIGINT) AS a, CAST(sum(o_custkey) * 2 AS BIGINT) AS s, count(o_orderkey) AS n FROM orders GROUP BY o_orderpriority"),
    "group_by_expr": ("SELECT EXTRACT(year FROM o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(year FROM o_orderdate)", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "win_row_number": ("SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders", None),
    "win_rank_dense": ("SELECT s_suppkey, RANK() OVER (ORDER BY s_nationkey) AS r, DENSE_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS d FROM supplier", None),
    "win_lag_lead": (
        "SELECT event_id, user_id, LAG(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, LEAD(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later, LAG(event_id, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS neg FROM events", None),
    "win_agg_partition": (
        "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS total, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS latest FROM orders",
        "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderdate) OVER (PARTITION BY o_custkey) AS latest FROM orders"),
    "win_distinct_agg": (
        "SELECT event_id, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds FROM events", "SELECT event_id, kinds FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) USING (user_id)"),
    "order_nulls": (
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders ORDER BY NULLIF(o_orderstatus, 'F') DESC, o_orderkey LIMIT 50",
        "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey LIMIT 50"),
    "order_ordinal_alias": ("SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, 1 LIMIT 20", None),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", None),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "setop_left_assoc": (
        "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
        "SELECT CAST(k AS BIGINT) AS k FROM ((SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer) INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
    "scalar_subquery": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)", None),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", None),
    "not_in_null": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(s_nationkey, 1) FROM supplier)", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "exists": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", None),
    "not_exists": ("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "correlated_scalar": (
        "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c WHERE c.c_acctbal > (SELECT AVG(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)", None),
    "derived_table": ("SELECT t.y, MAX(t.n) AS n FROM (SELECT EXTRACT(year FROM o_orderdate) AS y, o_custkey, COUNT(*) AS n FROM orders GROUP BY EXTRACT(year FROM o_orderdate), o_custkey) AS t GROUP BY t.y", None),
    "cte": ("WITH big AS (SELECT o_custkey AS k, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c.c_name, ROUND(big.s, 2) AS s FROM customer c JOIN big ON big.k = c.c_custkey WHERE big.s > 1000000", None),
    "cte_chain": (
        "WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey), b AS (SELECT n_regionkey AS r, SUM(a.n) AS n FROM nation JOIN a ON a.k = n_nationkey GROUP BY n_regionkey) SELECT r_name, n FROM region JOIN b ON b.r = r_regionkey",
        "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey), b AS (SELECT n_regionkey AS r, CAST(sum(a.n) AS BIGINT) AS n FROM nation JOIN a ON a.k = n_nationkey GROUP BY n_regionkey) SELECT r_name, n FROM region JOIN b ON b.r = r_regionkey"),
    "recursive_count": (
        "WITH RECURSIVE n AS (SELECT MIN(r_regionkey) AS x FROM region UNION ALL SELECT x + 1 FROM n WHERE x < 12) SELECT x FROM n", "WITH RECURSIVE n AS (SELECT CAST(min(r_regionkey) AS BIGINT) AS x FROM region UNION ALL SELECT x + 1 FROM n WHERE x < 12) SELECT x FROM n"),
    "recursive_closure": (
        "WITH RECURSIVE reach AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation UNION SELECT r.a, n.n_regionkey FROM reach r JOIN nation n ON n.n_nationkey = r.b) SELECT a, b FROM reach",
        "WITH RECURSIVE reach AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION SELECT r.a, n.n_regionkey FROM reach r JOIN nation n ON n.n_nationkey = r.b) SELECT a, b FROM reach"),
    "json_get": ("SELECT event_id, props :: JSON -> 'k' AS k, props :: JSON -> 'missing' AS m FROM events", "SELECT event_id, CAST(props::JSON -> 'k' AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS m FROM events"),
    "json_get_text": ("SELECT event_id, props :: JSON ->> 'k' AS k, CAST(props :: JSON ->> 'k' AS INT) AS n FROM events", "SELECT event_id, props::JSON ->> 'k' AS k, CAST(props::JSON ->> 'k' AS BIGINT) AS n FROM events"),
    "decimal_exact": (
        "SELECT l_returnflag, SUM(CAST(CAST(ROUND(l_extendedprice * 100) AS INT) AS DECIMAL(18, 2))) AS cents, AVG(CAST(l_linenumber AS DECIMAL(10, 2))) AS a, DECIMAL '0.1' + DECIMAL '0.2' AS x, DECIMAL '2' / DECIMAL '3' AS q FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DECIMAL(38, 2)) AS cents, CAST(sum(l_linenumber) * 1000000 // count(*) AS DECIMAL(38, 0)) * CAST(0.000001 AS DECIMAL(7, 6)) AS a, CAST(0.3 AS DECIMAL(38, 1)) AS x, CAST(0.666666 AS DECIMAL(38, 6)) AS q FROM lineitem GROUP BY l_returnflag"),
    "analytics_pricing": (
        "SELECT n.n_name, EXTRACT(year FROM o.o_orderdate) AS y, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, COUNT(DISTINCT o.o_custkey) AS buyers FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE l.l_discount BETWEEN 0.02 AND 0.08 GROUP BY n.n_name, EXTRACT(year FROM o.o_orderdate)", None),
    "like_no_escape": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#%' AND p_name NOT LIKE '%\\%' AND p_type LIKE '_%'", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#%' AND p_name NOT LIKE '%\\%' AND p_type LIKE '_%'"),
    "info_schema_columns": (
        "SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name = 'region'", "SELECT * FROM (VALUES ('region', 'r_regionkey', CAST(1 AS BIGINT), 'INT'), ('region', 'r_name', CAST(2 AS BIGINT), 'TEXT')) AS t(table_name, column_name, ordinal_position, data_type)"),
}


def info_schema_columns(spark: SparkSession, base: str) -> DataFrame:
    return database(spark, base, ["region"]).sql(_BOTH["info_schema_columns"][0])


QUERIES = {name: dialect(sql) for name, (sql, _) in _BOTH.items()} | {"info_schema_columns": info_schema_columns}
SQL = {name: twin or sql for name, (sql, twin) in _BOTH.items()}
#: The dialect's whole numbers all have 64 bits; the twins' columns that have fewer are widened.
_WIDER = {
    "scan_filter_project": "l_linenumber", "predicates_in_between_like": "p_size", "case_simple_searched": "band", "topk": "l_linenumber", "union": "k", "union_all": "k", "intersect_all": "k", "except_all": "k",
}
SQL |= {name: f"SELECT * REPLACE (CAST({c} AS BIGINT) AS {c}) FROM ({SQL[name]})" for name, c in _WIDER.items()}
