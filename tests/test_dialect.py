import datetime as dt
from decimal import Decimal

import pytest

from tidemark.plans.lexer import SqlError
from tidemark.plans.parser import parse, split_statements
from tidemark.plans.syntax import Binary, SetOp, Unary
from tidemark.store.database import Database


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    d = Database(spark, f"file://{tmp_path_factory.mktemp('dialect')}")
    one = spark.createDataFrame([(1,)], "n long")
    d.attach("one", one)
    d.attach("emp", spark.createDataFrame([("a", "eng", 100), ("b", "eng", 60), ("c", "sales", 80), ("d", "sales", 40)], "name string, dept string, salary long"))
    d.attach("dept", spark.createDataFrame([("eng", "west"), ("sales", "east")], "name string, region string"))
    d.attach("e3", spark.createDataFrame([(1, 1, "alice"), (2, 2, "bob"), (3, None, "carol")], "id long, dept long, name string"))
    d.attach("d3", spark.createDataFrame([(1, "eng"), (3, "ops")], "id long, label string"))
    d.attach("nums", spark.createDataFrame([(2,), (None,), (1,)], "a long"))
    d.attach("x", spark.createDataFrame([(v,) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "x long"))
    d.attach("edges", spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "src long, dst long"))
    d.attach("a", spark.createDataFrame([(1,), (2,), (3,), (3,)], "x long"))
    d.attach("b", spark.createDataFrame([(3,), (4,), (3,)], "y long"))
    return d


def q(db, sql, params=None):
    return db.execute(sql, params).rows()


def one(db, expr, params=None):
    return q(db, f"SELECT {expr} FROM one", params)[0][0]


@pytest.mark.parametrize(
    "expr, want",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("2 + 3 * 4", 14), ("MOD(-7, 3)", -1), ("CAST(2.7 AS INT)", 3), ("CAST(-2.5 AS INT)", -3), ("' 42 ' :: INT", 42), ("CAST(TRUE AS INT)", 1), ("1 :: BOOL", True), ("'F' :: BOOL", False),
        ("1.0 || ''", "1"), ("CONCAT(1.5, NULL, 'x')", "1.5x"), ("100000000000000000000.0 || ''", "100000000000000000000"), ("'a' || NULL", None), ("0.1 || ''", "0.1"), ("0.00001 || ''", "0.00001"),
        ("TRIM('  \t x \n')", "x"), ("SUBSTR('hello', -2, 2)", "he"), ("SUBSTR('hello', 2)", "ello"), ("SUBSTR('hello', 2, -1)", ""), ("RIGHT('abc', -1)", ""), ("RIGHT('abc', 2)", "bc"), ("REPLACE('abc', '', '-')", "-a-b-c-"), ("POSITION('hello', 'l')", 3),
        ("STRPOS('x', 'y')", 0), ("INITCAP('a\tb  cD')", "A\tB  Cd"), ("LENGTH('日本')", 2), ("REVERSE('ab')", "ba"), ("REPEAT('ab', 0)", ""), ("LOG(100)", 2.0), ("LOG(2, 8)", 3.0), ("LN(1)", 0.0), ("FLOOR(1.5)", 1.0), ("CEIL(2)", 2), ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0),
        ("ROUND(2.34567, 2)", 2.35), ("TRUNC(-2.567, 1)", -2.5), ("SIGN(-3)", -1), ("ABS(-7)", 7), ("GREATEST(1, NULL, 3)", 3), ("LEAST(2, 1.5)", 1.5), ("NULLIF(1, 1)", None), ("COALESCE(NULL, 'z')", "z"),
        ("EXTRACT(dow FROM DATE '2024-01-14')", 0), ("EXTRACT(doy FROM DATE '2024-03-01')", 61), ("DATE_PART('second', TIMESTAMP '2024-01-01 00:00:59.9')", 59), ("DATE_TRUNC('month', DATE '2024-03-15')", dt.datetime(2024, 3, 1)), ("CAST(TIMESTAMP '2024-01-15 23:59:59' AS DATE)", dt.date(2024, 1, 15)),
        ("1 IN (1, NULL)", True), ("2 IN (1, NULL)", None), ("2 NOT IN (1, NULL)", None), ("NULL = NULL", None), ("NULL IS NULL", True), ("NOT (1 = 2)", True), ("NOT 1 = 2", True), ("1 BETWEEN 1 AND 2 AND TRUE", True), ("5 NOT BETWEEN 1 AND 2", True), ("FALSE AND NULL", False), ("TRUE OR NULL", True),
        ("'a%b' LIKE 'a\\%b'", False), ("'a\\xb' LIKE 'a\\%b'", True), ("'abc' LIKE 'a_c'", True), ("'abc' NOT LIKE '%z%'", True), ("CASE 3 WHEN NULL THEN 'n' WHEN 3 THEN 't' END", "t"), ("CASE WHEN NULL THEN 1 END", None),
        ("DECIMAL '0.1' + DECIMAL '0.2'", Decimal("0.3")), ("DECIMAL '2' / DECIMAL '3'", Decimal("0.666666")), ("DECIMAL '-2' / DECIMAL '3'", Decimal("-0.666666")), ("DECIMAL '1.50' * DECIMAL '2.5'", Decimal("3.750")), ("DECIMAL '12.5' :: INT", 13), ("DECIMAL '1.1' + 1", Decimal("2.1")), ("'1.25' :: DECIMAL(10, 1)", Decimal("1.3")),
        ("""'{"a": {"b": [1, 2, "z"]}}' :: JSON -> 'a' -> 'b' -> -1""", '"z"'), ("""'{"a": {"b": [1, 2, "z"]}}' :: JSON -> 'a' -> 'b' ->> -1""", "z"), ("""'{"n": null}' :: JSON ->> 'n'""", "null"), ("""'{"n": 1}' :: JSON ->> 'm'""", None), ("""'[1, 2]' :: JSON -> 0""", "1"), ("""'[1]' :: JSON -> 5""", None), ("""'{"it''s": 2}' :: JSON ->> 'it''s'""", "2"), ("""'{"a": {"b": 1}}' :: JSON ->> 'a'""", '{"b":1}'),
        ("VECTOR '[0, 0]' <-> '[3, 4]'", 5.0), ("VECTOR '[0, 0]' <=> VECTOR '[0, 0]'", 0.0), ("VECTOR '[0, 0]' <=> '[1, 0]'", 1.0), ("VECTOR '[1, 2]' <#> '[3, 4]'", -11.0), ("VECTOR '[1, 2]' <+> '[3, 5]'", 5.0), ("INNER_PRODUCT(VECTOR '[1, 2]', VECTOR '[3, 4]')", 11.0), ("VECTOR_DIMS(VECTOR '[1, 2, 3]')", 3), ("L2_NORM(VECTOR '[3, 4]')", 5.0),
        ("current_user", "root"), ("session_user()", "root"), ("'it''s'", "it's"), ("$1 + 1", 42), ("-(-3)", 3),
    ],
)
def test_expressions(db, expr, want):
    got = one(db, expr, [41])
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("expr", ["LN(-1)", "SQRT(-1)"])
def test_nan(db, expr):
    assert one(db, expr) != one(db, expr)


@pytest.mark.parametrize("expr", ["1 / 0", "MOD(1, 0)", "'x' :: INT", "'yes' :: BOOL", "'{' :: JSON", "VECTOR '[1]' <-> '[1, 2]'", "'nope' :: JSON -> 'a'"])
def test_errors_when_run(db, expr):
    with pytest.raises(Exception):
        one(db, expr)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT '1' = 1 FROM one", "SELECT -DECIMAL '1' FROM one", "SELECT zz FROM one", "SELECT n FROM one, nums, one o2 WHERE o.n = 1", "SELECT nope(1) FROM one", "SELECT ABS(DECIMAL '1') FROM one", "SELECT 1", "SELECT n FROM (SELECT n FROM one)", "SELECT * FROM missing",
        "SELECT a FROM nums UNION SELECT src, dst FROM edges", "SELECT n FROM one WHERE n", "SELECT RANK() FROM one", "SELECT ROUND(1.5) OVER () FROM one", "SELECT n FROM one ORDER BY 3", "SELECT (SELECT src, dst FROM edges) FROM one", "SELECT n FROM one LIMIT x", "SELECT 'a FROM one", "SELECT n n n FROM one", "DROP INDEX i", "SELECT id FROM e3 JOIN d3 ON TRUE",
    ],
)
def test_errors_when_read(db, sql):
    with pytest.raises(SqlError):
        db.execute(sql)


def test_precedence():
    e = parse("SELECT NOT a = 1 OR b || c < d + 1 * 2 FROM t").body.items[0][0]
    assert isinstance(e, Binary) and e.op == "or" and isinstance(e.left, Unary)
    assert e.right.op == "<" and e.right.left.op == "||" and e.right.right.op == "+" and e.right.right.right.op == "*"
    s = parse("SELECT 1 AS a FROM t UNION SELECT 2 FROM t INTERSECT SELECT 3 FROM t").body
    assert isinstance(s, SetOp) and s.op == "intersect" and s.left.op == "union"
    assert split_statements("SELECT ';' FROM t; -- c ; d\nSELECT 2 FROM t;") == ["SELECT ';' FROM t", "-- c ; d\nSELECT 2 FROM t"]


def test_soft_words_are_names(spark, tmp_path):
    d = Database(spark, f"file://{tmp_path}")
    d.execute("CREATE TABLE t (date DATE, \"order\" INT, header TEXT, nulls INT)")
    d.execute("INSERT INTO t VALUES ('2024-01-15', 1, 'h', NULL)")
    assert q(d, 'SELECT date, "order", header AS right, nulls FROM t') == [(dt.date(2024, 1, 15), 1, "h", None)]


def test_aggregates(db):
    assert q(db, "SELECT VAR_POP(x), STDDEV_POP(x), VAR_SAMP(x), VARIANCE(x) FROM x") == [(4.0, 2.0, 32 / 7, 32 / 7)]
    assert q(db, "SELECT COUNT(*), SUM(x), AVG(x), MIN(x), STDDEV(x) FROM x WHERE x > 99") == [(0, None, None, None, None)]
    assert q(db, "SELECT STDDEV(x), VAR_POP(x) FROM x WHERE x = 9") == [(None, 0.0)]
    assert q(db, "SELECT AVG(x), SUM(DISTINCT x), COUNT(DISTINCT x), AVG(DISTINCT x) FROM x") == [(5, 27, 5, 5)]
    assert q(db, "SELECT SUM(name), AVG(dept) FROM emp") == [(None, None)]
    assert q(db, "SELECT dept, SUM(salary) * 2 AS s FROM emp GROUP BY dept HAVING MAX(salary) > 80 ORDER BY dept") == [("eng", 320)]
    assert q(db, "SELECT AVG(DECIMAL '0.1') FROM x") == [(Decimal("0.1"),)]


def test_joins(db):
    assert q(db, "SELECT e.name, d.label FROM e3 e RIGHT JOIN d3 d ON e.dept = d.id ORDER BY d.id") == [("alice", "eng"), (None, "ops")]
    assert len(q(db, "SELECT e.name, d.label FROM e3 e FULL OUTER JOIN d3 d ON e.dept = d.id")) == 4
    assert q(db, "SELECT * FROM (SELECT id, name FROM e3) AS p NATURAL JOIN d3 ORDER BY 1") == [(1, "alice", 1, "eng"), (3, "carol", 3, "ops")]
    assert len(q(db, "SELECT p.name FROM emp p NATURAL JOIN one")) == 4
    assert q(db, "SELECT p.name FROM e3 p JOIN d3 USING (id) ORDER BY 1") == [("alice",), ("carol",)]
    assert q(db, "SELECT x.id, y.id FROM e3 x JOIN e3 y ON x.id < y.id AND y.id > 2 ORDER BY 1") == [(1, 3), (2, 3)]


def test_order_of_nulls(db):
    assert q(db, "SELECT a FROM nums ORDER BY a") == [(1,), (2,), (None,)]
    assert q(db, "SELECT a FROM nums ORDER BY a DESC") == [(None,), (2,), (1,)]
    assert q(db, "SELECT a FROM nums ORDER BY a ASC NULLS FIRST LIMIT 1") == [(None,)]
    assert q(db, "SELECT a * 2 AS a2 FROM nums ORDER BY a DESC NULLS LAST LIMIT 1 OFFSET 1") == [(2,)]


def test_set_operations(db):
    assert q(db, "SELECT x FROM a UNION SELECT y FROM b ORDER BY x") == [(1,), (2,), (3,), (4,)]
    assert len(q(db, "SELECT x FROM a UNION ALL SELECT y FROM b")) == 7
    assert q(db, "SELECT x FROM a INTERSECT ALL SELECT y FROM b") == [(3,), (3,)]
    assert q(db, "SELECT x FROM a EXCEPT ALL SELECT y FROM b WHERE y > 3 ORDER BY 1") == [(1,), (2,), (3,), (3,)]
    assert q(db, "SELECT x FROM a UNION SELECT y FROM b INTERSECT SELECT y FROM b ORDER BY 1 DESC") == [(4,), (3,)]


def test_windows(db):
    assert q(db, "SELECT x, SUM(x) OVER (ORDER BY x), COUNT(DISTINCT x) OVER (), SUM(DISTINCT x) OVER (), ROW_NUMBER() OVER (ORDER BY x DESC) FROM x ORDER BY x LIMIT 1") == [(2, 40, 5, 27, 8)]
    assert q(db, "SELECT x, RANK() OVER (ORDER BY x), DENSE_RANK() OVER (ORDER BY x), LAG(x, 1, -1) OVER (ORDER BY x), LEAD(x, -1) OVER (ORDER BY x) FROM x ORDER BY x, 2 LIMIT 2") == [(2, 1, 1, -1, None), (4, 2, 2, 2, 2)]
    assert q(db, "SELECT a, ROW_NUMBER() OVER (ORDER BY a) FROM nums ORDER BY 2") == [(1, 1), (2, 2), (None, 3)]


def test_subqueries(db):
    assert q(db, "SELECT name FROM emp WHERE salary > (SELECT AVG(salary) FROM emp) ORDER BY name") == [("a",), ("c",)]
    assert q(db, "SELECT name FROM emp e WHERE salary = (SELECT MAX(f.salary) FROM emp f WHERE f.dept = e.dept) ORDER BY name") == [("a",), ("c",)]
    assert q(db, "SELECT name FROM emp WHERE dept IN (SELECT name FROM dept WHERE region = 'west') AND EXISTS (SELECT n FROM one) ORDER BY name") == [("a",), ("b",)]
    assert q(db, "SELECT n FROM one WHERE 5 NOT IN (SELECT a FROM nums)") == []
    assert q(db, "SELECT n FROM one WHERE 5 NOT IN (SELECT a FROM nums WHERE a > 99)") == [(1,)]
    with pytest.raises(Exception):
        q(db, "SELECT (SELECT x FROM x) FROM one")


def test_recursion(db):
    closure = "WITH RECURSIVE r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst) SELECT dst FROM r WHERE src = 1 ORDER BY dst"
    assert q(db, closure) == [(2,), (3,), (4,)]
    assert q(db, "WITH RECURSIVE r AS (SELECT n FROM one UNION ALL SELECT n + 1 FROM r WHERE n < 120) SELECT COUNT(*), MAX(n) FROM r") == [(120, 120)]
    assert q(db, "WITH u AS (SELECT x FROM a), v AS (SELECT x + 1 AS y FROM u) SELECT MAX(y) FROM v") == [(4,)]


def test_duplicate_names_stay_readable(db):
    df = db.sql("SELECT * FROM e3 JOIN d3 ON e3.dept = d3.id")
    assert df.columns == ["id", "dept", "name", "id_2", "label"]
    assert df.select("id_2").collect()[0][0] == 1
