"""Syntax of the semantic SQL dialect in Spark's syntax."""

import pytest

from sparkloom.functions.registry import translate
from sparkloom.plans.dialect import DialectError, to_spark
from sparkloom.session import Engine


@pytest.mark.parametrize(
    ("own", "spark_sql"),
    [
        ('SELECT "A b", t."c" FROM "t"', "SELECT `A b`, `t`.`c` FROM `t`"),
        ("SELECT 'ORDER BY \"x\"' -- ORDER BY a\n", "SELECT 'ORDER BY \"x\"' -- ORDER BY a\n"),
        ("SELECT a FROM t ORDER BY a, b DESC NULLS FIRST LIMIT 1", "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST LIMIT 1"),
        ("sum(a) OVER (ORDER BY b ROWS 1 PRECEDING)", "sum(a) OVER (ORDER BY b NULLS LAST ROWS 1 PRECEDING)"),
        ("percentile_cont(0.5) WITHIN GROUP (ORDER BY x)", "percentile_cont(0.5) WITHIN GROUP (ORDER BY x)"),
        ("SELECT x FROM t WHERE a IS DISTINCT FROM range", "SELECT x FROM t WHERE a IS DISTINCT FROM range"),
        ("SELECT ~a FROM t WHERE b ~ 'x'", "SELECT ~a FROM t WHERE b  RLIKE  'x'"),
        ("a = SOME (SELECT b FROM t)", "a  IN (SELECT b FROM t)"),
        ("SELECT * FROM unnest(a)", "SELECT * FROM explode(a)"),
        ("a::varchar || CAST(b AS text)", "a::string || CAST(b AS string)"),
    ],
)
def test_syntax(own, spark_sql):
    assert to_spark(own) == spark_sql


def test_left_side_of_a_comparison_must_be_simple():
    with pytest.raises(DialectError):
        to_spark("a + b >= ALL (SELECT c FROM t)")
    assert "coalesce((a + b) >= " in to_spark("(a + b) >= ALL (SELECT c FROM t)")


def test_a_quoted_call_is_sparks_own():
    assert translate("array_sort(a)") == "sort_array(a)"
    assert translate("`array_sort`(a)") == "`array_sort`(a)"


def _rows(spark, sql):
    values = spark.createDataFrame([(1, 5), (2, None), (3, 4)], "k int, v int")
    eng = Engine(spark).register("t", values)
    eng.load({"catalog": "cat", "schema": "own", "models": [{"name": "t", "tableReference": {"table": "t"}, "columns": [
        {"name": "k", "type": "int"}, {"name": "v", "type": "int"}, {"name": "twice", "type": "int", "isCalculated": True, "expression": '"v" * 2'}]}]})
    return [tuple(r) for r in eng.query(sql).collect()]


def test_comparison_with_no_rows_and_with_nulls(spark):
    none, nulls = "(SELECT v FROM t WHERE k > 9)", "(SELECT v FROM t)"
    assert len(_rows(spark, f"SELECT k FROM t WHERE k > ALL {none}")) == 3
    assert _rows(spark, f"SELECT k FROM t WHERE k > ANY {none}") == []
    assert _rows(spark, f"SELECT k FROM t WHERE k < ALL {nulls}") == []
    assert len(_rows(spark, f"SELECT k FROM t WHERE k < ANY {nulls}")) == 3
    assert len(_rows(spark, f"SELECT k FROM t WHERE k <> ANY {nulls}")) == 3
    assert _rows(spark, "SELECT k FROM t WHERE v = ALL (SELECT v FROM t WHERE k = 1)") == [(1,)]


def test_ordered_aggregates_sort_nulls_last(spark):
    assert _rows(spark, "SELECT array_agg(k ORDER BY v) AS a FROM t") == [([3, 1, 2],)]
    assert _rows(spark, "SELECT array_agg(k ORDER BY v DESC NULLS FIRST) AS a FROM t") == [([2, 1, 3],)]
    both = "SELECT first_value(k ORDER BY v {0}) AS a, last_value(k ORDER BY v {0}) AS b FROM t"
    assert _rows(spark, both.format("")) == [(3, 2)]
    assert _rows(spark, both.format("DESC")) == [(1, 2)]
    assert _rows(spark, both.format("NULLS FIRST")) == [(2, 1)]
    assert _rows(spark, "SELECT last_value(k ORDER BY v DESC, k ASC) AS a FROM t") == [(2,)]


def test_ordered_aggregates_take_the_least_of_equal_rows(spark):
    """As the SQL's arg_max and arg_min do, which keep the first row of a table in key order."""
    text = "CASE k WHEN 1 THEN 'ab' WHEN 2 THEN 'b' ELSE 'a' END"
    for value, least in (("k", 1), ("k - 2", -1), ("k * 0.5", 0.5), (text, "a"), ("nullif(k, 1)", 2)):
        for order in ("k * 0", "k * 0 DESC", "k * 0, k * 0 DESC"):
            got = _rows(spark, f"SELECT first_value({value} ORDER BY {order}) AS a, last_value({value} ORDER BY {order}) AS b FROM t")
            assert got == [(least, least)], (value, order)


def test_qualified_names_and_quoted_manifest_expressions(spark):
    assert _rows(spark, 'SELECT cat.own.t.twice FROM cat.own."t" WHERE own.t.k = 1') == [(10,)]
    assert _rows(spark, "SELECT k FROM t ORDER BY twice") == [(3,), (1,), (2,)]
    assert _rows(spark, "SELECT table_schema, table_name FROM information_schema.tables") == [("own", "t")]


def test_series(spark):
    assert _rows(spark, "SELECT value FROM generate_series(2)") == [(0,), (1,), (2,)]
    assert _rows(spark, "SELECT k, x FROM t, range(k, 3) AS r(x) ORDER BY k, x") == [(1, 1), (1, 2), (2, 2)]
    assert _rows(spark, "SELECT range(0) AS a, range(3, 1) AS b, range(5, 0, -2) AS c") == [([], [], [5, 3, 1])]
