"""Parts of a manifest, and records of functions."""

from sparkloom.functions.registry import describe
from sparkloom.plans.catalogue import engine
from sparkloom.session import Engine

DATA = "/root/testdata/sf0.001"


def test_used_tables(spark):
    eng = engine(spark, DATA)
    assert eng.used_tables('WITH a AS (SELECT * FROM "orders") SELECT * FROM a WHERE k IN (SELECT x FROM part)') == ["orders", "part"]
    assert eng.used_tables("SELECT * FROM elsewhere.public.orders, region") == ["region"]


def test_extracted_manifest_runs_the_statement(spark):
    eng = engine(spark, DATA)
    sql = "SELECT count(*) AS n FROM big_buyers"
    part = eng.extract(sql)
    assert set(part.views) == {"big_orders", "big_buyers"} and "orders" in part.models and "events" not in part.models
    assert all(set(r.models) <= set(part.models) for r in part.relationships.values())
    assert set(part.cubes) == {"order_cube"}
    small = Engine(spark, part)
    small.sources = eng.sources
    assert small.query(sql).collect() == eng.query(sql).collect()


def test_models_of_row_rules_come_along(spark):
    eng = engine(spark, DATA)
    assert "closed_orders" in eng.extract("SELECT * FROM guarded").models
    assert set(eng.extract("SELECT r_name FROM region").models) == {"region"}
    assert eng.extract("SELECT 1 AS x").models == {}


def test_function_records(spark):
    kinds = {n: [f.kind for f in describe(spark, n)] for n in ("upper", "sum", "row_number", "make_array", "countif", "no_such_function")}
    assert kinds == {"upper": ["scalar"], "sum": ["aggregate"], "row_number": ["window"], "make_array": ["scalar"], "countif": ["aggregate"], "no_such_function": []}
