"""The semantic layer: construction, access, cubes, graph, policy, functions, sources."""

import json

import pytest

from sparkloom.functions.registry import AGGREGATE, SCALAR, translate
from sparkloom.operators import cube, policy, recall
from sparkloom.operators.graph import GraphError
from sparkloom.plans import access, exprs, manifest
from sparkloom.plans.catalogue import engine, oracle_sql, queries
from sparkloom.plans.catalogue import manifest as demo
from sparkloom.sources import readers

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def eng(spark):
    return engine(spark, DATA)


@pytest.mark.parametrize("name", ["to_one_three_hops", "two_roles_of_one_model", "to_many_without_children", "view_over_view", "graph_fanout_repeat", "graph_bridge_weighted", "graph_multi_fact", "cube_grain_measures", "functions_arrays"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({oracle_sql()[name]})").fetchall()
    norm = lambda rows: sorted((tuple(round(float(x), 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(want)


def test_calculated_columns_keep_row_count(eng):
    assert eng.model("customer", ["c_custkey", "place", "total_spend", "closed_count"]).count() == eng.model("customer", ["c_custkey"]).count()


def test_only_needed_joins_are_built(eng):
    plan = eng.query("SELECT count(*) AS n FROM lineitem")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" in plan


def test_denied_column_is_named(eng):
    with pytest.raises(access.AccessError, match="senior"):
        eng.query("SELECT c_acctbal FROM guarded", properties={"level": 1})
    assert "c_acctbal" in eng.query("SELECT * FROM guarded", properties={"level": 4}).columns
    assert "c_acctbal" not in eng.query("SELECT * FROM guarded", properties={"level": 2}).columns


def test_rule_values_must_be_literals(eng):
    with pytest.raises(access.AccessError):
        eng.query("SELECT * FROM guarded", properties={"nation": "(SELECT 1)"})
    with pytest.raises(access.AccessError):
        eng.query("SELECT * FROM guarded", properties={"nation": " "})
    with pytest.raises(access.AccessError):
        access.validate_rule(manifest.AccessRule("r", (), "a = @missing"))
    required = manifest.AccessRule("r", ({"name": "p", "required": True},), "a = @p")
    with pytest.raises(access.AccessError):
        access.row_condition(required, {})


@pytest.mark.parametrize("op,got,want,seen", [("EQUALS", "'a'", "'a'", True), ("EQUALS", "1", "'1'", False), ("NOT_EQUALS", "1", "'1'", True), ("GREATER_THAN", "3", "2", True), ("LESS_THAN_OR_EQUALS", "3", "2", False)])
def test_column_rule(op, got, want, seen):
    rule = manifest.AccessRule("r", ({"name": "p"},), operator=op, threshold=want)
    assert access.column_visible(rule, {"P": got}) is seen
    assert access.column_visible(rule, {})


def test_manifest_errors():
    def broken(change):
        m = json.loads(json.dumps(demo()))
        change(m)
        with pytest.raises(manifest.ManifestError) as e:
            manifest.load(m)
        return e.value.code

    assert broken(lambda m: m["models"][0].update(refSql="SELECT 1")) == "MODEL_SOURCE_INVALID"
    assert broken(lambda m: m["models"][0]["columns"].append({"name": "R_NAME"})) == "COLUMN_CASE_COLLISION"
    assert broken(lambda m: m["relationships"][0].update(condition="nation.n_regionkey > region.r_regionkey")) == "RELATIONSHIP_CONDITION_UNSAFE"
    assert broken(lambda m: m["relationships"][0].update(models=["nation", "none"])) == "RELATIONSHIP_NODE_MISSING"
    assert broken(lambda m: m["cubes"][0]["measures"].extend([{"name": "x", "expression": "y + 1"}, {"name": "y", "expression": "x + 1"}])) == "MEASURE_CYCLE"
    assert broken(lambda m: m["cubes"][0].update(hierarchies={"h": ["nope"]})) == "HIERARCHY_LEVEL_UNKNOWN"
    assert broken(lambda m: m.update(layoutVersion=9)) == "LAYOUT_VERSION_UNSUPPORTED"


def test_types():
    from pyspark.sql import types as T

    assert manifest.spark_type("INT8") == T.LongType()
    assert manifest.spark_type("array<struct<a int, b varchar>>") == T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]))
    assert manifest.spark_type("decimal(12,2)") == T.DecimalType(12, 2)
    assert manifest.spark_type("whatever") == T.StringType()


def test_expressions():
    assert exprs.has_aggregate("sum(a.b)") and not exprs.has_aggregate("sum(x) over (partition by y)")
    assert exprs.paths("a.b + 'a.c' + `d e`.f") == [("a", "b"), ("d e", "f")]
    assert exprs.bind_properties("a = @p and b = '@p'", {"P": "'x'"}) == "a = 'x' and b = '@p'"


def test_cube_filters_reject_bad_values(eng):
    for f in ({"dimension": "status", "operator": "in", "value": []}, {"dimension": "status", "operator": "eq"}, {"dimension": "status", "operator": "odd", "value": 1}):
        with pytest.raises(manifest.ManifestError):
            eng.cube_query({"cube": "order_cube", "measures": ["orders_n"], "filters": [f]})
    assert cube.parse_filter("status:in:F,O") == cube.CubeFilter("status", "in", ["F", "O"])
    assert cube.parse_time("at:day:2024-01-01,2024-02-01").date_range == ("2024-01-01", "2024-02-01")


@pytest.mark.parametrize("request_,code", [
    ({"metrics": ["order_revenue"], "dimensions": ["return_flag"]}, "GRAPH_FANOUT_ALLOCATION_REQUIRED"),
    ({"metrics": ["average_price"], "dimensions": ["brand"], "fanoutMode": "repeat"}, "GRAPH_METRIC_NOT_ADDITIVE_FOR_FANOUT"),
    ({"metrics": ["average_price"], "dimensions": ["return_flag"]}, "GRAPH_METRIC_DIMENSION_BLOCKED"),
    ({"metrics": ["none"]}, "GRAPH_METRIC_NOT_FOUND"),
    ({"metrics": ["order_n"], "dimensions": ["none"]}, "GRAPH_DIMENSION_NOT_FOUND"),
    ({"metrics": ["order_n"], "dimensions": ["part.none"]}, "GRAPH_ATTRIBUTE_FIELD_NOT_FOUND"),
    ({"metrics": ["order_n"], "odd": 1}, "GRAPH_REQUEST_FIELD_UNKNOWN"),
    ({"metrics": ["order_n"], "fanoutMode": "x"}, "GRAPH_FANOUT_MODE_INVALID"),
    ({}, "GRAPH_FACT_REQUIRED"),
    ({"metrics": ["event_n"], "dimensions": ["event_kind"]}, "GRAPH_PARTITION_RANGE_REQUIRED"),
    ({"metrics": ["order_n"], "calculations": [{"name": "x", "expression": "sum(order_n)"}]}, "GRAPH_POST_CALCULATION_REAGGREGATION_FORBIDDEN"),
])
def test_graph_fails_closed(eng, request_, code):
    with pytest.raises(GraphError) as e:
        eng.graph_query(request_)
    assert e.value.code == code


def test_policy(spark):
    known = {"orders"}
    strict = policy.Policy(strict=True, denied_functions=frozenset({"pow"}))
    policy.check(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a, orders WHERE x IN (SELECT o_custkey FROM orders)", strict, known)
    for sql, code in (("SELECT * FROM hidden", "TABLE_NOT_ALLOWED"), ("SELECT * FROM orders WHERE x IN (SELECT y FROM hidden)", "TABLE_NOT_ALLOWED"), ("SELECT power(1, 2)", "FUNCTION_DENIED"), ("DROP TABLE orders", "READ_ONLY"), ("SELECT 1; SELECT 2", "SINGLE_STATEMENT_REQUIRED"), ("SELECT * FROM range(3)", "TABLE_FUNCTION_DENIED")):
        with pytest.raises(policy.PolicyError) as e:
            policy.check(spark, sql, strict, known)
        assert e.value.code == code, sql
    assert policy.clamp_limit("SELECT 1", 5) == "SELECT 1 LIMIT 5"
    assert policy.clamp_limit("SELECT 1 LIMIT 9 OFFSET 2", 5) == "SELECT 1 LIMIT 5 OFFSET 2"
    assert policy.clamp_limit("SELECT 1 LIMIT 3", 5) == "SELECT 1 LIMIT 3"
    log = policy.AuditLog()
    log.record({"a": 1})
    log.record({"a": 2})
    assert log.verify()
    log.lines[0] = log.lines[0].replace("1", "3", 1)
    assert not log.verify()


def test_templates_translate():
    assert translate("array_length(make_array(1, f(2, 3)))") == "array_size(array(1, f(2, 3)))"
    assert translate("'btrim(x)' || safe_divide(a, b)") == "'btrim(x)' || try_divide(a, b)"
    assert len(SCALAR) + len(AGGREGATE) > 150


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    readers.write(df, f"file://{tmp_path}/t.parquet")
    readers.write(df, f"file://{tmp_path}/c.csv", "csv")
    assert set(readers.discover(spark, f"file://{tmp_path}")) == {"t"}
    assert readers.read_csv(spark, f"file://{tmp_path}/c.csv").count() == 2
    assert [r[0] for r in readers.to_json_rows(df).collect()] == ['{"k":1,"v":"a"}', '{"k":2,"v":null}']
    with pytest.raises(readers.SourceError):
        readers.discover(spark, f"file://{tmp_path}", "orc")
    assert readers.read_rows(spark, '[{"a": 1}]').collect()[0]["a"] == 1
    new = spark.createDataFrame([(1, 2)], "k bigint, w int").schema
    assert {c[0] for c in readers.drift(df.schema, new)} == {"added", "removed", "type_changed"}


def test_recall(spark, eng):
    rows = recall.schema_records(spark, eng.manifest)
    assert recall.context(rows) and recall.context(rows, 10) is None
    assert recall.token_recall(rows, "customer total spend").count() == 3
    assert recall.seed_queries(eng.manifest)


def test_streaming_same_as_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom.streaming import windows

    src = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/events")
    agg = lambda df: windows.tumbling(df, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")], late="1 hour")
    q = agg(stream).writeStream.format("memory").queryName("out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("out").collect())) == sorted(map(tuple, agg(src).collect()))
