"""Questions, graph inspection, projects, dbt artifacts and stored pairs."""

import pytest

from sparkloom.operators import graph_inspect, questions
from sparkloom.operators.graph import GraphError, GraphPlanner
from sparkloom.operators.recall import QueryMemory
from sparkloom.plans import manifest
from sparkloom.plans.catalogue import engine
from sparkloom.sources import project

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def eng(spark):
    return engine(spark, DATA)


@pytest.fixture(scope="module")
def planner(eng):
    return GraphPlanner(eng.manifest, eng.builder())


def test_scores_order_evidence():
    """Whole terms over parts, larger parts over smaller ones, labels over synonyms over names, more of the question over less."""
    m = {"name": "net_revenue", "label": "Net Revenue", "synonyms": "turnover, sales"}
    exact, inside, part, none = (questions.score(q, m) for q in ("net revenue", "show net revenue of shops", "revenues", "weather"))
    assert exact > inside > part > none == 0
    assert exact == 2 * questions.WEIGHTS["label"] + round(min(10, 2 * questions.WEIGHTS["name"] / 20))
    assert questions.score("turnover by shop", m) >= questions.LEAST
    one = lambda **x: questions.score("gross margin of stores", {"name": "zz", **x})
    assert one(label="gross margin") > one(synonyms=["gross margin"]) > one(name="gross_margin") >= questions.LEAST > one(name="gross_of_tax_total")
    assert one(label="margin of the last day", description="gross stores") > one(label="margin of the last day")
    assert one(description="gross margin of stores") == 0


def test_words():
    assert questions.words_of("Net-Revenue_2 (Q1)") == ["net", "revenue", "2", "q1"] and questions.words_of("订单金额 x") == ["订单", "单金", "金额", "x"]
    assert questions.same_word("orders", "order") and questions.same_word("monthly", "months") is False and not questions.same_word("for", "fort")
    assert questions.score("订单金额是多少", {"name": "amount", "label": "订单金额"}) >= questions.LEAST


def test_rank_explains_each_word_once():
    names = lambda q, *ms: [n for n, _ in questions.rank(q, [{"name": n} for n in ms])]
    assert names("order revenue", "order_revenue", "order_n", "revenue", "weather") == ["order_revenue"]
    assert names("order revenue and stock", "order_revenue", "stock", "revenue") == ["order_revenue", "stock"]
    twins = [{"name": "a_b", "label": "margin"}, {"name": "c_d", "label": "margin"}]
    assert [n for n, _ in questions.rank("margin", twins)] == ["a_b", "c_d"]


def test_phrases_and_dates():
    assert questions.grain_phrases("revenue by nation name, region and brand for 2024") == ("revenue", ["nation name", "region", "brand"])
    assert questions.grain_phrases("n per kind 2024-01-05 to 20240110") == ("n", ["kind"])
    assert questions.grain_phrases("revenue") is None and questions.relative_days("the past 12 days?") == 12
    assert questions.explicit_dates("from 2024-01-05 to (20240110)") == ("20240105", "20240110") and questions.explicit_dates("item 12345") is None


def test_cube_priority_and_hierarchies():
    cube = lambda n, **x: {"name": n, "baseObject": "t", "measures": [{"name": "sales", "expression": "sum(v)"}], "dimensions": [{"name": "shop", "expression": "s"}, {"name": "town", "expression": "s"}], **x}
    model = {"name": "t", "tableReference": {"table": "t"}, "columns": [{"name": "v", "type": "int"}, {"name": "s", "type": "varchar"}]}
    load = lambda *c: manifest.load({"models": [model], "cubes": list(c)})
    with pytest.raises(GraphError, match="AMBIGUOUS"):
        questions.resolve_cube(load(cube("one"), cube("two")), "sales by shop")
    assert questions.resolve_cube(load(cube("one"), cube("two", priority=2)), "sales by shop")["cube"] == "two"
    assert questions.resolve_cube(load(cube("one"), cube("two")), "two sales")["cube"] == "two"
    got = questions.resolve_cube(load(cube("one", hierarchies={"place": ["town", "shop"]})), "sales by place")
    assert got["dimensions"] == ["town", "shop"]


def test_resolves_to_a_request(planner):
    got = questions.resolve(planner, "order revenue by nation name and region name")
    assert got.source == "orders" and got.request["metrics"] == ["order_revenue"]
    assert got.request["dimensions"] == ["nation_name", "region_name"]
    dated = questions.resolve(planner, "event worth by event kind 2024-01-05 to 20240110").request
    assert dated["partitions"] == {"events": ["20240105", "20240110"]}
    low, high = questions.resolve(planner, "event worth by event kind last 7 days").request["partitions"]["events"]
    assert (questions.window_before(high, 7)) == (low, high)


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (" ", "GRAPH_QUESTION_INVALID"),
        ("the weather", "GRAPH_QUESTION_METRIC_NOT_FOUND"),
        ("order revenue by colour of hair", "GRAPH_QUESTION_DIMENSION_NOT_FOUND"),
        ("order revenue by brand", "GRAPH_QUESTION_NOT_QUERYABLE"),
        ("order revenue and supplier balance by nation name", "GRAPH_QUESTION_MASTER_SOURCE_CONFLICT"),
        ("event worth by event kind", "GRAPH_PARTITION_RANGE_REQUIRED"),
        ("event worth last 3 days, last 4 days", "GRAPH_QUESTION_DATE_RANGE_AMBIGUOUS"),
        ("event worth last 9999 days", "GRAPH_QUESTION_RELATIVE_DATE_INVALID"),
        ("event worth 20240230", "GRAPH_PARTITION_DATE_INVALID"),
        ("event worth 20240110 20240105", "GRAPH_PARTITION_DATE_RANGE_INVALID"),
    ],
)
def test_unclear_questions_fail(planner, text, code):
    with pytest.raises(GraphError) as e:
        questions.resolve(planner, text)
    assert e.value.code == code


def test_cube_question(eng):
    got = questions.resolve_cube(eng.manifest, "order cube revenue by region, monthly ordered")
    assert got["cube"] == "order_cube" and got["measures"] == ["revenue"] and got["dimensions"] == ["region"]
    assert got["timeDimensions"] == [{"dimension": "ordered", "granularity": "month"}]
    with pytest.raises(GraphError):
        questions.resolve_cube(eng.manifest, "weather")


def test_inspect(spark, eng):
    rows = eng.inspect("MATCH (m:MODEL)-[:HAS_COLUMN]->(c:COLUMN) WHERE m.name = 'region' RETURN c.name AS n, c.type AS t ORDER BY n DESC LIMIT 5").collect()
    assert [r.n for r in rows] == sorted((c.name for c in eng.manifest.model("region").visible() if not c.relationship), reverse=True)[:5]
    back = eng.inspect("MATCH (r:MODEL {name: 'region'})<-[e:RELATIONSHIP]-(n:MODEL) RETURN n.name").collect()
    assert [tuple(r) for r in back] == [("nation",)]
    held = eng.inspect("MATCH (c:CUBE) WHERE c.measures CONTAINS 'revenue' RETURN c.name").collect()
    assert [tuple(r) for r in held] == [("order_cube",)]
    assert eng.inspect("MATCH (m:MODEL) WHERE m.name CONTAINS 'ORD' RETURN m.name").count() == 0
    assert eng.inspect("MATCH (m:MODEL) RETURN m.name LIMIT 0").count() == 0


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("MATCH (a) DELETE a RETURN a", "READ_ONLY_QUERY_REQUIRED"),
        ("MATCH (a) RETURN a; MATCH (b) RETURN b", "MULTIPLE_STATEMENTS_FORBIDDEN"),
        ("MATCH (a) // x\nRETURN a", "QUERY_COMMENTS_FORBIDDEN"),
        ("MATCH (a) RETURN b", "UNKNOWN_VARIABLE"),
        ("MATCH (a) RETURN a LIMIT 1.5", "INVALID_LIMIT"),
        ("MATCH (a) WHERE a.x = $p RETURN a", "PARAMETER_MISSING"),
        ("MATCH (a)-[a]->(b) RETURN a", "DUPLICATE_VARIABLE"),
        ("MATCH (a RETURN a", "QUERY_SYNTAX_ERROR"),
        ("MATCH (a) RETURN a" + " " * 3 + "x" * 10_001, "QUERY_TOO_LARGE"),
    ],
)
def test_inspect_refuses(text, code):
    with pytest.raises(graph_inspect.InspectError) as e:
        graph_inspect.parse(text)
    assert e.value.code == code
    with pytest.raises(graph_inspect.InspectError, match="UNUSED_PARAMETERS"):
        graph_inspect.parse("MATCH (a) RETURN a", {"x": 1})
    assert graph_inspect.parse("MATCH (a {n: 'drop it'}) RETURN a").left.want == [("n", "drop it")]


def _write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_project(tmp_path):
    pytest.importorskip("yaml")
    good = {
        "project.yml": "name: shop\nlayout_version: 2\n",
        "models/a.yml": "name: orders\ntable_reference: {table: orders}\nprimary_key: id\ncolumns:\n  - {name: id, type: bigint}\n  - {name: price, type: double}\n  - {name: state, type: varchar}\n",
        "metrics/m.yml": "metrics:\n  - {name: total, expression: sum(price), model: orders}\n  - {name: twice, expression: 2 * total, model: orders}\n",
        "dimensions.yml": "- {name: state_name, expression: upper(state), model: orders}\n",
        "cubes/c.yml": "name: sales\nbase_object: orders\nmeasures: [twice]\ndimensions: [state_name]\n",
    }
    _write(tmp_path, good)
    built = project.build(str(tmp_path))
    cube = manifest.load(built).cubes["sales"]
    assert cube.measures["twice"].replace(" ", "") == "2*(sum(price))" and cube.dimensions["state_name"] == "upper(state)"
    _write(tmp_path, {
        "models/b.yml": "name: bad\ntable_reference: {schema: s}\nref_sql: SELECT 1\nprimary_key: nope\ncolumns: [{name: x}]\n",
        "relationships.yml": "- {name: r, models: [orders, ghost]}\n",
        "views/v.yml": "name: orders\n",
        "metrics/z.yml": "- {name: p, expression: q + 1}\n- {name: q, expression: p + 1}\n- {name: total, expression: '1'}\n",
        "cubes/d.yml": "name: other\nbase_object: orders\nmeasures: [missing]\n",
    })
    with pytest.raises(project.ProjectError) as e:
        project.build(str(tmp_path))
    text = " | ".join(e.value.problems)
    for part in ("not both", "key nope", "without name or type", "no model ghost", "no statement", "a model and a view", "cycle", "named twice", "no metric missing", "without a table"):
        assert part in text, part
    with pytest.raises(project.ProjectError, match=r"project\.yml"):
        project.read(str(tmp_path / "models"))


def test_project_base_fields():
    raw = {"name": "x", "models": [{"name": "a", "tableReference": {"table": "a"}, "columns": [{"name": "v", "type": "int"}]}], "relationships": [], "views": [], "dimensions": [],
           "metrics": [{"name": "m", "expression": "sum(CASE WHEN v > 1 THEN w ELSE NULL END)"}], "cubes": [{"name": "c", "baseObject": "a", "measures": ["m"]}]}
    assert project.check(raw) == ["cube c: m needs w"]


def test_dbt():
    node = lambda kind, name, **more: {"resource_type": kind, "name": name, "schema": "s", "columns": {}, **more}
    check = lambda name, own, col, on, **kw: {"resource_type": "test", "test_metadata": {"name": name, "kwargs": kw}, "attached_node": own, "column_name": col, "depends_on": {"nodes": on}}
    raw = {"nodes": {
        "model.o": node("model", "o", columns={"id": {"name": "id", "data_type": "bigint"}, "cust": {"name": "cust"}}), "seed.c": node("seed", "c", columns={"id": {"name": "id"}}),
        "t1": check("unique", "seed.c", "id", ["seed.c"]), "t2": check("not_null", "seed.c", "id", ["seed.c"]),
        "t3": check("relationships", "model.o", "cust", ["seed.c", "model.o"], field="id", to="ref('c')"),
    }}
    got = project.from_dbt(raw, {"nodes": {"model.o": {"columns": {"ID": {"name": "ID", "type": "INT"}, "CUST": {"name": "CUST", "type": "bigint"}}}}})
    m = manifest.load(got)
    assert m.model("c").primary_key == ("id",) and {c.name: c.type for c in m.model("o").columns} == {"id": "bigint", "cust": "bigint"}
    assert [(r.models, r.pairs) for r in m.relationships.values()] == [(("o", "c"), (("cust", "id"),))]


def test_memory(spark, tmp_path):
    mem = QueryMemory(spark, str(tmp_path / "pairs"))
    assert mem.count() == 0
    a = mem.store("total sales by region", "SELECT 1", datasource="x")
    b = mem.store("list customers", "SELECT 2")
    assert mem.count() == 2 and mem.count(datasource="x") == 1
    mem.store("total sales by region", "SELECT 3", key=a)
    assert mem.recall("sales by region").first()["sql"] == "SELECT 3"
    mem.dump(str(tmp_path / "dump"))
    mem.forget([a, "unknown"])
    assert [r.key for r in mem.list().collect()] == [b]
    mem.load(str(tmp_path / "dump"))
    assert mem.count() == 2
    with pytest.raises(ValueError):
        mem.store(" ", "SELECT 1")
