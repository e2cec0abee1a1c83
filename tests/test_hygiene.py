"""One scan a to-many path, nothing left in the session, whole names, a lasting audit log."""

import threading

import pytest

from sparkloom.operators import policy
from sparkloom.plans import exprs
from sparkloom.plans.catalogue import _cols, engine
from sparkloom.plans.manifest import ManifestError
from sparkloom.session import Engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def eng(spark):
    return engine(spark, DATA)


def small(spark, columns, **more):
    parts = {"base": "k int, v int", "xs": "k int, v int", "ys": "k int, v int"}
    rows = {"base": [(1, 10), (2, 20), (3, 30)], "xs": [(1, 1), (1, 2), (2, 4)], "ys": [(1, 7), (1, 8), (1, 9), (3, 5)]}
    e = Engine(spark)
    for n, s in parts.items():
        e.register(n, spark.createDataFrame(rows[n], s))
    model = lambda n, *c: {"name": n, "tableReference": {"table": n}, "primaryKey": "k", "columns": _cols("k|int", "v|int", *c)}
    rel = lambda n: {"name": f"to_{n}", "models": ["base", n], "joinType": "ONE_TO_MANY", "condition": f"base.k = {n}.k"}
    return e.load({"models": [model("base", "xs|xs|->to_xs", "ys|ys|->to_ys", *columns), model("xs"), model("ys")], "relationships": [rel("xs"), rel("ys")], **more})


def test_paths_do_not_multiply(spark):
    e = small(spark, ["both|int|=sum(xs.v) + sum(ys.v)", "n|bigint|=count(xs.v)", "all_y|bigint|=count(ys.v) * 10 + v", "own|bigint|=sum(xs.v * base.v)"])
    got = {r.k: r for r in e.query("SELECT * FROM base").collect()}
    assert [(got[k].both, got[k].n, got[k].all_y, got[k].own) for k in (1, 2, 3)] == [(27, 2, 40, 30), (None, 1, 20, 80), (None, 0, 40, None)]


def test_unsafe_calculations_are_errors(spark):
    for text, code in (("xs.v + 1", "TO_MANY_WITHOUT_AGGREGATE"), ("sum(xs.v * ys.v)", "AGGREGATE_PATHS_MIXED"), ("sum(xs.v) + ys.v", "TO_MANY_WITHOUT_AGGREGATE")):
        with pytest.raises(ManifestError) as e:
            small(spark, [f"bad|int|={text}"]).query("SELECT bad FROM base")
        assert e.value.code == code


def test_one_scan_and_one_join_a_path(eng):
    plan = eng.query("SELECT c_custkey, total_spend, order_count, largest_order FROM customer")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1 and plan.count("Aggregate [") == 1
    # The children are grouped by their foreign key before the join.
    assert plan.index("Join ") < plan.index("Aggregate [o_custkey")


def test_split_aggregates():
    assert exprs.split_aggregates("1 + sum(a) FILTER (WHERE b > count) / max(c)") == [(False, "1 + "), (True, "sum(a) FILTER (WHERE b > count)"), (False, " / "), (True, "max(c)")]
    assert exprs.split_aggregates("sum(a) OVER (PARTITION BY b)") == [(False, "sum(a) OVER (PARTITION BY b)")]
    assert exprs.split_aggregates("listagg(x) WITHIN GROUP (ORDER BY y)") == [(True, "listagg(x) WITHIN GROUP (ORDER BY y)")]


def test_session_views_are_left_alone(spark, eng):
    spark.range(3).createOrReplaceTempView("orders")
    before = {t.name for t in spark.catalog.listTables()}
    assert eng.query("SELECT count(*) AS n FROM orders").first().n > 3
    assert eng.query("SELECT count(*) AS n FROM closed_orders").first().n > 3
    assert spark.table("orders").count() == 3
    left = {t.name for t in spark.catalog.listTables()} - before
    assert all(t.startswith("sparkloom_model_") for t in left)
    held = set(eng._views.values())
    eng.close()
    assert held and not held & {t.name for t in spark.catalog.listTables()}
    spark.catalog.dropTempView("orders")


def test_views_are_reused_and_bounded(spark, eng, monkeypatch):
    from sparkloom import session

    eng.close()
    for _ in range(3):
        eng.query("SELECT n_name FROM nation")
    assert len(eng._views) == 1
    eng.query("SELECT c_custkey FROM guarded", properties={"nation": 1})
    eng.query("SELECT c_custkey FROM guarded", properties={"nation": 2})
    assert len(eng._views) == 3
    monkeypatch.setattr(session, "_MOST_VIEWS", 2)
    assert eng.query("SELECT r_name FROM region").count() == 5 and len(eng._views) == 2
    eng.close()


def test_time_zone_is_of_one_query(spark, eng):
    before = spark.conf.get("spark.sql.session.timeZone")
    sql = "SELECT date_format(timestamp_seconds(0), 'HH') AS h FROM region LIMIT 1"
    assert eng.query(sql, properties={"x-sparkloom-timezone": "Asia/Tokyo"}).first().h == "09"
    assert eng.query(sql).first().h == "00" and spark.conf.get("spark.sql.session.timeZone") == before
    with pytest.raises(Exception):  # noqa: B017
        eng.query("SELECT nothing FROM region", properties={"x-sparkloom-timezone": "Asia/Tokyo"})
    assert spark.conf.get("spark.sql.session.timeZone") == before


def test_queries_in_two_threads(eng):
    out, errors = {}, []

    def ask(k):
        try:
            out[k] = eng.query("SELECT count(*) AS n FROM guarded", properties={"nation": k}).first().n
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=ask, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and out == {k: eng.query("SELECT count(*) AS n FROM guarded", properties={"nation": k}).first().n for k in range(8)}


def test_audit_log_lasts(tmp_path):
    path = str(tmp_path / "audit.log")
    log = policy.AuditLog(path, keep=5, rotate=400)
    for k in range(20):
        log.record({"n": k})
    assert len(log.lines) == 5 and log.verify() and len(list(tmp_path.iterdir())) > 2
    again = policy.AuditLog(path, keep=5, rotate=400)
    assert again.last == log.last
    again.record({"n": 20})
    assert again.verify()
    first = tmp_path / "audit.log.1"
    first.write_text(first.read_text().replace('"n": 1', '"n": 9', 1))
    assert not again.verify()
    memory = policy.AuditLog(keep=3)
    for k in range(9):
        memory.record({"n": k})
    assert len(memory.lines) == 3 and memory.verify()
