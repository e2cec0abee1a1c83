"""Registered queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import recall
from sparkloom.session import Engine
from sparkloom.streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _cols(*specs: str) -> list[dict]:
    out = []
    for s in specs:
        name, kind, *rest = s.split("|")
        c = {"name": name, "type": kind}
        if rest and rest[0].startswith("="):
            c |= {"isCalculated": True, "expression": rest[0][1:]}
        elif rest and rest[0].startswith("->"):
            c |= {"relationship": rest[0][2:]}
        elif rest and rest[0] == "hidden":
            c |= {"isHidden": True}
        elif rest:
            c |= {"expression": rest[0]}
        out.append(c)
    return out


def manifest() -> dict:
    """The demonstration model over the test tables."""
    by = lambda name, at, *models: {"name": name, "models": list(models), "joinType": at}
    rel = [
        by("nation_region", "MANY_TO_ONE", "nation", "region") | {"condition": "nation.n_regionkey = region.r_regionkey"},
        by("customer_nation", "MANY_TO_ONE", "customer", "nation") | {"condition": "customer.c_nationkey = nation.n_nationkey"},
        by("supplier_nation", "MANY_TO_ONE", "supplier", "nation") | {"condition": "supplier.s_nationkey = nation.n_nationkey"},
        by("orders_customer", "MANY_TO_ONE", "orders", "customer") | {"condition": "(orders.o_custkey = customer.c_custkey)"},
        by("closed_customer", "MANY_TO_ONE", "closed_orders", "customer") | {"condition": "closed_orders.o_custkey = customer.c_custkey"},
        by("seen_customer", "MANY_TO_ONE", "seen_orders", "customer") | {"condition": "seen_orders.o_custkey = customer.c_custkey"},
        by("lineitem_orders", "MANY_TO_ONE", "lineitem", "orders") | {"condition": "lineitem.l_orderkey = orders.o_orderkey"},
        by("lineitem_part", "MANY_TO_ONE", "lineitem", "part") | {"condition": "lineitem.l_partkey = part.p_partkey"},
        by("lineitem_supplier", "MANY_TO_ONE", "lineitem", "supplier") | {"condition": "lineitem.l_suppkey = supplier.s_suppkey"},
        by("shares_orders", "MANY_TO_ONE", "order_parts", "orders") | {"condition": "order_parts.l_orderkey = orders.o_orderkey"},
        by("shares_part", "MANY_TO_ONE", "order_parts", "part") | {"condition": "order_parts.l_partkey = part.p_partkey"},
        by("pair_lines", "ONE_TO_MANY", "order_parts", "lineitem") | {"condition": "order_parts.l_orderkey = lineitem.l_orderkey AND order_parts.l_partkey = lineitem.l_partkey"},
    ]
    models = [
        {"name": "region", "tableReference": {"table": "region"}, "primaryKey": "r_regionkey", "columns": _cols("r_regionkey|int", "r_name|varchar")},
        {"name": "nation", "tableReference": {"table": "nation"}, "primaryKey": "n_nationkey", "columns": _cols("n_nationkey|int", "n_name|varchar", "n_regionkey|int", "region|region|->nation_region", "n_region|varchar|=region.r_name")},
        {"name": "customer", "tableReference": {"table": "customer"}, "primaryKey": "c_custkey", "columns": _cols(
            "c_custkey|bigint", "c_name|varchar", "c_nationkey|int", "c_acctbal|double", "c_mktsegment|varchar", "segment|varchar|lower(c_mktsegment)",
            "nation|nation|->customer_nation", "orders|orders|->orders_customer", "closed|closed_orders|->closed_customer",
            "nation_name|varchar|=nation.n_name", "region_name|varchar|=nation.region.r_name", "place|varchar|=concat(nation_name, ', ', region_name)",
            "total_spend|double|=sum(orders.o_totalprice)", "order_count|bigint|=count(orders.o_orderkey)",
            "closed_spend|double|=sum(closed.o_totalprice)", "closed_count|bigint|=count(closed.o_orderkey)", "line_total|double|=sum(orders.lines.l_quantity)",
            "largest_order|double|=max(orders.o_totalprice)", "spread|double|=sum(orders.o_totalprice) - coalesce(sum(closed.o_totalprice), 0)",
            "spend_per_line|double|=sum(orders.o_totalprice) / nullif(count(orders.lines.l_linenumber), 0)", "large_orders|bigint|=count(orders.o_orderkey) FILTER (WHERE orders.o_totalprice > 200000)",
            "weighted_spend|double|=sum(orders.o_totalprice * c_nationkey)", "seen|seen_orders|->seen_customer", "visible_spend|double|=sum(seen.o_totalprice)", "visible_count|bigint|=count(seen.o_orderkey)")},
        {"name": "supplier", "tableReference": {"table": "supplier"}, "primaryKey": "s_suppkey", "columns": _cols("s_suppkey|bigint", "s_name|varchar", "s_nationkey|int", "s_acctbal|double", "nation|nation|->supplier_nation", "s_nation|varchar|=nation.n_name")},
        {"name": "part", "tableReference": {"table": "part"}, "primaryKey": "p_partkey", "columns": _cols("p_partkey|bigint", "p_name|varchar", "p_brand|varchar", "p_type|varchar", "p_size|int", "p_retailprice|double")},
        {"name": "orders", "tableReference": {"table": "orders"}, "primaryKey": "o_orderkey", "columns": _cols(
            "o_orderkey|bigint", "o_custkey|bigint", "o_orderstatus|varchar", "o_totalprice|double", "o_orderdate|timestamp", "o_orderpriority|varchar|hidden",
            "customer|customer|->orders_customer", "lines|lineitem|->lineitem_orders", "urgent|boolean|=o_orderpriority = '1-URGENT'",
            "customer_name|varchar|=customer.c_name", "customer_region|varchar|=customer.nation.region.r_name", "line_count|bigint|=count(lines.l_linenumber)",
            "price_per_line|double|=o_totalprice / line_count")},
        {"name": "closed_orders", "refSql": "SELECT * FROM orders WHERE o_orderstatus = 'F'", "primaryKey": "o_orderkey", "columns": _cols("o_orderkey|bigint", "o_custkey|bigint", "o_totalprice|double", "customer|customer|->closed_customer")},
        {"name": "seen_orders", "tableReference": {"table": "orders"}, "primaryKey": "o_orderkey", "columns": _cols("o_orderkey|bigint", "o_custkey|bigint", "o_orderstatus|varchar", "o_totalprice|double"),
         "rowLevelAccessControls": [{"name": "one_status", "requiredProperties": [{"name": "status", "required": False, "defaultExpr": "'O'"}], "condition": "o_orderstatus = @status"}]},
        {"name": "lineitem", "tableReference": {"table": "lineitem"}, "columns": _cols(
            "l_orderkey|bigint", "l_partkey|bigint", "l_suppkey|bigint", "l_linenumber|int", "l_quantity|double", "l_extendedprice|double", "l_discount|double",
            "l_tax|double", "l_returnflag|varchar", "l_linestatus|varchar", "l_shipdate|timestamp", "orders|orders|->lineitem_orders", "part|part|->lineitem_part",
            "supplier|supplier|->lineitem_supplier", "revenue|double|=l_extendedprice * (1 - l_discount)", "brand|varchar|=part.p_brand",
            "buyer_nation|varchar|=orders.customer.nation.n_name", "seller_nation|varchar|=supplier.nation.n_name",
            "domestic|boolean|=orders.customer.nation.n_name = supplier.nation.n_name")},
        {"name": "order_parts", "refSql": "SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS amount, sum(sum(l_extendedprice)) OVER (PARTITION BY l_orderkey) AS order_amount FROM lineitem GROUP BY l_orderkey, l_partkey",
            "primaryKey": ["l_orderkey", "l_partkey"], "columns": _cols("l_orderkey|bigint", "l_partkey|bigint", "amount|double", "order_amount|double", "orders|orders|->shares_orders", "part|part|->shares_part", "lines|lineitem|->pair_lines", "pair_quantity|double|=sum(lines.l_quantity)")},
        {"name": "events", "tableReference": {"table": "events"}, "primaryKey": "event_id", "columns": _cols("event_id|bigint", "ts|timestamp", "user_id|bigint", "event_type|varchar", "value|double", "props|varchar", "ds|varchar|date_format(ts, 'yyyyMMdd')")},
        {"name": "guarded", "tableReference": {"table": "customer"}, "primaryKey": "c_custkey", "columns": [
            *_cols("c_custkey|bigint", "c_name|varchar", "c_nationkey|int"),
            {"name": "c_acctbal", "type": "double", "columnLevelAccessControl": {"name": "senior", "requiredProperties": [{"name": "level", "required": False}], "operator": "GREATER_THAN_OR_EQUALS", "threshold": "3"}}],
         "rowLevelAccessControls": [
            {"name": "own_nation", "requiredProperties": [{"name": "nation", "required": False, "defaultExpr": "3"}], "condition": "c_nationkey = @nation"},
            {"name": "listed", "requiredProperties": [{"name": "listed", "required": False}], "condition": "c_custkey IN (SELECT o_custkey FROM closed_orders WHERE o_totalprice > @listed)"}]},
    ]
    return {
        "layoutVersion": 3, "models": models, "relationships": rel,
        "views": [
            {"name": "big_orders", "statement": "SELECT o_orderkey, customer_name, o_totalprice FROM orders WHERE o_totalprice > 300000"},
            {"name": "big_buyers", "statement": "SELECT customer_name, count(*) AS n FROM big_orders GROUP BY customer_name"},
        ],
        "cubes": [
            {"name": "order_cube", "baseObject": "orders", "hierarchies": {"calendar": ["ordered"]},
             "measures": [{"name": "revenue", "expression": "sum(o_totalprice)"}, {"name": "orders_n", "expression": "count(*)"}, {"name": "average", "expression": "revenue / orders_n"}],
             "dimensions": [{"name": "status", "expression": "o_orderstatus"}, {"name": "region", "expression": "customer_region"}],
             "timeDimensions": [{"name": "ordered", "expression": "o_orderdate"}]},
            {"name": "event_cube", "baseObject": "events", "measures": [{"name": "n", "expression": "count(*)"}, {"name": "worth", "expression": "sum(value)"}],
             "dimensions": [{"name": "kind", "expression": "event_type"}], "timeDimensions": [{"name": "at", "expression": "ts"}]},
        ],
        "metrics": [
            {"name": "order_revenue", "model": "orders", "expression": "sum(o_totalprice)"}, {"name": "order_n", "model": "orders", "expression": "count(o_orderkey)"},
            {"name": "largest", "model": "orders", "expression": "max(o_totalprice)"}, {"name": "supplier_balance", "model": "supplier", "expression": "sum(s_acctbal)"},
            {"name": "customer_balance", "model": "customer", "expression": "sum(c_acctbal)"}, {"name": "average_price", "model": "orders", "expression": "avg(o_totalprice)"},
            {"name": "event_worth", "model": "events", "expression": "sum(value)"}, {"name": "event_n", "model": "events", "expression": "count(*)"},
            {"name": "dated_n", "model": "orders", "expression": "count(o_orderkey)"},
        ],
        "dimensions": [
            {"name": "nation_name", "model": "nation", "expression": "n_name"}, {"name": "region_name", "model": "region", "expression": "r_name"},
            {"name": "return_flag", "model": "lineitem", "expression": "l_returnflag"}, {"name": "brand", "model": "part", "expression": "p_brand"},
            {"name": "event_kind", "model": "events", "expression": "event_type"}, {"name": "buyer", "model": "customer", "expression": "c_custkey"},
        ],
        "graph": {"maxHops": 4, "partitions": {"events": {"mode": "incremental", "column": "ds"}}, "metricPolicies": {"average_price": {"blockedDimensions": ["return_flag"]}, "dated_n": {"blockedDimensions": ["time"]}}},
    }


_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the test tables; the latest is kept, as a session keeps its engine."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _engines and _engines[key].spark is spark:
        return _engines[key]
    _engines.clear()
    e = _engines[key] = Engine(spark)
    for t in TABLES:
        e.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return e.load(manifest())


Pair = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def _sem(sql: str, oracle: str | None = None, **props) -> Pair:
    return (lambda spark, d: engine(spark, d).query(sql, properties=props)), oracle or sql


def _cube(request: dict, oracle: str) -> Pair:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = engine(spark, d).cube_query(request)
        return out.select(*[F.col(c).cast("date").alias(c) if t == "timestamp" else F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return run, oracle


def _graph(request: dict, oracle: str) -> Pair:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = engine(spark, d).graph_query(request)
        return out.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return run, oracle


def _model_queries() -> dict[str, Pair]:
    return {
        "scan_table_reference": _sem("SELECT n_nationkey, n_name FROM nation"),
        "scan_ref_sql": _sem("SELECT o_orderkey, o_totalprice FROM closed_orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
        "select_star": _sem("SELECT * FROM closed_orders WHERE o_totalprice > 400000", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000"),
        "row_only_count": _sem("SELECT count(*) AS n FROM customer"),
        "expression_column": _sem("SELECT segment, count(*) AS n FROM customer GROUP BY segment", "SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1"),
        "hidden_column_in_calculation": _sem("SELECT urgent, count(*) AS n FROM orders GROUP BY urgent", "SELECT o_orderpriority = '1-URGENT' AS urgent, count(*) AS n FROM orders GROUP BY 1"),
        "to_one_path": _sem("SELECT customer_name, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY customer_name", "SELECT c_name AS customer_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name"),
        "to_one_three_hops": _sem("SELECT customer_region, count(*) AS n FROM orders GROUP BY customer_region", "SELECT r_name AS customer_region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
        "two_roles_of_one_model": _sem("SELECT buyer_nation, seller_nation, count(*) AS n FROM lineitem GROUP BY buyer_nation, seller_nation", "SELECT b.n_name AS buyer_nation, s.n_name AS seller_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2"),
        "branching_paths": _sem("SELECT domestic, count(*) AS n FROM lineitem GROUP BY domestic", "SELECT c_nationkey = s_nationkey AS domestic, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
        "chained_calculation": _sem("SELECT c_custkey, place FROM customer", "SELECT c_custkey, n_name || ', ' || r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
        "to_many_calculation": _sem("SELECT c_custkey, round(total_spend, 2) AS total_spend, order_count FROM customer", "SELECT c_custkey, round(sum(o_totalprice), 2) AS total_spend, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
        "to_many_without_children": _sem("SELECT c_custkey, round(closed_spend, 2) AS closed_spend, closed_count FROM customer", "SELECT c_custkey, round(sum(o_totalprice), 2) AS closed_spend, count(o_orderkey) AS closed_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY c_custkey"),
        "to_many_two_hops": _sem("SELECT c_custkey, line_total FROM customer", "SELECT c_custkey, sum(l_quantity) AS line_total FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey"),
        "to_many_composite_key": _sem("SELECT l_orderkey, l_partkey, pair_quantity FROM order_parts", "SELECT l_orderkey, l_partkey, sum(l_quantity) AS pair_quantity FROM lineitem GROUP BY 1, 2"),
        "calculation_over_to_many": _sem("SELECT o_orderkey, round(price_per_line, 7) AS price_per_line FROM orders WHERE line_count > 0", "SELECT o_orderkey, round(any_value(o_totalprice) / count(*), 7) AS price_per_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
        "view_expansion": _sem("SELECT customer_name, count(*) AS n FROM big_orders GROUP BY customer_name", "SELECT c_name AS customer_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1"),
        "view_over_view": _sem("SELECT n, count(*) AS buyers FROM big_buyers GROUP BY n", "SELECT n, count(*) AS buyers FROM (SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1) GROUP BY n"),
        "row_access_default": _sem("SELECT c_custkey, c_name FROM guarded", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3"),
        "row_access_property": _sem("SELECT c_custkey, c_name FROM guarded", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7", nation=7),
        "row_access_subquery": _sem("SELECT c_custkey FROM guarded", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)", nation=5, listed=200000),
        "column_access_denied": _sem("SELECT * FROM guarded", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 3", level=1),
        "column_access_granted": _sem("SELECT * FROM guarded", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 3", level=5),
    }


def _cube_queries() -> dict[str, Pair]:
    month = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ordered__month"
    return {
        "cube_grain_measures": _cube({"cube": "order_cube", "measures": ["revenue", "orders_n", "average"], "timeDimensions": [{"dimension": "ordered", "granularity": "month"}]}, f"{month}, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders_n, round(sum(o_totalprice) / count(*), 2) AS average FROM orders GROUP BY 1"),
        "cube_dimensions_filters": _cube({"cube": "order_cube", "measures": ["orders_n"], "dimensions": ["status", "region"], "filters": [{"dimension": "status", "operator": "in", "value": ["F", "O"]}, {"dimension": "region", "operator": "contains", "value": "A"}]}, "SELECT o_orderstatus AS status, r_name AS region, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus IN ('F', 'O') AND r_name LIKE '%A%' GROUP BY 1, 2"),
        "cube_date_range": _cube({"cube": "order_cube", "measures": ["revenue"], "timeDimensions": [{"dimension": "ordered", "granularity": "quarter", "dateRange": ["1995-01-01", "1996-01-01"]}]}, "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ordered__quarter, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01' GROUP BY 1"),
        "cube_dimension_only": _cube({"cube": "order_cube", "dimensions": ["region"]}, "SELECT DISTINCT r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
        "cube_week_limit": _cube({"cube": "event_cube", "measures": ["n"], "timeDimensions": [{"dimension": "at", "granularity": "week"}], "filters": [{"dimension": "kind", "operator": "is_not_null"}], "limit": 3, "offset": 1}, "SELECT CAST(date_trunc('week', ts) AS DATE) AS at__week, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 1"),
    }


def _graph_queries() -> dict[str, Pair]:
    customer = "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    return {
        "graph_single_fact": _graph({"metrics": ["order_revenue", "order_n"], "dimensions": ["region_name"]}, f"SELECT r_name AS region_name, round(sum(o_totalprice), 2) AS order_revenue, count(*) AS order_n FROM orders {customer} JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
        "graph_attributes": _graph({"metrics": ["largest"], "dimensions": ["orders.o_orderstatus", "nation_name"]}, f"SELECT o_orderstatus, n_name AS nation_name, round(max(o_totalprice), 2) AS largest FROM orders {customer} GROUP BY 1, 2"),
        "graph_fanout_repeat": _graph({"metrics": ["order_revenue", "order_n", "largest"], "dimensions": ["return_flag"], "fanoutMode": "repeat", "pathHints": {"return_flag": ["lineitem_orders"]}}, "SELECT l_returnflag AS return_flag, round(sum(p), 2) AS order_revenue, CAST(count(*) AS BIGINT) AS order_n, round(max(p), 2) AS largest FROM (SELECT DISTINCT o_orderkey, o_totalprice AS p, l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1"),
        "graph_bridge_weighted": _graph({"metrics": ["order_revenue"], "dimensions": ["brand"], "bridge": {"model": "order_parts", "allocation": "amount / order_amount"}}, "WITH p AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2), s AS (SELECT *, a / sum(a) OVER (PARTITION BY l_orderkey) AS w FROM p), m AS (SELECT l_orderkey, p_brand, sum(w) AS w FROM s JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand AS brand, round(sum(o_totalprice * coalesce(w, 0)), 2) AS order_revenue FROM orders LEFT JOIN m ON l_orderkey = o_orderkey GROUP BY 1"),
        "graph_multi_fact": _graph({"metrics": ["order_revenue", "customer_balance", "supplier_balance"], "dimensions": ["nation_name"], "calculations": [{"name": "gap", "expression": "round(customer_balance - supplier_balance, 2)"}], "orderBy": ["nation_name"]}, f"SELECT nation_name, round(order_revenue, 2) AS order_revenue, round(customer_balance, 2) AS customer_balance, round(supplier_balance, 2) AS supplier_balance, round(customer_balance - supplier_balance, 2) AS gap FROM (SELECT n_name AS nation_name, sum(o_totalprice) AS order_revenue FROM orders {customer} GROUP BY 1) a FULL JOIN (SELECT n_name AS nation_name, sum(c_acctbal) AS customer_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) b USING (nation_name) FULL JOIN (SELECT n_name AS nation_name, sum(s_acctbal) AS supplier_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) c USING (nation_name)"),
        "graph_partition_range": _graph({"metrics": ["event_worth", "event_n"], "dimensions": ["event_kind"], "partitions": {"events": ["20240105", "20240110"]}}, "SELECT event_type AS event_kind, round(sum(value), 2) AS event_worth, count(*) AS event_n FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-10' GROUP BY 1"),
    }


def _host_queries() -> dict[str, Pair]:
    """What the host engine gives: TPC-H shapes, windows, sets, subqueries, CTEs."""
    rev = "l_extendedprice * (1 - l_discount)"
    return {
        "tpch_q1": _sem(f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({rev}), 4) AS sum_disc, round(sum({rev} * (1 + l_tax)), 5) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"),
        "tpch_q3": _sem(f"SELECT l_orderkey, round(sum({rev}), 4) AS revenue, CAST(o_orderdate AS DATE) AS ordered FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10"),
        "tpch_q4": _sem("SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderstatus"),
        "tpch_q5": _sem(f"SELECT n_name, round(sum({rev}), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name"),
        "tpch_q6": _sem("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
        "tpch_q7": _sem(f"SELECT n1.n_name AS seller, n2.n_name AS buyer, CAST(extract(year FROM l_shipdate) AS INT) AS y, round(sum({rev}), 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_name <> n2.n_name GROUP BY 1, 2, 3"),
        "tpch_q10": _sem(f"SELECT c_custkey, c_name, round(sum({rev}), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20"),
        "tpch_q12": _sem("SELECT l_linestatus, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus"),
        "tpch_q13": _sem("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus LIKE 'F%' GROUP BY c_custkey) c GROUP BY c_count"),
        "tpch_q14": _sem(f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {rev} ELSE 0 END) / sum({rev}), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey"),
        "tpch_q15": _sem(f"WITH revenue AS (SELECT l_suppkey AS k, round(sum({rev}), 4) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = k WHERE total = (SELECT max(total) FROM revenue)"),
        "tpch_q17": _sem("SELECT round(sum(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < (SELECT 0.4 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)"),
        "tpch_q18": _sem("SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_name, o_orderkey, o_totalprice"),
        "tpch_q21": _sem("SELECT s_name, count(*) AS n FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY s_name"),
        "tpch_q22": _sem("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY c_nationkey"),
        # The test tables have no part-supplier table: in these shapes what a supplier delivered stands for its offers.
        "tpch_q2": _sem("WITH offers AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS sk FROM lineitem) SELECT p_partkey, s_suppkey, round(s_acctbal, 2) AS balance FROM part JOIN offers ON p_partkey = k JOIN supplier ON s_suppkey = sk WHERE p_size < 16 AND s_acctbal = (SELECT max(s2.s_acctbal) FROM offers o2 JOIN supplier s2 ON s2.s_suppkey = o2.sk WHERE o2.k = p_partkey)"),
        "tpch_q8": _sem(f"SELECT y, round(sum(CASE WHEN nation = 'FRANCE' THEN volume ELSE 0 END) / sum(volume), 6) AS share FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, {rev} AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'EUROPE') v GROUP BY y"),
        "tpch_q9": _sem(f"SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INT) AS y, round(sum({rev} - 0.5 * p_retailprice * l_quantity), 2) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size > 10 GROUP BY n_name, extract(year FROM o_orderdate)"),
        "tpch_q11": _sem("SELECT l_partkey, round(sum(l_extendedprice), 2) AS worth FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3 GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0008 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3)"),
        "tpch_q16": _sem("SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size"),
        "tpch_q19": _sem(f"SELECT round(sum({rev}), 4) AS revenue, count(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_partkey = l_partkey AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_partkey = l_partkey AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)"),
        "tpch_q20": _sem("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT a.l_suppkey FROM lineitem a WHERE a.l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND a.l_quantity > (SELECT 0.9 * max(b.l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey))"),
        "not_in_subquery": _sem("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM closed_orders)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
        "full_outer_join": _sem("SELECT a.n_nationkey AS l, b.n_nationkey AS r FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey"),
        "cross_and_theta_join": _sem("SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey CROSS JOIN (SELECT 1 AS one) c"),
        "grouping_sets": _sem("SELECT o_orderstatus, CAST(extract(year FROM o_orderdate) AS INT) AS y, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, extract(year FROM o_orderdate)), (o_orderstatus), ())", "SELECT o_orderstatus, CAST(y AS INT) AS y, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM (SELECT *, extract(year FROM o_orderdate) AS y FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, y), (o_orderstatus), ())"),
        "rollup": _sem("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"),
        "distinct_counts": _sem("SELECT count(DISTINCT c_nationkey) AS a, count(DISTINCT c_mktsegment) AS b FROM customer"),
        "filter_clause": _sem("SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS pos, count(*) AS n FROM customer GROUP BY c_nationkey"),
        "windows_ranking": _sem("SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(c_custkey) OVER w AS lg, lead(c_custkey) OVER w AS ld, first_value(c_custkey) OVER w AS fv, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)"),
        "windows_frames": _sem("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS c, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nv FROM orders"),
        "set_operations": _sem("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
        "union_distinct_intersect": _sem("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 20"),
        "recursive_cte": _sem("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t"),
        "nested_cte": _sem("WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey), b AS (SELECT k, n FROM a WHERE n > 40) SELECT b.k, b.n, n_name FROM b JOIN nation ON k = n_nationkey"),
        "null_ordering_limit": _sem("SELECT c_custkey, closed_count FROM customer ORDER BY closed_spend DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 5", "SELECT c_custkey, count(o_orderkey) AS closed_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY sum(o_totalprice) DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 5"),
        "values_and_series": _sem("SELECT a, b FROM VALUES (1, 'x'), (2, 'y') AS v(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)"),
        "statistics_aggregates": _sem("SELECT c_nationkey, round(stddev(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(corr(c_acctbal, c_custkey), 6) AS co, round(covar_samp(c_acctbal, c_custkey), 2) AS cs, round(regr_slope(c_acctbal, c_custkey), 6) AS rs, round(median(c_acctbal), 4) AS md, bool_and(c_acctbal > 0) AS ba, bool_or(c_acctbal > 9000) AS bo FROM customer GROUP BY c_nationkey"),
        "bit_aggregates": _sem("SELECT c_mktsegment, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x, min(c_name) AS mn, max(c_name) AS mx FROM customer GROUP BY c_mktsegment"),
        "ordered_string_agg": _sem("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
        "percentiles": _sem("SELECT c_mktsegment, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 4) AS q1 FROM customer GROUP BY c_mktsegment"),
    }


def _dialect_queries() -> dict[str, Pair]:
    """Syntax that the engine turns into Spark's own."""
    return {
        "quoted_identifiers": _sem('SELECT "n_name" AS "Nation Name", n."n_regionkey" + 1 AS "r" FROM "nation" n WHERE "n_name" <> \'"x"\''),
        "nulls_last_default": _sem("SELECT c_custkey, closed_count FROM customer ORDER BY closed_spend, c_custkey DESC LIMIT 25", "SELECT c_custkey, count(o_orderkey) AS closed_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY sum(o_totalprice) ASC NULLS LAST, c_custkey DESC LIMIT 25"),
        "nulls_last_in_windows": _sem("SELECT k, row_number() OVER (ORDER BY v, k) AS up, row_number() OVER (ORDER BY v DESC, k) AS down FROM (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer) t", "SELECT k, CAST(row_number() OVER (ORDER BY v NULLS LAST, k) AS INT) AS up, CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, k) AS INT) AS down FROM (SELECT c_custkey AS k, nullif(c_nationkey, 3) AS v FROM customer) t"),
        "unnest_beside_a_table": _sem("SELECT n_nationkey, x FROM nation, unnest(make_array(n_nationkey, n_regionkey, 7)) AS t(x)", "SELECT n_nationkey, x FROM (SELECT n_nationkey, unnest([n_nationkey, n_regionkey, 7]) AS x FROM nation)"),
        "series_as_tables": _sem("SELECT a.v AS a, b.v AS b FROM generate_series(1, 9, 2) AS a(v) JOIN range(4, 9) AS b(v) ON a.v < b.v", "SELECT a.v AS a, b.v AS b FROM (SELECT unnest([1, 3, 5, 7, 9])::BIGINT AS v) a JOIN range(4, 9) AS b(v) ON a.v < b.v"),
        "set_comparison": _sem("SELECT c_custkey, c_nationkey = ANY (SELECT s_nationkey FROM supplier) AS near FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5) AND c_acctbal <= ALL (SELECT s_acctbal + 9000 FROM supplier)", "SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier) AS near FROM customer WHERE c_acctbal > (SELECT min(s_acctbal) FROM supplier WHERE s_nationkey < 5) AND c_acctbal <= (SELECT min(s_acctbal) + 9000 FROM supplier)"),
        "ordered_aggregates": _sem("SELECT c_mktsegment, array_to_string(array_agg(c_custkey ORDER BY c_nationkey DESC, c_custkey), ',') AS ids, string_agg(c_name, ';' ORDER BY c_custkey DESC) AS names, first_value(c_custkey ORDER BY c_acctbal DESC) AS richest, last_value(c_custkey ORDER BY c_acctbal DESC) AS poorest FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_nationkey DESC, c_custkey) AS ids, string_agg(c_name, ';' ORDER BY c_custkey DESC) AS names, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_mktsegment"),
        "regex_operators_and_types": _sem("SELECT n_nationkey::varchar AS t, n_name ~ '1$' AS a, n_name !~ '1' AS b, n_name ~* 'nation_2' AS c, CAST(n_regionkey AS double precision) AS d, CAST(n_nationkey AS int8) AS e FROM nation", "SELECT n_nationkey::VARCHAR AS t, regexp_matches(n_name, '1$') AS a, NOT regexp_matches(n_name, '1') AS b, regexp_matches(n_name, 'nation_2', 'i') AS c, n_regionkey::DOUBLE AS d, n_nationkey::BIGINT AS e FROM nation"),
        "information_schema": _sem("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'guarded')", "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('region', 'r_name'), ('guarded', 'c_custkey'), ('guarded', 'c_name'), ('guarded', 'c_nationkey'), ('guarded', 'c_acctbal')) v(table_name, column_name)"),
    }


def _function_queries() -> dict[str, Pair]:
    return {
        "functions_text": _sem("SELECT n_nationkey, upper(n_name) AS u, concat(n_name, NULL, '-', n_nationkey) AS c, strpos(n_name, 'A') AS p, starts_with(n_name, 'A') AS s, ends_with(n_name, 'A') AS e, btrim('  x ') AS b, left(n_name, 2) AS l, right(n_name, 2) AS r, lpad(n_name, 12, '*') AS lp, reverse(n_name) AS rv, replace(n_name, 'A', 'b') AS rp, split_part(n_name, 'A', 1) AS sp, repeat('ab', 2) AS re, translate(n_name, 'AE', 'ae') AS tr, initcap(lower(n_name)) AS ic, chr(65) AS ch, ascii(n_name) AS a, octet_length(n_name) AS ol, levenshtein(n_name, 'CHINA') AS lv, to_hex(n_nationkey) AS hx FROM nation",
            "SELECT n_nationkey, upper(n_name) AS u, concat(n_name, NULL, '-', n_nationkey) AS c, strpos(n_name, 'A') AS p, starts_with(n_name, 'A') AS s, ends_with(n_name, 'A') AS e, trim('  x ') AS b, left(n_name, 2) AS l, right(n_name, 2) AS r, lpad(n_name, 12, '*') AS lp, reverse(n_name) AS rv, replace(n_name, 'A', 'b') AS rp, split_part(n_name, 'A', 1) AS sp, repeat('ab', 2) AS re, translate(n_name, 'AE', 'ae') AS tr, upper(lower(n_name)[1]) || list_aggregate(list_transform(range(2, len(n_name) + 1), lambda i: CASE WHEN n_name[i - 1] = ' ' THEN n_name[i] ELSE lower(n_name[i]) END), 'string_agg', '') AS ic, chr(65) AS ch, ascii(n_name) AS a, strlen(n_name) AS ol, levenshtein(n_name, 'CHINA') AS lv, lower(hex(n_nationkey)) AS hx FROM nation"),
        "functions_numbers": _sem("SELECT c_custkey, round(abs(c_acctbal), 2) AS ab, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(trunc(c_acctbal) AS BIGINT) AS tr, round(sqrt(abs(c_acctbal)), 6) AS sq, round(log(abs(c_acctbal) + 1), 6) AS lg, round(ln(abs(c_acctbal) + 1), 6) AS nl, round(power(2, 3), 1) AS pw, gcd(c_custkey, 12) AS gc, lcm(c_custkey, 12) AS lc, signum(c_acctbal) AS sg, round(cbrt(c_custkey), 6) AS cb, c_custkey % 7 AS md, factorial(5) AS fa, round(degrees(1.0), 6) AS dg, iszero(c_custkey) AS iz, nanvl(c_acctbal, 0) = c_acctbal AS nv FROM customer",
            "SELECT c_custkey, round(abs(c_acctbal), 2) AS ab, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(trunc(c_acctbal) AS BIGINT) AS tr, round(sqrt(abs(c_acctbal)), 6) AS sq, round(log10(abs(c_acctbal) + 1), 6) AS lg, round(ln(abs(c_acctbal) + 1), 6) AS nl, round(power(2, 3), 1) AS pw, CAST(gcd(c_custkey, 12) AS BIGINT) AS gc, CAST(lcm(c_custkey, 12) AS BIGINT) AS lc, CAST(sign(c_acctbal) AS DOUBLE) AS sg, round(cbrt(c_custkey), 6) AS cb, c_custkey % 7 AS md, CAST(factorial(5) AS BIGINT) AS fa, round(degrees(1.0), 6) AS dg, c_custkey = 0 AS iz, true AS nv FROM customer"),
        "functions_dates": _sem("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_part('year', o_orderdate) AS INT) AS y, to_unixtime(o_orderdate) AS ux, CAST(date_bin(interval '7' day, o_orderdate) AS DATE) AS bin, CAST(from_unixtime(86400) AS DATE) AS fu, make_date(2024, 2, 3) AS md, to_char(o_orderdate, 'yyyy-MM') AS tc, format_date('%Y/%m', o_orderdate) AS fd FROM orders",
            "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_part('year', o_orderdate) AS INT) AS y, CAST(epoch(o_orderdate) AS BIGINT) AS ux, CAST(time_bucket(INTERVAL 7 day, o_orderdate, TIMESTAMP '1970-01-01') AS DATE) AS bin, DATE '1970-01-02' AS fu, make_date(2024, 2, 3) AS md, strftime(o_orderdate, '%Y-%m') AS tc, strftime(o_orderdate, '%Y/%m') AS fd FROM orders"),
        "functions_arrays": _sem("SELECT n_nationkey AS k, array_to_string(make_array(n_nationkey, 2, 2, 3), ',') AS a, array_has(make_array(1, 2), n_nationkey) AS h, array_position(make_array(5, 6), 9) AS p, array_to_string(array_remove(make_array(2, 1, 2), 2), ',') AS r, array_to_string(array_remove_all(make_array(2, 1, 2), 2), ',') AS ra, array_to_string(array_slice(make_array(1, 2, 3, 4), 2, 3), ',') AS s, array_length(make_array(1, 2)) AS l, array_to_string(range(3), ',') AS g, array_to_string(array_replace(make_array(1, 2, 2), 2, 9), ',') AS rp, array_to_string(array_pop_back(make_array(1, 2, 3)), ',') AS pb, array_element(make_array(1, 2), 2) AS e, round(array_distance(make_array(1, 2), make_array(4, 6)), 3) AS d, array_to_string(string_to_array('a.b.c', '.'), '|') AS sa FROM nation",
            "SELECT n_nationkey AS k, n_nationkey || ',2,2,3' AS a, n_nationkey IN (1, 2) AS h, NULL AS p, '1,2' AS r, '1' AS ra, '2,3' AS s, 2 AS l, '0,1,2' AS g, '1,9,2' AS rp, '1,2' AS pb, 2 AS e, 5.0::DOUBLE AS d, 'a|b|c' AS sa FROM nation"),
        "functions_json": _sem("SELECT event_id, int64(json_extract(props, '$.k')) AS k, as_integer(json_extract(props, '$.k')) AS i, json_type(props) LIKE 'object%' AS o, json_value(props, '$.k') AS v FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, true AS o, json_extract_string(props, '$.k') AS v FROM events"),
        "functions_hashes_regex": _sem("SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, digest(n_name, 'sha256') AS d, regexp_like(n_name, '^[A-C]') AS rl, regexp_count(n_name, 'A') AS rc, regexp_replace(n_name, 'A', '_') AS r1, regexp_replace(n_name, 'A', '_', 'g') AS rg, regexp_contains(n_name, 'IN') AS rx, nullif(n_nationkey, 3) AS nf, coalesce(NULL, n_name) AS co, greatest(n_nationkey, 5) AS gr, nvl2(n_name, 1, 0) AS n2 FROM nation",
            "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, sha256(n_name) AS d, regexp_matches(n_name, '^[A-C]') AS rl, len(n_name) - len(replace(n_name, 'A', '')) AS rc, regexp_replace(n_name, 'A', '_') AS r1, regexp_replace(n_name, 'A', '_', 'g') AS rg, contains(n_name, 'IN') AS rx, nullif(n_nationkey, 3) AS nf, n_name AS co, greatest(n_nationkey, 5) AS gr, 1 AS n2 FROM nation"),
    }


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    q = rows.filter("vec_id = 1").first()["embedding"]
    return recall.vector_recall(rows, q, k=10).select("vec_id", F.round("distance", 5).alias("distance"))


def _tumbling(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    out = windows.tumbling(ev, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")])
    return out.select(F.col("window_start").cast("date").alias("day"), "event_type", "n", "v")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    return windows.sessions(ev, "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")]).groupBy("n").agg(F.count(F.lit(1)).alias("sessions"))


def _graph_question(spark: SparkSession, d: str) -> DataFrame:
    df = engine(spark, d).ask("order revenue by region name")
    return df.withColumn("order_revenue", F.round("order_revenue", 2))


def _cube_question(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).ask_cube("event cube: n by kind")


def _inspect(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).inspect(
        "MATCH (a:MODEL)-[r:RELATIONSHIP]->(b:MODEL {name: $to}) WHERE r.cardinality = 'MANY_TO_ONE' RETURN a.name AS source, r.name AS relation ORDER BY relation",
        {"to": "nation"},
    )


def _top_weight(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    place = W.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("place", F.row_number().over(place)).filter("place <= 3").select("o_orderstatus", "o_orderkey", "place")


def _all() -> dict[str, Pair]:
    from sparkloom.plans import catalogue_more

    return {
        **catalogue_more.every(),
        **_model_queries(), **_cube_queries(), **_graph_queries(), **_host_queries(), **_dialect_queries(), **_function_queries(),
        "vector_recall": (_nearest, "SELECT b.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 1 ORDER BY 2, 1 LIMIT 10"),
        "graph_question": (_graph_question, "SELECT r_name AS region_name, round(sum(o_totalprice), 2) AS order_revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
        "cube_question": (_cube_question, "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1"),
        "graph_inspect": (_inspect, "SELECT source, relation FROM (VALUES ('customer', 'customer_nation'), ('supplier', 'supplier_nation')) v(source, relation)"),
        "stream_tumbling_batch": (_tumbling, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2"),
        "stream_session_batch": (_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 hour THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM k GROUP BY 1, 2) SELECT n, count(*) AS sessions FROM c GROUP BY n"),
        "top_per_group": (_top_weight, "SELECT o_orderstatus, o_orderkey, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3"),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by customer region and month through the model layer."""
    sql = "SELECT customer_region, date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2"
    return engine(spark, sf_dir).query(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
