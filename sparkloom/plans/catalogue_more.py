"""More registered queries: calculations, rules, cubes, graph requests, functions, governance and sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.registry import RemoteFunction
from sparkloom.operators import policy, recall
from sparkloom.operators.graph import GraphError
from sparkloom.plans import catalogue as c
from sparkloom.plans.manifest import Manifest, spark_type
from sparkloom.session import Engine
from sparkloom.sources import readers

ORDERS = "orders WHERE o_custkey = c_custkey"
NATION = "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def model_queries() -> dict[str, c.Pair]:
    s = c._sem
    return {
        "to_many_two_paths": s("SELECT c_custkey, round(spread, 2) AS spread FROM customer", f"SELECT c_custkey, round((SELECT sum(o_totalprice) FROM {ORDERS}) - coalesce((SELECT sum(o_totalprice) FROM {ORDERS} AND o_orderstatus = 'F'), 0), 2) AS spread FROM customer"),
        "to_many_two_columns_one_path": s("SELECT c_custkey, round(total_spend, 2) AS total_spend, order_count, round(largest_order, 2) AS largest_order FROM customer", f"SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) FROM {ORDERS}) AS total_spend, (SELECT count(*) FROM {ORDERS}) AS order_count, (SELECT round(max(o_totalprice), 2) FROM {ORDERS}) AS largest_order FROM customer"),
        "to_many_two_depths": s("SELECT c_custkey, round(spend_per_line, 4) AS spend_per_line FROM customer", f"SELECT c_custkey, round((SELECT sum(o_totalprice) FROM {ORDERS}) / nullif((SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey), 0), 4) AS spend_per_line FROM customer"),
        "to_many_filtered_aggregate": s("SELECT c_custkey, large_orders FROM customer", f"SELECT c_custkey, (SELECT count(*) FROM {ORDERS} AND o_totalprice > 200000) AS large_orders FROM customer"),
        "to_many_beside_own_columns": s("SELECT c_custkey, round(weighted_spend, 2) AS weighted_spend FROM customer", f"SELECT c_custkey, round(c_nationkey * (SELECT sum(o_totalprice) FROM {ORDERS}), 2) AS weighted_spend FROM customer"),
        "row_access_over_to_many": s("SELECT c_custkey, round(visible_spend, 2) AS visible_spend, visible_count FROM customer", f"SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) FROM {ORDERS} AND o_orderstatus = 'P') AS visible_spend, (SELECT count(*) FROM {ORDERS} AND o_orderstatus = 'P') AS visible_count FROM customer", status="'P'"),
        "row_access_over_to_many_default": s("SELECT sum(visible_count) AS n FROM customer", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'"),
        "own_cte_hides_a_model": s("WITH orders AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT k, n FROM orders WHERE n > 12"),
        "model_beside_its_alias": s("SELECT a.n_name AS x, nation.n_name AS y FROM nation a JOIN nation ON a.n_regionkey = nation.n_regionkey AND a.n_nationkey < nation.n_nationkey"),
        "time_zone_of_a_query": (_zoned, "SELECT CAST(9 AS INT) AS tokyo, CAST(0 AS INT) AS after"),
        "set_difference": s("SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800"),
        "intersect_all_except_all": s("(SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) EXCEPT ALL SELECT r_regionkey FROM region"),
        "cube_grouping": s("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)"),
    }


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    """The hour of the epoch in Tokyo within one query, and in the session (UTC here) after it."""
    e = c.engine(spark, d)
    one = "SELECT CAST(date_format(timestamp_seconds(0), 'HH') AS INT) AS h FROM region LIMIT 1"
    before = spark.conf.get("spark.sql.session.timeZone")
    tokyo = e.query(one, properties={"x-sparkloom-timezone": "Asia/Tokyo"}).withColumnRenamed("h", "tokyo")
    after = 0 if spark.conf.get("spark.sql.session.timeZone") == before else 1
    return tokyo.withColumn("after", F.lit(after))


def cube_queries() -> dict[str, c.Pair]:
    day, by = "CAST(date_trunc('{g}', o_orderdate) AS DATE) AS ordered__{g}", {"measures": ["orders_n", "revenue"]}
    out = {}
    for g in ("year", "quarter", "month", "week", "day"):
        out[f"cube_grain_{g}"] = c._cube({"cube": "order_cube", **by, "timeDimensions": [{"dimension": "ordered", "granularity": g}]}, f"SELECT {day.format(g=g)}, count(*) AS orders_n, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
    for g in ("hour", "minute"):
        out[f"cube_grain_{g}"] = (_fine(g), f"SELECT epoch(date_trunc('{g}', ts))::BIGINT AS at, count(*) AS n FROM events GROUP BY 1")
    tests = {
        "eq": ("status", "F", "o_orderstatus = 'F'"), "neq": ("status", "F", "o_orderstatus <> 'F'"), "in": ("region", ["REGION_1", "ASIA"], "r_name IN ('REGION_1', 'ASIA')"),
        "not_in": ("status", ["F", "P"], "o_orderstatus NOT IN ('F', 'P')"), "gt": ("ordered", "1996-01-01", "o_orderdate > TIMESTAMP '1996-01-01'"),
        "gte": ("ordered", "1996-01-01", "o_orderdate >= TIMESTAMP '1996-01-01'"), "lt": ("ordered", "1996-01-01", "o_orderdate < TIMESTAMP '1996-01-01'"),
        "lte": ("ordered", "1996-01-01", "o_orderdate <= TIMESTAMP '1996-01-01'"), "contains": ("region", "A", "r_name LIKE '%A%'"), "starts_with": ("region", "A", "r_name LIKE 'A%'"),
        "is_null": ("region", None, "r_name IS NULL"), "is_not_null": ("region", None, "r_name IS NOT NULL"),
    }
    for op, (member, value, where) in tests.items():
        f = {"dimension": member, "operator": op} | ({} if value is None else {"value": value})
        out[f"cube_filter_{op}"] = c._cube({"cube": "order_cube", "measures": ["orders_n"], "filters": [f]}, f"SELECT count(*) AS orders_n FROM orders {NATION} JOIN region ON n_regionkey = r_regionkey WHERE {where}")
    return out


def _fine(grain: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = c.engine(spark, d).cube_query({"cube": "event_cube", "measures": ["n"], "timeDimensions": [{"dimension": "at", "granularity": grain}]})
        return out.select(F.unix_timestamp(F.col(f"at__{grain}").cast("timestamp")).alias("at"), "n")

    return run


def graph_queries() -> dict[str, c.Pair]:
    g = c._graph
    calc = lambda name, kind, text, **x: {"name": name, "kind": kind, "expression": text, **x}
    return {
        "graph_dimension_calculation": g({"metrics": ["order_n"], "calculations": [calc("band", "dimension", "CASE WHEN orders.o_totalprice >= 250000 AND customer.c_mktsegment = 'BUILDING' THEN nation.n_name ELSE customer.c_mktsegment END", inputs=[
            {"model": "orders", "field": "o_totalprice"}, {"model": "customer", "field": "c_mktsegment", "relationshipPath": ["orders_customer"]}, {"model": "nation", "field": "n_name"}])]},
            f"SELECT CASE WHEN o_totalprice >= 250000 AND c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS band, count(*) AS order_n FROM orders {NATION} GROUP BY 1"),
        "graph_metric_calculation": g({"metrics": ["order_n"], "dimensions": ["nation_name"], "calculations": [calc("twice", "metric", "sum(orders.o_totalprice) * 2"), calc("owed", "metric", "sum(orders.o_totalprice * customer.c_acctbal) / count(orders.o_orderkey)"), calc("mean", "metric", "order_revenue / order_n")]},
            f"SELECT n_name AS nation_name, count(*) AS order_n, round(sum(o_totalprice) * 2, 2) AS twice, round(sum(o_totalprice * c_acctbal) / count(*), 2) AS owed, round(sum(o_totalprice) / count(*), 2) AS mean FROM orders {NATION} GROUP BY 1"),
        "graph_post_metric_over_facts": g({"facts": [{"source": "orders", "metrics": ["order_n"]}, {"source": "supplier", "metrics": ["supplier_balance"]}], "dimensions": ["nation_name"], "calculations": [calc("each", "post_metric", "supplier_balance / nullif(order_n, 0)")]},
            f"SELECT coalesce(a.nation_name, b.nation_name) AS nation_name, order_n, round(balance, 2) AS supplier_balance, round(balance / nullif(order_n, 0), 2) AS each FROM (SELECT n_name AS nation_name, count(*) AS order_n FROM orders {NATION} GROUP BY 1) a FULL JOIN (SELECT n_name AS nation_name, sum(s_acctbal) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b ON a.nation_name = b.nation_name"),
        "graph_calculation_over_fanout": g({"metrics": ["order_revenue"], "fanoutMode": "repeat", "calculations": [calc("status_flag", "dimension", "concat(orders.o_orderstatus, ':', lineitem.l_returnflag)", inputs=[{"model": "orders", "field": "o_orderstatus"}, {"model": "lineitem", "field": "l_returnflag", "relationshipPath": ["lineitem_orders"]}])]},
            "SELECT status_flag, round(sum(o_totalprice), 2) AS order_revenue FROM (SELECT DISTINCT o_orderkey, o_totalprice, o_orderstatus || ':' || l_returnflag AS status_flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1 UNION ALL SELECT NULL, sum(o_totalprice) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0"),
        "graph_attributes_and_entities": g({"metrics": ["order_n"], "attributes": [{"model": "customer", "field": "c_mktsegment", "alias": "segment"}], "entityGrain": ["nation"]},
            f"SELECT c_mktsegment AS segment, n_nationkey, count(*) AS order_n FROM orders {NATION} GROUP BY 1, 2"),
        "graph_local_key": g({"metrics": ["order_n"], "dimensions": ["buyer"]}, "SELECT o_custkey AS buyer, count(*) AS order_n FROM orders GROUP BY 1"),
        "graph_wildcards": g({"anchor": "supplier", "metrics": "*", "dimensions": "*"}, "SELECT n_name AS nation_name, r_name AS region_name, round(sum(s_acctbal), 2) AS supplier_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
        "graph_bridge_proportional": g({"metrics": ["order_revenue"], "dimensions": ["brand"], "bridge": {"model": "order_parts", "mode": "proportional", "allocation": "amount"}},
            "WITH p AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey, p_brand, sum(a) / sum(sum(a)) OVER (PARTITION BY l_orderkey) AS s FROM p JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT p_brand AS brand, round(sum(coalesce(o_totalprice * s, 0)), 2) AS order_revenue FROM orders LEFT JOIN w ON l_orderkey = o_orderkey GROUP BY 1"),
        "graph_roles": (_roles, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
        "graph_discovery": (_discovery, "SELECT * FROM (VALUES ('region_name', 'OK'), ('nation_name', 'OK'), ('return_flag', 'NO_SAFE_PATH'), ('brand', 'NO_SAFE_PATH'), ('event_kind', 'NO_SAFE_PATH'), ('buyer', 'OK')) v(dimension, state)"),
        "graph_refusals": (_refusals, "SELECT * FROM (VALUES ('anchor', 'GRAPH_ANCHOR_NOT_FOUND'), ('unbound', 'GRAPH_METRIC_NOT_BOUND'), ('undeclared', 'GRAPH_CALCULATION_INPUT_UNDECLARED'), ('unused', 'GRAPH_CALCULATION_INPUT_UNUSED'), ('bare', 'GRAPH_CALCULATION_INPUT_QUALIFICATION_REQUIRED'), ('scalar', 'GRAPH_METRIC_CALCULATION_UNSAFE'), ('outside', 'GRAPH_METRIC_CALCULATION_FIELD_NOT_AGGREGATED'), ('branches', 'GRAPH_MULTIPLE_FANOUT_BRANCHES_UNSUPPORTED'), ('bridge', 'GRAPH_BRIDGE_POLICY_INVALID'), ('reachable', 'GRAPH_INCLUDE_REACHABLE_INVALID'), ('entity', 'GRAPH_ENTITY_GRAIN_NOT_FOUND'), ('deep', 'GRAPH_FANOUT_ALLOCATION_REQUIRED'), ('day', 'GRAPH_METRIC_DIMENSION_BLOCKED')) v(request, code)"),
    }


def _roles(spark: SparkSession, d: str) -> DataFrame:
    """Two relationships between the same models: the role picks one."""
    raw = {"models": [
        {"name": "customer", "tableReference": {"table": "customer"}, "primaryKey": "c_custkey", "columns": c._cols("c_custkey|bigint", "c_nationkey|int")},
        {"name": "nation", "tableReference": {"table": "nation"}, "primaryKey": "n_nationkey", "columns": c._cols("n_nationkey|int", "n_name|varchar")}],
        "relationships": [
            {"name": "by_nation", "models": ["customer", "nation"], "joinType": "MANY_TO_ONE", "condition": "customer.c_nationkey = nation.n_nationkey"},
            {"name": "by_number", "models": ["customer", "nation"], "joinType": "MANY_TO_ONE", "condition": "customer.c_custkey = nation.n_nationkey"}],
        "metrics": [{"name": "n", "model": "customer", "expression": "count(c_custkey)"}], "graph": {"relationshipRoles": {"by_nation": "home", "by_number": "number"}}}
    e = Engine(spark)
    for t in ("customer", "nation"):
        e.register(t, spark.read.parquet(f"{d}/{t}.parquet"))
    return e.load(raw).graph_query({"metrics": ["n"], "attributes": [{"model": "nation", "field": "n_name", "role": "home"}]})


def _discovery(spark: SparkSession, d: str) -> DataFrame:
    found = c.engine(spark, d).graph_discover("orders")["orders"]["dimensions"]
    return spark.createDataFrame(sorted(found.items()), "dimension string, state string")


def _refusals(spark: SparkSession, d: str) -> DataFrame:
    """The code with which each unsafe request is refused."""
    e, n = c.engine(spark, d), {"metrics": ["order_n"]}
    calc = lambda kind, text, **x: {**n, "calculations": [{"name": "x", "kind": kind, "expression": text, **x}]}
    asked = {
        "anchor": {**n, "anchor": "nothing"}, "unbound": {**n, "anchor": "customer"}, "undeclared": calc("dimension", "concat(orders.o_orderstatus, customer.c_name)", inputs=[{"model": "orders", "field": "o_orderstatus"}]),
        "unused": calc("dimension", "orders.o_orderstatus", inputs=[{"model": "orders", "field": "o_orderstatus"}, {"model": "customer", "field": "c_name"}]), "bare": calc("dimension", "lower(o_orderstatus)"),
        "scalar": calc("metric", "orders.o_totalprice + 1"), "outside": calc("metric", "sum(orders.o_totalprice) + orders.o_orderkey"),
        "branches": {"facts": [{"source": "orders", "metrics": ["order_n"]}], "fanoutMode": "repeat", "attributes": ["lineitem.l_returnflag", "order_parts.l_partkey"], "pathHints": {"l_returnflag": ["lineitem_orders"], "l_partkey": ["shares_orders"]}},
        "bridge": {**n, "dimensions": ["brand"], "bridge": {"model": "order_parts", "mode": "other", "allocation": "amount"}}, "reachable": {**n, "includeReachable": "yes"}, "entity": {**n, "entityGrain": ["nothing"]},
        "deep": {"facts": [{"source": "orders", "metrics": ["order_n"]}], "dimensions": ["region_name"], "maxDepth": 2}, "day": {"metrics": ["dated_n"], "attributes": ["orders.o_orderdate"]},
    }
    rows = []
    for name, request in asked.items():
        try:
            e.graph_query(request)
            code = "OK"
        except GraphError as x:
            code = x.code
        rows.append((name, code))
    return spark.createDataFrame(rows, "request string, code string")


def function_queries() -> dict[str, c.Pair]:
    """Functions over columns, in groups of the registries' blocks."""
    s = c._sem
    return {
        "functions_conditional": s("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, nvl(nullif(c_nationkey, 4), 99) AS b, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, arrow_cast(c_nationkey, 'Utf8') AS t, nvl2(nullif(c_nationkey, 5), 1, 0) AS n FROM customer",
            "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, coalesce(nullif(c_nationkey, 4), 99) AS b, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CAST(c_nationkey AS VARCHAR) AS t, CASE WHEN nullif(c_nationkey, 5) IS NULL THEN 0 ELSE 1 END AS n FROM customer"),
        "functions_text_columns": s("SELECT p_partkey, lower(p_brand) AS lo, initcap(p_name) AS ic, reverse(p_name) AS rv, lpad(p_name, 12, '*') AS lp, rpad(p_name, 12, '-') AS rp, substr(p_name, 2, 3) AS sb, replace(p_name, 'e', '3') AS re, translate(p_name, 'aeiou', 'AEIOU') AS tr, split_part(p_name, ' ', 2) AS sp, ascii(p_name) AS asc_, repeat(p_type, 2) AS rt, char_length(p_name) AS n, octet_length(p_brand) AS o, levenshtein(p_name, p_type) AS le, substr_index(p_name, ' ', 1) AS si, contains(p_name, 'ring') AS ct, ltrim(concat('  ', p_type)) AS lt, position('r' IN p_name) AS ps, chr(65 + p_size % 26) AS ch FROM part",
            "SELECT p_partkey, lower(p_brand) AS lo, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic, reverse(p_name) AS rv, lpad(p_name, 12, '*') AS lp, rpad(p_name, 12, '-') AS rp, substr(p_name, 2, 3) AS sb, replace(p_name, 'e', '3') AS re, translate(p_name, 'aeiou', 'AEIOU') AS tr, split_part(p_name, ' ', 2) AS sp, ascii(p_name) AS asc_, repeat(p_type, 2) AS rt, length(p_name)::INT AS n, strlen(p_brand)::INT AS o, levenshtein(p_name, p_type)::INT AS le, split_part(p_name, ' ', 1) AS si, contains(p_name, 'ring') AS ct, ltrim(concat('  ', p_type)) AS lt, position('r' IN p_name)::INT AS ps, chr((65 + p_size % 26)::INT) AS ch FROM part"),
        "functions_math_columns": s("SELECT p_partkey, round(exp(p_size / 50.0D), 6) AS e, round(ln(p_retailprice), 6) AS l, round(log2(p_retailprice), 6) AS l2, round(log(10, p_retailprice), 6) AS lb, round(cbrt(p_size), 6) AS c, round(degrees(p_size), 4) AS d, round(radians(p_size), 6) AS r, sign(p_size - 25) AS s, p_size % 7 AS m, gcd(p_size, 12) AS g, lcm(p_size, 4) AS lc, factorial(p_size % 10) AS f, round(atan2(p_size, 3), 6) AS a, round(sinh(p_size / 50.0D), 6) AS sh, round(cot(p_size), 6) AS co, iszero(p_size % 5) AS z, round(power(p_size, 1.5D), 4) AS pw, bit_count(p_size) AS bc, div(p_size, 4) AS dv FROM part",
            "SELECT p_partkey, round(exp(p_size / 50.0), 6) AS e, round(ln(p_retailprice), 6) AS l, round(log2(p_retailprice), 6) AS l2, round(log10(p_retailprice), 6) AS lb, round(cbrt(p_size), 6) AS c, round(degrees(p_size), 4) AS d, round(radians(p_size), 6) AS r, sign(p_size - 25)::DOUBLE AS s, p_size % 7 AS m, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 4)::BIGINT AS lc, factorial(p_size % 10)::BIGINT AS f, round(atan2(p_size, 3), 6) AS a, round((exp(p_size / 50.0) - exp(-p_size / 50.0)) / 2, 6) AS sh, round(cot(p_size), 6) AS co, p_size % 5 = 0 AS z, round(pow(p_size, 1.5), 4) AS pw, bit_count(p_size)::INT AS bc, (p_size // 4)::BIGINT AS dv FROM part"),
        "functions_date_columns": s("SELECT event_id, date_part('dow', ts) AS dow, extract(dow FROM ts) AS dow2, CAST(date_part('hour', ts) AS INT) AS h, CAST(date_part('doy', ts) AS INT) AS doy, CAST(date_trunc('hour', ts) AS DATE) AS t, to_unixtime(ts) AS u, to_char(ts, 'yyyy-MM') AS c, format_date('%Y%m%d', CAST(ts AS DATE)) AS f, last_day(CAST(ts AS DATE)) AS ld, date_add(CAST(ts AS DATE), 40) AS da, to_unixtime(date_bin(interval '15' minute, ts)) AS b, timestamp_diff(ts, timestamp'2024-01-01 00:00:00', HOUR) AS td, make_date(2024, 2, 1 + CAST(event_id % 20 AS INT)) AS md, to_unixtime(timestamp_add(ts, interval 90 minute)) AS ta FROM events",
            "SELECT event_id, extract(dow FROM ts)::INT AS dow, extract(dow FROM ts)::INT AS dow2, extract(hour FROM ts)::INT AS h, extract(doy FROM ts)::INT AS doy, date_trunc('hour', ts)::DATE AS t, floor(epoch(ts))::BIGINT AS u, strftime(ts, '%Y-%m') AS c, strftime(ts, '%Y%m%d') AS f, last_day(ts::DATE) AS ld, (ts::DATE + 40)::DATE AS da, floor(epoch(time_bucket(INTERVAL 15 minute, ts)))::BIGINT AS b, date_sub('hour', TIMESTAMP '2024-01-01', ts) AS td, make_date(2024, 2, (1 + event_id % 20)::BIGINT) AS md, floor(epoch(ts + INTERVAL 90 minute))::BIGINT AS ta FROM events"),
        "functions_array_columns": s("SELECT n_nationkey AS k, array_to_string(array_sort(make_array(n_nationkey, n_regionkey, 9)), ',') AS a, array_has(make_array(n_nationkey, n_regionkey), 3) AS h, array_length(range(n_nationkey)) AS l, array_position(make_array(n_regionkey, n_nationkey), n_nationkey) AS p, array_to_string(array_remove_all(make_array(n_nationkey, 3, n_regionkey), 3), ',') AS r, array_to_string(array_slice(range(10), n_regionkey + 1, n_regionkey + 3), ',') AS s, array_to_string(generate_series(n_regionkey, n_nationkey, 5), ',') AS g, array_element(make_array(7, n_nationkey), 2) AS e, array_to_string(array_concat(make_array(n_nationkey), make_array(1)), ',') AS c, array_to_string(array_distinct(make_array(n_nationkey, n_regionkey)), ',') AS d, array_to_string(array_replace_all(make_array(n_nationkey, n_regionkey), n_regionkey, -1), ',') AS rp, round(array_distance(make_array(n_nationkey, 1), make_array(n_regionkey, 2)), 6) AS di, array_to_string(array_reverse(make_array(n_nationkey, 1)), ',') AS rv, array_has_any(make_array(n_nationkey), make_array(1, 2)) AS ha, array_ndims(make_array(make_array(n_nationkey))) AS nd, array_to_string(string_to_array(n_name, '_'), '-') AS st FROM nation",
            "SELECT n_nationkey AS k, array_to_string(list_sort([n_nationkey, n_regionkey, 9]), ',') AS a, list_contains([n_nationkey, n_regionkey], 3) AS h, n_nationkey AS l, list_position([n_regionkey, n_nationkey], n_nationkey)::BIGINT AS p, array_to_string(list_filter([n_nationkey, 3, n_regionkey], lambda x: x <> 3), ',') AS r, array_to_string(range(n_regionkey, n_regionkey + 3), ',') AS s, array_to_string(generate_series(n_regionkey, n_nationkey, 5), ',') AS g, n_nationkey AS e, n_nationkey || ',1' AS c, CASE WHEN n_nationkey = n_regionkey THEN n_nationkey::VARCHAR ELSE n_nationkey || ',' || n_regionkey END AS d, CASE WHEN n_nationkey = n_regionkey THEN '-1,-1' ELSE n_nationkey || ',-1' END AS rp, round(sqrt((n_nationkey - n_regionkey) ** 2 + 1), 6) AS di, '1,' || n_nationkey AS rv, n_nationkey IN (1, 2) AS ha, 2 AS nd, replace(n_name, '_', '-') AS st FROM nation"),
        "functions_json_columns": s("SELECT event_id, json_value(props, '$.k') AS v, int64(json_extract(props, '$.k')) + 1 AS n, lax_string(json_extract(props, '$.k')) AS ls, is_integer(json_extract(props, '$.k')) AS i, json_object('id', event_id) AS o, array_to_string(json_keys(props), ',') AS ks, as_double(json_extract(props, '$.k')) AS d, json_value(props, '$.none') AS z, get_path(props, 'k') AS gp FROM events",
            "SELECT event_id, json_extract_string(props, '$.k') AS v, json_extract_string(props, '$.k')::BIGINT + 1 AS n, json_extract_string(props, '$.k') AS ls, json_extract_string(props, '$.k') IS NOT NULL AS i, '{\"id\":' || event_id || '}' AS o, 'k' AS ks, json_extract_string(props, '$.k')::DOUBLE AS d, NULL AS z, json_extract_string(props, '$.k') AS gp FROM events"),
        "functions_regex_columns": s("SELECT o_orderkey, regexp_replace(o_orderpriority_text, '[A-Z]', '*') AS f, regexp_replace(o_orderpriority_text, '[A-Z]', '*', 'g') AS a, array_to_string(regexp_match(o_orderpriority_text, '([0-9])-([A-Z]+)'), '/') AS m, regexp_contains(o_orderpriority_text, '^[12]') AS c, regexp_count(o_orderpriority_text, 'E') AS n, regexp_like(o_orderpriority_text, 'urgent', 'i') AS l FROM (SELECT o_orderkey, CASE WHEN urgent THEN '1-URGENT' ELSE concat('3-', customer_name) END AS o_orderpriority_text FROM orders) t",
            "SELECT o_orderkey, regexp_replace(p, '[A-Z]', '*') AS f, regexp_replace(p, '[A-Z]', '*', 'g') AS a, regexp_extract(p, '([0-9])-([A-Z]+)', 1) || '/' || regexp_extract(p, '([0-9])-([A-Z]+)', 2) AS m, regexp_matches(p, '^[12]') AS c, length(p) - length(replace(p, 'E', '')) AS n, regexp_matches(p, 'urgent', 'i') AS l FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' ELSE '3-' || c_name END AS p FROM orders JOIN customer ON o_custkey = c_custkey)"),
        "functions_hash_columns": s("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, to_hex(c_name) AS h, to_base64(c_mktsegment) AS b, cast(from_hex(to_hex(c_name)) AS string) AS r, sha224(c_name) <> sha384(c_name) AS d, byte_length(c_name) AS n FROM customer",
            "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name)) AS h, to_base64(c_mktsegment::BLOB) AS b, c_name AS r, true AS d, strlen(c_name)::INT AS n FROM customer"),
        "functions_safe_columns": s("SELECT p_partkey, safe_divide(p_size, p_size - 11) AS d, safe_add(p_size, 1) AS a, safe_subtract(p_size, 1) AS s, safe_multiply(p_size, 2) AS m, safe_negate(p_size) AS n, starts_with(p_name, 'red') AS sw, ends_with(p_name, 'ring') AS ew, strpos(p_name, 'e') AS sp, edit_distance(p_brand, 'Brand#10') AS ed, contains_substr(p_type, 'econ') AS cs, array_to_string(to_code_points(p_brand), ' ') AS cp FROM part",
            "SELECT p_partkey, p_size / nullif(p_size - 11, 0) AS d, p_size + 1 AS a, p_size - 1 AS s, p_size * 2 AS m, -p_size AS n, starts_with(p_name, 'red') AS sw, ends_with(p_name, 'ring') AS ew, strpos(p_name, 'e')::INT AS sp, levenshtein(p_brand, 'Brand#10')::INT AS ed, contains(lower(p_type), 'econ') AS cs, array_to_string(list_transform(string_split(p_brand, ''), lambda x: ascii(x)), ' ') AS cp FROM part"),
        "functions_aggregate_columns": s("SELECT c_mktsegment, countif(c_acctbal > 0) AS ci, logical_and(c_acctbal > -2000) AS la, logical_or(c_acctbal > 9990) AS lo, round(stddev(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 2) AS vs, round(median(c_acctbal), 3) AS md, array_length(array_agg(c_custkey)) AS n, length(group_concat(c_name, ';')) AS gc, round(regr_slope(c_acctbal, c_custkey), 8) AS rs, bool_or(c_nationkey = 3) AS bo, approx_distinct(c_nationkey) > 20 AS ad, min_by(c_custkey, c_acctbal * 1000000 + c_custkey) AS mb FROM customer GROUP BY c_mktsegment",
            "SELECT c_mktsegment, count_if(c_acctbal > 0)::BIGINT AS ci, bool_and(c_acctbal > -2000) AS la, bool_or(c_acctbal > 9990) AS lo, round(stddev_samp(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 2) AS vs, round(median(c_acctbal), 3) AS md, count(*)::INT AS n, length(string_agg(c_name, ';'))::INT AS gc, round(regr_slope(c_acctbal, c_custkey), 8) AS rs, bool_or(c_nationkey = 3) AS bo, approx_count_distinct(c_nationkey) > 20 AS ad, arg_min(c_custkey, c_acctbal * 1000000 + c_custkey) AS mb FROM customer GROUP BY c_mktsegment"),
        "user_functions": (_user_functions, "SELECT c_mktsegment, round(sum(c_acctbal / 1.2), 2) AS net, CAST(max(c_acctbal) - min(c_acctbal) AS DOUBLE) AS spread FROM customer GROUP BY 1"),
    }


def _user_functions(spark: SparkSession, d: str) -> DataFrame:
    """A SQL function that Catalyst inlines, and a pandas aggregate."""
    import pandas as pd

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    e = c.engine(spark, d)
    e.define_function(RemoteFunction("demo_net", "scalar", "double", ("v", "tax"), ("double", "double")), "v / (1 + tax)")
    e.define_function(RemoteFunction("demo_spread", "aggregate", "double", ("v",), ("double",)), spread)
    net = e.query("SELECT c_mktsegment, round(sum(demo_net(c_acctbal, 0.2D)), 2) AS net FROM customer GROUP BY c_mktsegment")
    return net.join(e.query("SELECT c_mktsegment, demo_spread(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment"), "c_mktsegment")


def governance_queries() -> dict[str, c.Pair]:
    return {
        "policy_decisions": (_decisions, "SELECT * FROM (VALUES ('plain', 'OK'), ('cte', 'OK'), ('hidden table in a text', 'OK'), ('qualified', 'OK'), ('other schema', 'TABLE_NOT_ALLOWED'), ('unknown', 'TABLE_NOT_ALLOWED'), ('subquery', 'TABLE_NOT_ALLOWED'), ('write', 'READ_ONLY'), ('two', 'SINGLE_STATEMENT_REQUIRED'), ('denied', 'FUNCTION_DENIED'), ('denied alias', 'FUNCTION_DENIED'), ('blank', 'EMPTY_STATEMENT'), ('range', 'TABLE_FUNCTION_DENIED')) v(statement, code)"),
        "policy_limit_clamp": (lambda spark, d: c.engine(spark, d).query(policy.clamp_limit("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 10", 7)), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 10"),
        "policy_strict_query": (_strict, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
        "audit_chain": (_audit, "SELECT 3 AS lines, true AS whole, false AS after_change"),
        "manifest_extraction": (_extraction, "SELECT * FROM (VALUES ('big_buyers', 'customer'), ('big_buyers', 'orders'), ('big_buyers', 'nation'), ('big_buyers', 'region'), ('region', 'region')) v(asked, model) WHERE asked <> 'big_buyers' OR model IN ('customer', 'orders')"),
        "permission_diagnosis": (_denials, "SELECT * FROM (VALUES ('1', true), ('4', false)) v(level, denied)"),
        "type_names": (_types, "SELECT * FROM (VALUES ('int8', 'bigint'), ('uint32', 'bigint'), ('varchar(10)', 'string'), ('numeric(12,2)', 'decimal(12,2)'), ('double', 'double'), ('float4', 'float'), ('timestamptz', 'timestamp'), ('datetime', 'timestamp_ntz'), ('array<int4>', 'array<int>'), ('struct<a int, b varchar>', 'struct<a:int,b:string>'), ('bool', 'boolean'), ('bytea', 'binary'), ('date', 'date'), ('ubigint', 'decimal(20,0)'), ('no such type', 'string')) v(name, type)"),
        "schema_drift": (_drift, "SELECT * FROM (VALUES ('added', 'd', false), ('removed', 'a', true), ('type_changed', 'b', true), ('partition_changed', '', true)) v(change, col, breaking)"),
        "list_tables": (lambda spark, d: spark.createDataFrame([(t,) for t in c.engine(spark, d).tables()], "name string"), "SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events')) v(name)"),
        "function_records": (_function_records, "SELECT * FROM (VALUES ('sum', 'aggregate'), ('rank', 'window'), ('array_has', 'scalar'), ('upper', 'scalar'), ('countif', 'aggregate')) v(name, kind)"),
        "sink_json_rows": (lambda spark, d: readers.to_json_rows(c.engine(spark, d).query("SELECT r_regionkey, nullif(r_name, 'ASIA') AS n FROM region")), "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"n\":' || CASE WHEN r_name = 'ASIA' THEN 'null' ELSE '\"' || r_name || '\"' END || '}' AS value FROM region"),
        "sink_arrow": (_arrow, "SELECT n_nationkey, n_name FROM nation"),
        "source_csv": (_csv, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
        "source_json_lines": (_json_lines, "SELECT n_nationkey, n_name FROM nation"),
        "source_json_array": (lambda spark, d: readers.read_rows(spark, json.dumps([{"a": k, "b": f"x{k}"} for k in range(4)]), "a long, b string"), "SELECT a, 'x' || a AS b FROM range(4) t(a)"),
        "directory_discovery": (lambda spark, d: readers.discover(spark, d)["region"], "SELECT * FROM region"),
        "token_recall": (lambda spark, d: recall.token_recall(spark.read.parquet(f"{d}/part.parquet"), "small ring or widget", text="p_name", k=40).select("p_name", "score"),
            "WITH s AS (SELECT p_name, CAST(len(list_filter(list_distinct(string_split(p_name, ' ')), lambda w: w IN ('small', 'ring', 'or', 'widget'))) + CASE WHEN contains('small ring or widget', p_name) OR contains(p_name, 'small ring or widget') THEN 5 ELSE 0 END AS INT) AS score FROM part) SELECT p_name, score FROM s WHERE score > 0 ORDER BY score DESC, p_name LIMIT 40"),
        "graph_inspect_columns": (lambda spark, d: c.engine(spark, d).inspect("MATCH (m:MODEL)-[:HAS_COLUMN]->(k:COLUMN) WHERE m.name = 'nation' AND k.properties.type = 'int' RETURN k.name AS name ORDER BY name"), "SELECT column_name AS name FROM (DESCRIBE nation) WHERE column_type = 'INTEGER'"),
    }


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a strict read-only policy says of each statement."""
    rules = policy.Policy(strict=True, denied_functions=frozenset({"power", "uuid"}))
    asked = {
        "plain": "SELECT * FROM orders", "cte": "WITH t AS (SELECT * FROM orders) SELECT * FROM t", "hidden table in a text": "SELECT 'FROM secrets' AS x FROM region -- FROM secrets",
        "qualified": "SELECT o.o_orderkey FROM orders o", "other schema": "SELECT * FROM other_catalog.other_db.orders", "unknown": "SELECT * FROM secrets", "subquery": "SELECT * FROM orders WHERE o_custkey IN (SELECT k FROM secrets)",
        "write": "DROP TABLE orders", "two": "SELECT 1; SELECT 2", "denied": "SELECT pow(2, 3)", "denied alias": "SELECT power(2, 3)", "blank": "  ", "range": "SELECT * FROM range(3)",
    }
    rows, known = [], {*c.engine(spark, d).manifest.models}
    for name, sql in asked.items():
        try:
            policy.check(spark, sql, rules, known)
            rows.append((name, "OK"))
        except policy.PolicyError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "statement string, code string")


def _strict(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, policy=policy.Policy(strict=True)).register("orders", spark.read.parquet(f"{d}/orders.parquet"))
    e.load({"catalog": "shop", "schema": "main", "models": [{"name": "orders", "tableReference": {"table": "orders"}, "columns": c._cols("o_orderkey|bigint", "o_orderstatus|varchar")}]})
    return e.query("SELECT o_orderstatus, count(*) AS n FROM shop.main.orders GROUP BY o_orderstatus")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    log = policy.AuditLog()
    for k in range(3):
        log.record({"event": "query", "n": k})
    whole, lines = log.verify(), len(log.lines)
    log.lines[1] = log.lines[1].replace('"n": 1', '"n": 7')
    return spark.createDataFrame([(lines, whole, log.verify())], "lines int, whole boolean, after_change boolean")


def _extraction(spark: SparkSession, d: str) -> DataFrame:
    e, rows = c.engine(spark, d), []
    for asked in ("big_buyers", "region"):
        got: Manifest = e.extract(f"SELECT * FROM {asked}")
        rows += [(asked, m) for m in got.models if asked == "region" or m in ("customer", "orders")]
    return spark.createDataFrame(rows, "asked string, model string")


def _denials(spark: SparkSession, d: str) -> DataFrame:
    e = c.engine(spark, d)
    rows = [(x, e.builder({"level": int(x)}).denied(e.manifest.model("guarded"), "c_acctbal") is not None) for x in ("1", "4")]
    return spark.createDataFrame(rows, "level string, denied boolean")


def _types(spark: SparkSession, d: str) -> DataFrame:
    names = ("int8", "uint32", "varchar(10)", "numeric(12,2)", "double", "float4", "timestamptz", "datetime", "array<int4>", "struct<a int, b varchar>", "bool", "bytea", "date", "ubigint", "no such type")
    return spark.createDataFrame([(n, spark_type(n).simpleString()) for n in names], "name string, type string")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    old, new = (spark.createDataFrame([], s).schema for s in ("a int, b int, c string", "b bigint, c string, d date"))
    return spark.createDataFrame(readers.drift(old, new, ("c",), ("d",)), "change string, col string, breaking boolean")


def _function_records(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.functions.registry import available, describe

    held = set(available(spark))
    return spark.createDataFrame([(n, describe(spark, n)[0].kind) for n in ("sum", "rank", "array_has", "upper", "countif") if n in held], "name string, kind string")


def _arrow(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(readers.to_arrow(c.engine(spark, d).query("SELECT n_nationkey, n_name FROM nation")))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """A table as quoted CSV lines, read with a schema."""
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.format_string('%d|"%s"|%d', "n_nationkey", "n_name", "n_regionkey"))
    return readers.read_csv(spark, lines.rdd.map(lambda r: r[0]), header=False, delimiter="|", schema="n_nationkey int, n_name string, n_regionkey int")


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = readers.to_json_rows(spark.read.parquet(f"{d}/nation.parquet"))
    return readers.read_json(spark, lines.rdd.map(lambda r: r[0]), schema="n_nationkey int, n_name string")


def every() -> dict[str, c.Pair]:
    return {**model_queries(), **cube_queries(), **graph_queries(), **function_queries(), **governance_queries()}
