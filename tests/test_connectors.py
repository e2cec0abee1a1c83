"""Options of every kind of source, limits in its syntax, and the command line."""

import io
import json

import pytest

from sparkloom.__main__ import main
from sparkloom.plans.catalogue import manifest
from sparkloom.sources import connectors as c

DATA = "/root/testdata/sf0.001"
INFO = {
    "postgres": ({"host": "h", "database": "d b", "user": "u", "password": "p"}, "jdbc:postgresql://h:5432/d%20b"), "redshift": ({"host": "h", "database": "d"}, "jdbc:redshift://h:5439/d"),
    "mysql": ({"host": "h", "database": "d", "port": 3307}, "jdbc:mysql://h:3307/d"), "doris": ({"host": "h", "database": "d"}, "jdbc:mysql://h:9030/d"),
    "mssql": ({"host": "h", "database": "d"}, "jdbc:sqlserver://h:1433;databaseName=d"), "oracle": ({"host": "h", "database": "s"}, "jdbc:oracle:thin:@//h:1521/s"),
    "clickhouse": ({"host": "h", "database": "d"}, "jdbc:clickhouse://h:8123/d"), "trino": ({"host": "h", "catalog": "c"}, "jdbc:trino://h:8080/c/default"),
    "pg_workspace": ({"host": "h", "workspace": "w"}, "jdbc:postgresql://h:7432/w"), "athena": ({"region": "r", "staging": "s3://b/x"}, "jdbc:athena://Region=r;OutputLocation=s3://b/x"),
    "maxcompute": ({"endpoint": "https://e/api", "project": "p"}, "jdbc:odps:https://e/api?project=p"), "duckdb": ({"path": "/tmp/x.duckdb"}, "jdbc:duckdb:/tmp/x.duckdb"),
}


@pytest.mark.parametrize("kind", sorted(INFO))
def test_jdbc_sources(kind):
    info, url = INFO[kind]
    p = c.plan(kind, info, table="t")
    assert p.format == "jdbc" and p.options["url"] == url and p.options["driver"] == c.JDBC[kind].driver and p.options["dbtable"] == "t"
    ranged = c.plan(kind, {**info, "partition": ("id", 0, 100, 4)}, table="t").options
    assert (ranged["partitionColumn"], ranged["numPartitions"]) == ("id", "4")
    assert "dbtable" not in c.plan(kind, info, query="SELECT 1").options
    with pytest.raises(c.ConnectorError):
        c.plan(kind, {}, table="t")
    with pytest.raises(c.ConnectorError):
        c.plan(kind, {"url": "http://elsewhere"}, table="t")
    with pytest.raises(c.ConnectorError):
        c.plan(kind, info)


def test_limits_in_the_syntax_of_the_source():
    sql = "SELECT a FROM t ORDER BY a;"
    assert c.native("mysql", sql, 5) == c.native("doris", sql, 5) == "SELECT a FROM t ORDER BY a LIMIT 5"
    assert c.native("mysql", "SELECT a FROM t LIMIT 3", 5) == "SELECT a FROM t LIMIT 3"
    assert c.native("mssql", sql, 5) == "SELECT TOP 5 * FROM (SELECT a FROM t ORDER BY a) AS limited"
    assert c.native("oracle", sql, 5) == "SELECT * FROM (SELECT a FROM t ORDER BY a) WHERE ROWNUM <= 5"
    assert c.native("trino", sql, 5) == "SELECT * FROM (SELECT a FROM t ORDER BY a) AS limited LIMIT 5" and c.native("trino", sql) == sql[:-1]
    assert c.plan("postgres", INFO["postgres"][0], table="t", limit=2).options["query"] == "SELECT * FROM (SELECT * FROM t) AS limited LIMIT 2"


def test_files_vendors_and_native_sources():
    p = c.plan("minio_file", {"url": "s3://b/x", "access_key": "a", "secret_key": "s", "endpoint": "http://m:9000", "format": "csv"})
    assert (p.format, p.options["path"]) == ("csv", "s3a://b/x") and p.settings["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert c.plan("s3_file", {"url": "s3://b/x", "region": "r"}).settings == {"spark.hadoop.fs.s3a.endpoint.region": "r"}
    assert c.plan("gcs_file", {"url": "gs://b/x", "key_file": "k"}).options == {"path": "gs://b/x"}
    assert c.plan("local_file", {"url": "/d"}).options == {"path": "/d"} and c.plan("datafusion", {"url": "/d"}).format == "parquet"
    assert c.plan("bigquery", {"project": "p", "dataset": "d"}, table="t").options == {"parentProject": "p", "table": "d.t"}
    assert c.plan("bigquery", {"project": "p", "dataset": "d"}, query="SELECT 1").options["materializationDataset"] == "d"
    s = c.plan("snowflake", {"account": "a", "user": "u", "database": "d", "schema": "s", "password": "x", "warehouse": "w"}, table="t").options
    assert s["sfURL"] == "a.snowflakecomputing.com" and s["sfWarehouse"] == "w" and s["dbtable"] == "t"
    assert c.plan("databricks", {"catalog": "m", "schema": "s"}, table="t").options == {"table": "m.s.t"} and c.plan("spark", {}, query="SELECT 1").format == "sql"
    with pytest.raises(c.ConnectorError):
        c.plan("nothing", {})
    assert len(c.KINDS) == 21


def test_reads_through_plans(spark, tmp_path):
    rows = c.read(spark, "local_file", {"url": f"{DATA}/region.parquet"})
    assert rows.count() == 5
    rows.createOrReplaceTempView("connector_region")
    assert c.read(spark, "spark", {}, table="connector_region").count() == 5 and c.read(spark, "databricks", {}, query="SELECT * FROM connector_region", limit=2).count() == 2
    spark.catalog.dropTempView("connector_region")


def test_command_line(spark, tmp_path, capsys):
    mdl = tmp_path / "m.json"
    mdl.write_text(json.dumps(manifest()))

    def run(*args):
        out = io.StringIO()
        code = main([args[0], "--mdl", str(mdl), "--data", DATA, *args[1:]], spark=spark, out=out)
        return code, out.getvalue()

    assert run("query", "SELECT r_regionkey, nullif(r_regionkey, 1) AS x FROM region ORDER BY 1", "--limit", "2", "--output", "csv") == (0, "r_regionkey,x\n0,0\n1,\n")
    assert run("query", "SELECT r_regionkey, nullif(r_regionkey, 1) AS x FROM region ORDER BY 1", "--limit", "2", "--output", "json")[1].splitlines()[1] == '{"r_regionkey": 1, "x": null}'
    assert run("query", "SELECT 1 AS one, 'ab' AS t FROM region LIMIT 1")[1] == "one | t\n----+---\n1   | ab\n"
    assert run("dry-run", "SELECT r_name FROM region") == (0, "struct<r_name:string>\n")
    assert "orders" in run("tables")[1].split()
    code, text = run("cube", "order_cube", "--measure", "orders_n", "--dimension", "status", "--time", "ordered:year:1995-01-01,1996-01-01", "--filter", "status:in:F,O", "--output", "csv")
    assert code == 0 and text.splitlines()[0] == "ordered__year,status,orders_n" and len(text.splitlines()) == 3
    assert run("query", "SELECT c_custkey FROM guarded", "--property", "nation=7", "--output", "csv")[0] == 0
    assert run("query", "SELECT nothing FROM region")[0] == 1 and "nothing" in capsys.readouterr().err
