"""How each kind of data source is reached: Spark format and options from plain connection details.

Nothing here needs a driver: ``plan`` only builds options, ``native`` only writes SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote

from sparkloom.operators.policy import clamp_limit


class ConnectorError(ValueError):
    pass


@dataclass(frozen=True)
class Jdbc:
    """A JDBC source: driver, URL pattern over the details, default port, and further options."""

    driver: str
    url: str
    port: int | None = None
    options: dict[str, str] = field(default_factory=dict)
    #: How a row limit is written: "wrap", "append", "top" or "rownum".
    limit: str = "wrap"


#: Drivers, ports and URL forms of the vendors.
JDBC: dict[str, Jdbc] = {
    "postgres": Jdbc("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432, {"stringtype": "unspecified"}),
    "redshift": Jdbc("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}", 5439),
    "mysql": Jdbc("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306, {"tinyInt1isBit": "false"}, "append"),
    "doris": Jdbc("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 9030, {"useServerPrepStmts": "false"}, "append"),
    "mssql": Jdbc("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, {"trustServerCertificate": "true"}, "top"),
    "oracle": Jdbc("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521, {}, "rownum"),
    "clickhouse": Jdbc("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}", 8123),
    "trino": Jdbc("io.trino.jdbc.TrinoDriver", "jdbc:trino://{host}:{port}/{catalog}/{schema}", 8080),
    "pg_workspace": Jdbc("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{workspace}", 7432),
    "athena": Jdbc("com.amazon.athena.jdbc.AthenaDriver", "jdbc:athena://Region={region};OutputLocation={staging}"),
    "maxcompute": Jdbc("com.aliyun.odps.jdbc.OdpsDriver", "jdbc:odps:{endpoint}?project={project}"),
    "duckdb": Jdbc("org.duckdb.DuckDBDriver", "jdbc:duckdb:{path}", None, {"duckdb.read_only": "true"}),
}
#: Credentials of object stores as settings of the file system.
STORES = {
    "s3_file": ("s3a", {"access_key": "spark.hadoop.fs.s3a.access.key", "secret_key": "spark.hadoop.fs.s3a.secret.key", "region": "spark.hadoop.fs.s3a.endpoint.region"}),
    "minio_file": ("s3a", {"access_key": "spark.hadoop.fs.s3a.access.key", "secret_key": "spark.hadoop.fs.s3a.secret.key", "endpoint": "spark.hadoop.fs.s3a.endpoint"}),
    "gcs_file": ("gs", {"key_file": "spark.hadoop.google.cloud.auth.service.account.json.keyfile"}),
}
FILES = ("local_file", "datafusion", *STORES)
NATIVE = ("spark", "databricks")
KINDS = (*JDBC, *FILES, *NATIVE, "bigquery", "snowflake")


@dataclass(frozen=True)
class Plan:
    """What a reader needs: format, its options, and settings of the session."""

    format: str
    options: dict[str, str]
    settings: dict[str, str] = field(default_factory=dict)


def _need(info: dict[str, Any], *names: str) -> None:
    if missing := [n for n in names if not info.get(n)]:
        raise ConnectorError(f"missing: {', '.join(missing)}")


def native(kind: str, sql: str, limit: int | None = None) -> str:
    """A query as the source is asked, at most ``limit`` rows in its own syntax."""
    text = sql.strip().rstrip(";")
    if limit is None:
        return text
    how = JDBC[kind].limit if kind in JDBC else "wrap"
    if how == "append":
        return clamp_limit(text, limit)
    if how == "top":
        return f"SELECT TOP {limit} * FROM ({text}) AS limited"
    if how == "rownum":
        return f"SELECT * FROM ({text}) WHERE ROWNUM <= {limit}"
    return f"SELECT * FROM ({text}) AS limited LIMIT {limit}"


def plan(kind: str, info: dict[str, Any], *, table: str | None = None, query: str | None = None, limit: int | None = None) -> Plan:
    """Format and options for a table or a query of a source.

    ``info`` holds connection details; ``partition`` (column, low, high, n) in it reads a JDBC table
    in n ranges. Column pruning and filters go to the source in any case.
    """
    info = {k: v for k, v in info.items() if v is not None}
    if kind in JDBC:
        j = JDBC[kind]
        details = {"port": j.port, "schema": "default", **{k: v if k in ("host", "path", "endpoint", "staging") else quote(str(v), safe="") for k, v in info.items() if isinstance(v, (str, int))}}
        url = info.get("url")
        if not url:
            _need(details, *[f for f in ("host", "database", "catalog", "workspace", "region", "staging", "endpoint", "project", "path") if "{" + f + "}" in j.url])
            url = j.url.format(**details)
        elif not url.startswith(j.url.split("{")[0].split("//")[0]):
            raise ConnectorError(f"not a {kind} URL: {url}")
        out = {"url": url, "driver": j.driver, **j.options, **{k: str(info[k]) for k in ("user", "password", "fetchsize") if k in info}}
        if (table is None) == (query is None):
            raise ConnectorError("a table or a query")
        if query is not None or limit is not None:
            out["query"] = native(kind, query or f"SELECT * FROM {table}", limit)
        else:
            out["dbtable"] = table
        if info.get("partition"):
            if "query" in out:
                raise ConnectorError("a query can't be read in ranges")
            col, low, high, n = info["partition"]
            out |= {"partitionColumn": col, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
        return Plan("jdbc", out)
    if kind in FILES:
        _need(info, "url")
        scheme, names = STORES.get(kind, ("", {}))
        url = info["url"]
        if scheme and not url.startswith(f"{scheme}://"):
            url = f"{scheme}://{url.split('://', 1)[-1]}"
        settings = {names[k]: str(info[k]) for k in names if k in info}
        if kind == "minio_file":
            settings["spark.hadoop.fs.s3a.path.style.access"] = "true"
        return Plan(info.get("format", "parquet"), {"path": url}, settings)
    if kind == "bigquery":
        _need(info, "project")
        own = {"parentProject": info["project"], **({"credentials": info["credentials"]} if info.get("credentials") else {})}
        if query is not None or limit is not None:
            _need(info, "dataset")
            return Plan("bigquery", own | {"query": native(kind, query or f"SELECT * FROM {table}", limit), "viewsEnabled": "true", "materializationDataset": info["dataset"]})
        return Plan("bigquery", own | {"table": table if not info.get("dataset") or "." in table else f"{info['dataset']}.{table}"})
    if kind == "snowflake":
        _need(info, "account", "user", "database", "schema")
        own = {"sfURL": f"{info['account']}.snowflakecomputing.com", "sfUser": info["user"], "sfDatabase": info["database"], "sfSchema": info["schema"]}
        own |= {a: info[b] for a, b in (("sfPassword", "password"), ("pem_private_key", "private_key"), ("sfWarehouse", "warehouse"), ("sfRole", "role")) if b in info}
        return Plan("snowflake", own | ({"query": native(kind, query or f"SELECT * FROM {table}", limit)} if query is not None or limit is not None else {"dbtable": table}))
    if kind in NATIVE:
        return Plan("table" if query is None else "sql", {"table": ".".join(x for x in (info.get("catalog"), info.get("schema"), table) if x)} if query is None else {"query": native(kind, query, limit)})
    raise ConnectorError(f"unknown data source {kind}")


def read(spark, kind: str, info: dict[str, Any], **what):
    """The DataFrame of a plan. Settings of object stores apply to the session's file systems."""
    p = plan(kind, info, **what)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in p.settings.items():
        conf.set(k.removeprefix("spark.hadoop."), v)
    if p.format == "table":
        return spark.table(p.options["table"])
    if p.format == "sql":
        return spark.sql(p.options["query"])
    options = dict(p.options)
    path = options.pop("path", None)
    r = spark.read.format(p.format).options(**options)
    return r.load(path) if path else r.load()
