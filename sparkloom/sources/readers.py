"""Sources and sinks: files, bytes, JDBC, vendor formats; schema drift."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SourceError(ValueError):
    pass


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(
    spark: SparkSession, path: str, *, header: bool = True, delimiter: str = ",", quote: str = '"', escape: str = '"',
    terminator: str | None = None, schema: T.StructType | str | None = None, sample: float = 1.0,
) -> DataFrame:
    """CSV with explicit schema, or inferred from a share of the rows."""
    r = spark.read.option("header", header).option("sep", delimiter).option("quote", quote).option("escape", escape)
    if terminator:
        r = r.option("lineSep", terminator)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).option("samplingRatio", sample).csv(path)


def read_json(spark: SparkSession, path: str, *, array: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, or a file that is one JSON array."""
    r = spark.read.option("multiLine", array)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_rows(spark: SparkSession, text: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array in memory."""
    rows = json.loads(text)
    if not isinstance(rows, list):
        raise SourceError("a JSON array is needed")
    return spark.createDataFrame(rows, schema) if rows or schema else spark.createDataFrame([], T.StructType())


def discover(spark: SparkSession, folder: str, suffix: str = "parquet") -> dict[str, DataFrame]:
    """Every ``*.parquet`` or ``*.csv`` of a folder, by stem; an error if there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.{suffix}")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    names = sorted(str(s.getPath()) for s in found or [])
    if not names:
        raise SourceError(f"no {suffix} file in {folder}")
    read = read_parquet if suffix == "parquet" else read_csv
    return {PurePosixPath(n).stem: read(spark, n) for n in names}


def to_arrow(df: DataFrame):
    return df.toArrow()


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls written out."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode(mode).format(format)
    if format == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def drift(old: T.StructType, new: T.StructType, old_partitions: tuple[str, ...] = (), new_partitions: tuple[str, ...] = ()) -> list[tuple[str, str, bool]]:
    """(change, column, breaking): added, removed, type_changed, comment, order, partition_changed."""
    out, a, b = [], {f.name: f for f in old}, {f.name: f for f in new}
    out += [("added", n, False) for n in b if n not in a]
    out += [("removed", n, True) for n in a if n not in b]
    both = [n for n in a if n in b]
    out += [("type_changed", n, True) for n in both if a[n].dataType != b[n].dataType]
    out += [("comment", n, False) for n in both if a[n].metadata.get("comment") != b[n].metadata.get("comment")]
    if [n for n in b if n in a] != both:
        out.append(("order", "", False))
    if tuple(old_partitions) != tuple(new_partitions):
        out.append(("partition_changed", "", True))
    return out
