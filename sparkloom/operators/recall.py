"""Retrieval over schema records and stored questions."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.manifest import Manifest

RECORD = "kind string, model string, name string, text string"


def schema_records(spark: SparkSession, m: Manifest) -> DataFrame:
    """A row for each model, column, relationship, view, cube, measure and dimension."""
    rows = []
    for model in m.models.values():
        rows.append(("model", model.name, model.name, f"model {model.name} key {', '.join(model.primary_key)}"))
        rows += [("column", model.name, c.name, f"{model.name}.{c.name} {c.type} {c.expression or ''}".strip()) for c in model.visible()]
    rows += [("relationship", "", r.name, f"{r.models[0]} {r.join_type} {r.models[1]} on {r.condition}") for r in m.relationships.values()]
    rows += [("view", "", k, v) for k, v in m.views.items()]
    for c in m.cubes.values():
        rows.append(("cube", c.base, c.name, f"cube {c.name} on {c.base}"))
        rows += [("measure", c.name, k, f"{c.name}.{k} {v}") for k, v in c.measures.items()]
        rows += [("dimension", c.name, k, f"{c.name}.{k} {v}") for k, v in c.dimensions.items()]
        rows += [("time_dimension", c.name, k, f"{c.name}.{k} {v}") for k, v in c.time_dimensions.items()]
    return spark.createDataFrame(rows, RECORD)


def context(records: DataFrame, threshold: int = 30_000) -> str | None:
    """All records as one text if they are short enough, else None: search then."""
    size = records.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    return "\n".join(r[0] for r in records.select("text").collect()) if size <= threshold else None


def vector_recall(rows: DataFrame, query: list[float], *, vector: str = "embedding", key: str = "vec_id", k: int = 5, where: str | None = None) -> DataFrame:
    """The k nearest rows by Euclidean distance, filtered first; ties go to the smaller key."""
    df = rows.filter(F.expr(where)) if where else rows
    q = F.array(*[F.lit(float(x)) for x in query])
    gap = F.zip_with(F.col(vector), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    dist = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
    return df.withColumn("distance", dist).orderBy("distance", key).limit(k)


def token_recall(rows: DataFrame, question: str, *, text: str = "text", k: int = 3) -> DataFrame:
    """Rows by the number of shared tokens of two or more characters, 5 more if one text contains
    the other; ties by text."""
    cut = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+")), lambda x: F.length(x) >= 2)
    q = F.lower(F.lit(question))
    inside = F.contains(F.lower(F.col(text)), q) | F.contains(q, F.lower(F.col(text)))
    score = F.size(F.array_intersect(cut(F.col(text)), cut(F.lit(question)))) + F.when(inside, 5).otherwise(0)
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), text).limit(k)


def seed_queries(m: Manifest) -> list[tuple[str, str]]:
    """(question, SQL) starters: list, total, group and join templates."""
    numeric = ("int", "integer", "bigint", "double", "float", "decimal")
    out = []
    for model in m.models.values():
        cols = model.visible()
        out.append((f"List {model.name}", f"SELECT * FROM {model.name} LIMIT 100"))
        out.append((f"How many {model.name} are there?", f"SELECT count(*) AS total FROM {model.name}"))
        num = [c.name for c in cols if c.type.lower() in numeric and c.name not in model.primary_key]
        txt = [c.name for c in cols if c.type.lower() in ("varchar", "string", "text")]
        if num:
            out.append((f"Total {num[0]} of {model.name}", f"SELECT sum({num[0]}) AS total FROM {model.name}"))
        if num and txt:
            out.append((f"Total {num[0]} by {txt[0]} of {model.name}", f"SELECT {txt[0]}, sum({num[0]}) AS total FROM {model.name} GROUP BY {txt[0]}"))
    for r in m.relationships.values():
        a, b = r.models
        out.append((f"{a} with {b}", f"SELECT * FROM {a} JOIN {b} ON {r.condition} LIMIT 100"))
    return out


#: A stored question; ``at`` orders the writes of a key, ``gone`` marks a forgotten one.
PAIR = "key string, question string, sql string, datasource string, tags string, at long, gone boolean"


class QueryMemory:
    """Questions and their SQL in a folder of Parquet files that is only ever appended to: the last
    write of a key counts, so readers never see a half-written state and need no lock."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, PAIR).coalesce(1).write.mode("append").parquet(self.path)

    def _log(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(PAIR).parquet(self.path) if fs.exists(target) else self.spark.createDataFrame([], PAIR)

    def store(self, question: str, sql: str, *, datasource: str = "", tags: str = "", key: str | None = None) -> str:
        """Adds a pair, or replaces the one of ``key``; returns the key."""
        if not question.strip() or not sql.strip():
            raise ValueError("a question and its SQL are needed")
        key = key or uuid.uuid4().hex
        self._write([(key, question, sql, datasource, tags, time.time_ns(), False)])
        return key

    def list(self, *, datasource: str | None = None) -> DataFrame:
        """The live pairs, newest first."""
        row = F.struct(*[F.col(f.name) for f in T.StructType.fromDDL(PAIR).fields if f.name != "key"])
        now = self._log().groupBy("key").agg(F.max_by(row, "at").alias("r")).select("key", "r.*").filter(~F.col("gone"))
        now = now if datasource is None else now.filter(F.col("datasource") == datasource)
        return now.drop("gone").orderBy(F.desc("at"), "key")

    def count(self, *, datasource: str | None = None) -> int:
        return self.list(datasource=datasource).count()

    def forget(self, keys: list[str]) -> None:
        """Pairs of these keys no longer count; unknown keys change nothing."""
        if keys:
            self._write([(k, None, None, None, None, time.time_ns(), True) for k in keys])

    def recall(self, question: str, *, k: int = 3, datasource: str | None = None) -> DataFrame:
        """The k pairs whose question shares most with the given one."""
        return token_recall(self.list(datasource=datasource), question, text="question", k=k)

    def dump(self, path: str) -> None:
        """All live pairs as JSON lines."""
        self.list().write.mode("overwrite").json(path)

    def load(self, path: str, *, upsert: bool = True) -> None:
        """Adds dumped pairs; known keys are replaced, or left alone without ``upsert``."""
        rows = self.spark.read.schema(PAIR).json(path).filter(F.col("key").isNotNull())
        if not upsert:
            rows = rows.join(self.list().select("key"), "key", "left_anti")
        rows = rows.select("key", "question", "sql", "datasource", "tags", F.lit(time.time_ns()).alias("at"), F.lit(False).alias("gone"))
        rows.dropDuplicates(["key"]).write.mode("append").parquet(self.path)
