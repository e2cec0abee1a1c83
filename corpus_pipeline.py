"""A corpus from raw documents to packed sequences: five stages over the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, mixing, packing, quality_classifier, secrets
from sparkloom.llm._common import staged
from sparkloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts. It is fitted on labelled documents of this input;
    without usable labels every document has the same score. Null texts are scored as empty ones."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies. Rows of one id are one document
    and stay together; rows without an id, and texts without words, have no copies."""
    found = jaccard.join_sets(docs)
    gone = staged(found.filter("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced, a private key's from header to end; null
    texts stay null."""
    seen = secrets.scan(docs, rules=secrets.WHOLE_RULES, keep=("lang", "source", "text", "n_chars"))
    changed = F.size("found") > 0
    text = F.when(changed, secrets.redact(F.col("scanned_text"), F.col("found"))).otherwise(F.col("text"))
    out = seen.withColumn("text", text)
    n = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each epoch, and once more if the fraction
    of an epoch reaches them; those that it doesn't take go. Documents without words stay out. Equal
    rows are one after the other in the mix and come as often as it takes all of them together; a
    row without an id is a row like any other."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS))
    taken = mixing.mix(docs, keep=("row",)).filter("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("id"), "row").agg(
        F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"), F.count(F.lit(1)).alias("equal")
    )
    taken = staged(taken.withColumnRenamed("row", "r"), "taken")
    whose = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r"))
    out = docs.join(taken.filter("equal = 1"), whose)
    if taken.filter("equal > 1").limit(1).count():
        # Only these rows are brought together, one left of each.
        out = out.union(docs.join(taken.filter("equal > 1"), whose).dropDuplicates(["doc_id", "row"]))
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    # A small cache: other stages' workers need the memory too.
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, cache=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("packed", packed),
]

#: Trees, hashes and tokenizers are not SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
