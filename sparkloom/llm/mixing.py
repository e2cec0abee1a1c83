"""Operator 5: Efraimidis-Spirakis mixing of sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm._common import staged, words

#: Steps of the sampling weight.
LEVELS = 64


def text_quality(text: Column) -> Column:
    """Sampling weight of a text in (0, 1]: falls with its share of symbols."""
    t = F.coalesce(text, F.lit(""))
    share = F.regexp_count(t, F.lit("[#*$%&|<>]")) / F.greatest(F.length(t), F.lit(1))
    return F.greatest(F.lit(0.05), 1.0 - 8.0 * share)


def source_targets(
    totals: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Adds rank and target to (source, source_size, n_docs): water-filling in closed form.

    Sources in code-point order, null last, weigh ``weights`` in turn. Sorted by cap/weight, the
    sources that stop at their cap are a prefix; the level of the rest is what the budget leaves
    over by the weight left over. Works on one row a source.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights))
    x = by_name.withColumn("weight", turn).withColumn("stop", F.col("source_size") * F.lit(float(cap)))
    x = x.withColumn("ratio", F.col("stop") / F.col("weight"))
    upto = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    x = x.withColumn("left", F.col("budget") - F.sum("stop").over(upto) + F.col("stop"))
    x = x.withColumn("heft", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    # The level if this source is the first that does not stop; the first such one counts.
    x = x.withColumn("level", F.greatest(F.col("left") / F.col("heft"), F.lit(0.0)))
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    x = x.withColumn("level", free["level"])
    target = F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("weight") * F.col("level")))
    return x.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def weighted_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    rows_per_bucket: int = 20_000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, level (quality in 64ths), key and ``kept`` columns for every row.

    Equal rows (same id, text, source and kept columns) are combined before the shuffle and get
    numbers, so each draws a key of its own, and the same ones on every run. More than
    ``rows_per_bucket`` equal rows are dealt to several tasks.
    """
    size = F.size(words(F.col(text_col))).cast("long")
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
        F.ceil(text_quality(F.col(text_col)) * LEVELS).cast("int").alias("level"), F.xxhash64(text_col).alias("text_hash"),
        *[F.col(c).alias(f"kept {c}") for c in keep],
    )
    equal = staged(picked.groupBy(*picked.columns).agg(F.count(F.lit(1)).alias("equal")), "sizes")
    copies = lambda low, high: F.explode(F.sequence(low, high)).alias("copy")
    few = equal.filter(F.col("equal") <= rows_per_bucket).select(*picked.columns, copies(F.lit(0).cast("long"), F.col("equal") - 1))
    many = equal.filter(F.col("equal") > rows_per_bucket)
    many = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1, F.lit(rows_per_bucket).cast("long"))).alias("low"))
    many = many.repartition("doc_id", "text_hash", "low")
    many = many.select(*picked.columns, copies(F.col("low"), F.least(F.col("low") + rows_per_bucket, F.col("equal")) - 1))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy"), 11) + 0.5) / float(1 << 53)
    return few.union(many).withColumn("key", -F.log(u) * LEVELS / F.col("level"))


def dealt_rows(rows: DataFrame, targets: DataFrame, *, rows_per_bucket: int = 20_000, most_broadcast: int = 20_000) -> DataFrame:
    """``rows`` with their source's columns and ``bucket``, which follows the order of the keys.

    A source's keys are a mixture of exponentials, one for each quality level, and the shares of
    the levels are known: the mixture's distribution function maps keys to evenly filled buckets,
    whatever the qualities. Buckets hold ``rows_per_bucket`` rows but for the spread of a draw.
    """
    named = targets.withColumnRenamed("source", "s")
    if targets.count() <= most_broadcast:
        x = rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    else:
        # A source with a third of all rows is 32 keys of the join.
        salted = named.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(31))))
        x = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(32)).cast("int"))
        x = x.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t"))).drop("s", "t", "salt")
    below = F.aggregate(
        "levels", F.lit(0.0), lambda a, v: a + v["n"] / F.col("n_docs") * (1 - F.exp(-F.col("key") * v["level"] / LEVELS))
    )
    buckets = F.ceil(F.col("n_docs") / rows_per_bucket)
    return x.withColumn("bucket", F.when(buckets <= 1, 0).otherwise(F.least(F.floor(buckets * below), buckets - 1)))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    rows_per_bucket: int = 20_000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (and ``keep`` columns) for every row.

    Each row draws u from a hash of (seed, id, text, number among equal rows); its key
    -ln(u)/quality orders its source, quality being rounded up to 64ths. A source takes all its
    documents for every whole epoch of its target, then documents in key order until the rest is
    used up; the last one gives only the words still wanted, so that a source's words are its
    target to within a half. Prefix sums are distributed: a bucket of keys starts at the total of
    the buckets before it, so a source with a third of all rows is many tasks. Null texts have
    size 0 and take 0; null is a source; rows without an id and repeated rows draw like all
    others; an empty table gives nothing. Only the table of sources, one row each, is sorted whole.
    """
    rows = weighted_rows(
        docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, rows_per_bucket=rows_per_bucket, keep=keep
    )
    by_level = rows.groupBy("source", "level").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    totals = by_level.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"), F.sort_array(F.collect_list(F.struct("level", "n"))).alias("levels")
    )
    totals = staged(totals, "sources")
    targets = source_targets(totals.drop("levels"), weights=weights, share=share, cap=cap)
    targets = targets.join(totals.select(F.col("source").alias("s"), "levels"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = dealt_rows(rows, staged(targets, "targets"), rows_per_bucket=rows_per_bucket)

    sums = x.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("rank").alias("r"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("rank", "bucket").orderBy("key", "doc_id", "text_hash", "copy").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    x = x.join(sums, (F.col("rank") == F.col("r")) & (F.col("bucket") == F.col("b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.least(F.greatest(rest - F.col("base") - F.col("at"), F.lit(0)), F.col("size"))
    return x.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"),
        epochs.cast("int").alias("epochs"), *[F.col(f"kept {c}").alias(c) for c in keep],
    )
