"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import drop_staged, staged


def _with_value(rows: DataFrame, key: Column, table: DataFrame, hot: list[int]) -> DataFrame:
    """``rows`` joined with ``table`` (at, value) on a key. Rows of the ``hot`` keys stay where they
    are: the table's rows for these keys, bounded by the list, are broadcast."""
    if not hot:
        return rows.join(table, key == table["at"])
    ids = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in hot], "hot long"))
    few = F.broadcast(table.join(ids, table["at"] == ids["hot"], "left_semi"))
    return rows.join(ids, key == ids["hot"], "left_anti").join(table, key == table["at"]).union(rows.join(few, key == few["at"]))


def components(edges: DataFrame, *, hot_rows: int = 100_000) -> DataFrame:
    """(a, b) edges to (id, root): the smallest id reachable, for each id that has an edge.

    Each round first replaces every vertex's label by that label's own label, so paths shorten by
    half or more, and then hands every vertex the smallest label among its neighbours and itself.
    Minima are combined before each shuffle. A vertex with over ``hot_rows`` edges, or a label that
    as many vertices have, is not shuffled by: its one row is broadcast instead. There are at most
    100,000 such keys, as ``hot_rows`` grows with the edges. Labels are written to the shared folder
    each round, and rounds go on until none changes.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    both = staged(both.union(both.select("v", "u")).distinct(), "edges")
    hot_rows = max(hot_rows, both.count() // 100_000)
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    degree = staged(degree.select("u", "n", F.least("u", "m").alias("root")), "degrees")
    hubs = [r["u"] for r in degree.filter(F.col("n") > hot_rows).select("u").collect()]
    labels = staged(degree.select(F.col("u").alias("id"), "root"), "labels")
    drop_staged(degree)
    # One row to the driver: whether labels moved, and those that very many vertices have.
    by_root = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    common = [r["root"] for r in by_root.filter(F.col("n") > hot_rows).select("root").collect()]
    while True:
        over = labels.select(F.col("id").alias("at"), F.col("root").alias("value"))
        jumped = _with_value(labels, F.col("root"), over, common).select("id", F.col("root").alias("was"), F.col("value").alias("root"))
        far = jumped.select(F.col("id").alias("at"), F.col("root").alias("value"))
        near = _with_value(both, F.col("v"), far, hubs).groupBy("u").agg(F.min("value").alias("m"))
        done = jumped.join(near, jumped["id"] == near["u"]).select("id", F.least("root", "m").alias("root"), (F.least("root", "m") < F.col("was")).alias("moved"))
        new = staged(done, "labels")
        by_root = new.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved"))
        seen = by_root.agg(F.max("moved").alias("moved"), F.collect_list(F.when(F.col("n") > hot_rows, F.col("root"))).alias("common")).first()
        common = seen["common"]
        drop_staged(labels)
        labels = new.select("id", "root")
        if not seen["moved"]:
            drop_staged(both)
            return labels
