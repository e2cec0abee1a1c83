"""Operator 1: nearest neighbours by adaptive dimension scan within probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm._common import staged


@dataclass(frozen=True)
class ListIndex:
    """What is fitted on the sample: a random rotation, list centroids (unit vectors), probes a
    query, and ``anchors``, sample vectors whose distances bound a query's k-th distance. Many
    lists are in ``groups`` (first list of each, and one past the last): a vector goes to a list of
    the three groups whose centroids, ``tops``, are nearest."""

    rotation: np.ndarray
    centroids: np.ndarray
    anchors: np.ndarray
    probes: int
    tops: np.ndarray | None = None
    groups: np.ndarray | None = None

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        if self.tops is None:
            return np.argmax(unit @ self.centroids.T, axis=1)
        near = np.argsort(-(unit @ self.tops.T), axis=1, kind="stable")[:, :3]
        best, out = np.full(len(unit), -np.inf), np.zeros(len(unit), np.int64)
        for g in np.unique(near):
            rows = np.flatnonzero((near == g).any(axis=1))
            a, b = self.groups[g], self.groups[g + 1]
            score = unit[rows] @ self.centroids[a:b].T
            top = score.max(axis=1)
            better = top > best[rows]
            out[rows[better]] = a + score.argmax(axis=1)[better]
            best[rows] = np.maximum(best[rows], top)
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to [0.5, 1): exact, keeps
    cosines as they are, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.sum(x * x, axis=1))[:, None]


def _means(unit: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of spherical k-means."""
    centroids = unit[rng.choice(len(unit), count, replace=False)]
    for _ in range(rounds):
        own = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        norm = np.sqrt((sums**2).sum(axis=1))
        centroids = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centroids)
    return centroids


def sample_size(total: int, least: int = 20_000, most: int = 262_144) -> int:
    """Vectors to fit on: eight for each of sqrt(total) lists, within the bounds."""
    return int(min(most, max(least, 8 * np.sqrt(total))))


def fit_index(sample: np.ndarray, total: int, *, k: int, flat: int = 1024, anchors: int = 2000, cover: float = 0.97, seed: int = 5) -> ListIndex:
    """About sqrt(total) lists by spherical k-means over the sample, at most one for each eight of
    its vectors; more than ``flat`` lists in two levels. ``probes`` is the least number of lists
    that hold a share ``cover`` of the sample's own true neighbours."""
    rng, (n, d) = np.random.default_rng(seed), sample.shape
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    unit = unit_rows(sample)
    lists = int(max(1, min(np.sqrt(total), n // 8)))
    tops = groups = None
    if lists <= flat:
        centroids = _means(unit, lists, rng)
    else:
        tops = _means(unit, int(np.sqrt(lists)), rng)
        own = np.argmax(unit @ tops.T, axis=1)
        parts = [_means(unit[own == g], max(1, int((own == g).sum() * lists // n)), rng) if (own == g).any() else tops[g : g + 1] for g in range(len(tops))]
        centroids, groups = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    lists = len(centroids)
    index = ListIndex(rotation, centroids, unit[rng.choice(n, min(anchors, n), replace=False)], lists, tops, groups)
    probes = lists
    if total > 1000 and lists > 1:
        q = rng.choice(n, min(300, n), replace=False)
        near = unit[q] @ unit.T
        near[np.arange(len(q)), q] = -2
        top = np.argpartition(-near, k, axis=1)[:, :k]
        own = index.lists_of(unit)
        order = np.argsort(-(unit[q] @ centroids.T), axis=1)
        place = np.empty_like(order)
        place[np.arange(len(q))[:, None], order] = np.arange(lists)
        need = np.sort(place[np.arange(len(q))[:, None], own[top]].ravel())
        probes = int(need[min(len(need) - 1, int(np.ceil(cover * len(need))))]) + 1
    return replace(index, probes=probes)


def adaptive_scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, *, k: int, block: int = 16, eps: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that survive: the k nearest rows of a list for each query.

    ``x`` and ``q`` are rotated unit vectors and ``bound`` an upper bound of each query's k-th
    squared distance. After each block of columns a pair's full distance is estimated from the
    partial one; it is abandoned if, at confidence ``eps``, the estimate exceeds the bound. Under a
    random rotation the estimate's relative error over m of d columns falls with sqrt(m).
    """
    d = x.shape[1]
    first = min(block, d)
    part = (q[:, :first] ** 2).sum(1)[:, None] + (x[:, :first] ** 2).sum(1)[None, :] - 2 * q[:, :first] @ x[:, :first].T
    limit = lambda m: bound * (1.0 if m >= d else (1 + eps / np.sqrt(m)) ** 2 * m / d) + 1e-9
    i, j = np.nonzero(part <= limit(first)[:, None])
    dist, at = part[i, j], first
    while at < d:
        end = min(at + block, d)
        diff = q[i, at:end] - x[j, at:end]
        dist = dist + np.einsum("ij,ij->i", diff, diff)
        good = dist <= limit(end)[i]
        i, j, dist, at = i[good], j[good], dist[good], end
    # Ties with the k-th stay: the caller orders by exact score and id.
    order = np.lexsort((dist, i))
    i, j, dist = i[order], j[order], dist[order]
    start = np.searchsorted(i, i, side="left")
    kth = dist[np.minimum(start + k - 1, np.searchsorted(i, i, side="right") - 1)] if len(i) else dist
    keep = dist <= kth + 1e-9
    return i[keep], j[keep]


def _stack(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(len(col), -1)


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50,
    least_sample: int = 20_000, most_sample: int = 262_144, list_rows: int = 20_000, eps: float = 2.1,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine for each id divisible by ``every``.

    Rows with a null id, a null, zero or empty vector, or a null or non-finite component take no
    part. A cosine needs vectors of one length, so each length is searched by itself. Equal vectors
    are searched once: of each distinct vector the k + 1 smallest ids stay, as no more can be among
    the k nearest of any query, so a vector that a third of all rows share costs one row. Repeated
    rows (same id and vector) count once. Every query gets k rows, if there are as many. The index is fitted on ``least_sample`` distinct vectors
    or eight for each list, about ``most_sample`` at the most; lists grow with the square root of
    the rows, every distinct vector is in one, and lists beyond ``list_rows`` are scanned in several
    tasks. Scores are cosines of the original vectors in double precision; ties go to the smaller
    id. An empty table gives nothing.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(fine)
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    small = W.partitionBy("h", "h2").orderBy("id")
    top = rows.withColumn("r", F.dense_rank().over(small)).filter(F.col("r") <= k + 1)
    own = top.groupBy("h", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    own = staged(own.select("h", "ids", "v"), "vectors")
    # A row a length, of which a table of vectors has one.
    lengths = own.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [
        _search(own.filter(F.size("v") == r["d"]), rows.filter(F.size("v") == r["d"]), r["d"], r["count"], k, every, (least_sample, most_sample), list_rows, eps)
        for r in lengths
    ]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(own: DataFrame, rows: DataFrame, d: int, total: int, k: int, every: int, sample: tuple[int, int], list_rows: int, eps: float) -> DataFrame:
    """``nearest`` among vectors of one length: distinct ones (h, ids, v), and all rows (id, v, h)."""
    spark = own.sparkSession
    # A share of the vectors by hash: the same ones on every run, and no more on the way to the driver.
    share = sample_size(total, *sample) / total
    picked = own if share >= 1 else own.filter(F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = picked.select("h", "v").toArrow().sort_by("h")
    values = np.asarray(got.column("v").combine_chunks().flatten().to_numpy()).reshape(-1, d)
    if not len(values):
        values = np.asarray(own.select("v").first()["v"], np.float64).reshape(1, d)
    index = fit_index(values, total, k=k + 1)
    # Bounded: a d x d matrix, a centroid for each eight vectors of the sample at most, 2000 anchors.
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                lists = shared.value.lists_of(unit_rows(x))
                ids = b.column(1)
                first = ids.values.take(ids.offsets[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), b.column(0), first, pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())],
                    names=["list", "h", "first", "v"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                x = np.asarray(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, d)
                u = unit_rows(x)
                order = np.argsort(-(u @ ix.centroids.T), axis=1, kind="stable")
                # A query takes whatever there is in its three nearest lists, and in so many that k + 1
                # vectors are in them: so it has k results, though its true ones may lie elsewhere.
                held, place = np.cumsum(sizes[order], axis=1), np.arange(order.shape[1])
                need = np.where(held[:, -1] > k, np.argmax(held > k, axis=1), len(place) - 1)
                last = np.minimum(np.maximum(ix.probes, need + 1), len(place))
                asked_lists, free = place < last[:, None], place <= np.maximum(need, 2)[:, None]
                near = np.sort(2 - 2 * (u @ ix.anchors.T), axis=1)
                bound = near[:, k] if near.shape[1] > k + 1 else np.full(len(u), 5.0)
                raw = [r.tobytes() for r in np.ascontiguousarray(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(order[asked_lists].astype(np.int32)),
                        pa.array(np.repeat(b.column(0).to_numpy(), last)),
                        pa.array(np.where(free, 5.0, bound[:, None])[asked_lists]),
                        pa.array([r for r, n in zip(raw, last.tolist()) for _ in range(n)], pa.binary()),
                    ],
                    names=["list", "q", "bound", "v"],
                )

    lists = staged(own.select("h", "ids", "v").mapInArrow(place, "list int, h long, first long, v binary"), "lists")
    counts = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    # One row a list.
    counts = counts.collect()
    sizes = np.zeros(len(index.centroids), np.int64)
    sizes[[r["list"] for r in counts]] = [r["n"] for r in counts]
    counts = [(r["list"], r["parts"]) for r in counts]
    parts = spark.createDataFrame(counts, "list int, parts int")
    dealt = lists.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"), "h", "first", "v")
    asked = rows.filter(F.col("id") % every == 0).select("id", "h").distinct()
    queries = own.join(asked.select("h").distinct(), "h", "left_semi").select("h", "v")
    probes = queries.mapInArrow(probe, "list int, q long, bound double, v binary")
    again = spark.createDataFrame(counts, "list int, n int")
    probes = probes.join(F.broadcast(again), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "q", "bound", "v")

    def scan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "h": [], "first": [], "score": []}
        if len(left) and len(right):
            x = scaled(_stack(left["v"]))
            turn, nx = shared.value.rotation, np.sqrt(np.sum(x * x, axis=1))
            xr = (x / nx[:, None]) @ turn
            for at in range(0, len(right), 256):
                part = right.iloc[at : at + 256]
                q = scaled(_stack(part["v"]))
                nq = np.sqrt(np.sum(q * q, axis=1))
                i, j = adaptive_scan(xr, (q / nq[:, None]) @ turn, part["bound"].to_numpy(), k=k + 1, eps=eps)
                out["q"].append(part["q"].to_numpy()[i])
                out["h"].append(left["h"].to_numpy()[j])
                out["first"].append(left["first"].to_numpy()[j])
                out["score"].append(np.sum(q[i] * x[j], axis=1) / (nq[i] * nx[j]))
        return pd.DataFrame({c: np.concatenate(p) if p else np.empty(0, np.float64 if c == "score" else np.int64) for c, p in out.items()})

    hits = dealt.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInPandas(scan, "q long, h long, first long, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), "first", "h")
    hits = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    named = hits.join(own.select("h", "ids"), "h").select("q", F.explode(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("s"), x.alias("id")))).alias("c"))
    # At most (k + 1)^2 candidates a query.
    found = named.groupBy("q").agg(F.sort_array(F.collect_set("c")).alias("c"))
    pairs = asked.join(found, F.col("h") == F.col("q"))
    nearest_k = F.slice(F.filter("c", lambda c: c["id"] != F.col("id")), 1, k)
    return pairs.select(F.col("id").alias("query_id"), F.posexplode(nearest_k).alias("p", "c")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.s")).alias("score")
    )


def brute_force(ids: np.ndarray, x: np.ndarray, *, k: int = 5, every: int = 50) -> pd.DataFrame:
    """Reference result for tests and recall."""
    x = scaled(x)
    out, norm = [], np.sqrt(np.sum(x * x, axis=1))
    for a in np.flatnonzero(ids % every == 0):
        s = np.sum(x * x[a], axis=1) / (norm * norm[a])
        order = [b for b in np.lexsort((ids, -s)) if b != a][:k]
        out += [(ids[a], r + 1, ids[b], s[b]) for r, b in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
