"""Operator 10: exact Jaccard join of word-shingle sets by pivots in metric space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import mix64, release_others, shuffle_partitions, staged
from sparkloom.llm.components import components

_SCHEMA = "batch long, bucket int, kind int, hashes binary, docs binary"
_HALF = np.uint64(1 << 63)


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(mix64(s).sum(dtype=np.uint64)) if len(s) else 0
        b = int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that a partner may lack: 100 |x & y| >= percent |x | y| needs an
    overlap of at least percent n / 100."""
    return n - (percent * n + 99) // 100


def _deal(batch: int, rows, buckets: int, wide: bool):
    """(batch, bucket) rows of hashes and document numbers from (ids, sets); then a row of ids,
    sizes and signatures. ``wide``: whole hashes of whole sets; else 32 bits of each hash in the lower half."""
    ids, sets = rows
    n = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), n)
    if not wide:
        keep = h < _HALF
        h, doc = h[keep], doc[keep]
    bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    h, doc, bucket = h[order], doc[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in range(buckets):
        a, b = cuts[k], cuts[k + 1]
        if b > a:
            x = h[a:b] if wide else (h[a:b] >> np.uint64(31)).astype(np.uint32)
            yield batch, k, 0, x.tobytes(), doc[a:b].astype(np.uint16).tobytes()
    half = np.bincount(doc, minlength=len(sets)) if not wide else n
    sig = np.array([_signature(s) for s in sets], np.int64)
    yield batch, int(batch % buckets), 1, np.asarray(ids, np.int64).tobytes(), np.stack([n, half], 1).astype(np.int64).tobytes() + sig.tobytes()


def _rows(out) -> pa.RecordBatch:
    cols = list(zip(*out))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["batch", "bucket", "kind", "hashes", "docs"])


def _shared_counts(pdf: pd.DataFrame, wide: bool) -> pd.DataFrame:
    """In a bucket: hashes that two or more sets hold. Narrow: how many of them each document of
    each batch has. Wide: the hashes, with document number and frequency."""
    data = pdf[pdf["kind"] == 0]
    kind = np.uint64 if wide else np.uint32
    parts = [np.frombuffer(b, kind) for b in data["hashes"]]
    out = [tuple(r) for r in pdf.loc[pdf["kind"] == 1, ["batch", "bucket", "kind", "hashes", "docs"]].itertuples(index=False)]
    if parts:
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        s = h[order]
        edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        freq = np.empty(len(h), np.int64)
        freq[order] = np.repeat(np.diff(edge), np.diff(edge))
        at = 0
        for batch, bucket, docs, p in zip(data["batch"], data["bucket"], data["docs"], parts):
            f = freq[at : at + len(p)]
            at += len(p)
            d = np.frombuffer(docs, np.uint16)[f >= 2]
            if not len(d):
                continue
            if wide:
                f = f[f >= 2]
                body = p[freq[at - len(p) : at] >= 2].tobytes() + np.minimum(f, 2**32 - 1).astype(np.uint32).tobytes()
                out.append((batch, bucket, 0, body, d.tobytes()))
            else:
                c = np.bincount(d)
                i = np.flatnonzero(c)
                out.append((batch, bucket, 0, i.astype(np.uint16).tobytes(), c[i].astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["batch", "bucket", "kind", "hashes", "docs"])


def _header(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, counts in the lower half and signatures of a batch."""
    head = pdf[pdf["kind"] == 1].iloc[0]
    ids = np.frombuffer(head["hashes"], np.int64)
    rest = np.frombuffer(head["docs"], np.int64)
    sizes = rest[: 2 * len(ids)].reshape(-1, 2)
    return ids, sizes[:, 0], sizes[:, 1], rest[2 * len(ids) :].reshape(-1, 2)


class SetJoin:
    """Exact join of the sets of a region, recursively by pivots.

    The next pivot is the set whose shingles are commonest here, so dense groups are met at their
    middle. Its distances to all others come from the region's inverted lists. Sets within the
    limit t link to the pivot and leave: they are its cell, one component. By the triangle
    inequality a set linked with any of the cell lies within 2t of the pivot, so only that ring is
    compared with the cell, and of the ring only sets that are in another component still. The
    remainder is joined in the same way.
    """

    def __init__(self, ids: list[int], sizes: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.n, self.percent = ids, np.asarray(sizes, np.int64), percent
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        # One sort and 32-bit numbers: a region of millions of shingles is one task's memory.
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        self.token, df = flat[first], np.diff(np.r_[first, len(flat)])
        token = np.empty(len(flat), np.int32)
        token[order] = np.repeat(np.arange(len(first), dtype=np.int32), df)
        self.posting = doc[order]
        del flat, order
        self.cut = np.r_[0, np.cumsum(df)]
        self.of = np.split(token, np.cumsum([len(s) for s in sets])[:-1]) if sets else []
        weight = np.bincount(doc, df[token], len(sets)) if len(token) else np.zeros(len(sets))
        self.middle = np.argsort(-weight / np.maximum(self.n, 1), kind="stable")
        self.parent = list(range(len(sets)))

    def overlaps(self, x: int) -> np.ndarray:
        tokens = self.of[x]
        lists = [self.posting[self.cut[t] : self.cut[t + 1]] for t in tokens.tolist()]
        return np.bincount(np.concatenate(lists), minlength=len(self.n)) if lists else np.zeros(len(self.n), np.int64)

    def shared_with(self, sets: list[np.ndarray]) -> Iterator[np.ndarray]:
        """For each set from outside: how many shingles it shares with each set here."""
        for s in sets:
            at = np.searchsorted(self.token, s)
            own = at[np.flatnonzero(self.token[np.minimum(at, len(self.token) - 1)] == s)] if len(self.token) else at[:0]
            lists = [self.posting[self.cut[t] : self.cut[t + 1]] for t in own.tolist()]
            yield np.bincount(np.concatenate(lists), minlength=len(self.n)) if lists else np.zeros(len(self.n), np.int64)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            if self.ids[a] > self.ids[b]:
                a, b = b, a
            self.parent[b] = a

    def run(self) -> list[int]:
        live = np.ones(len(self.n), bool)
        for p in self.middle.tolist():
            if not live[p]:
                continue
            both = self.overlaps(p)
            union = self.n + self.n[p] - both
            near = live & (100 * both >= self.percent * union)
            near[p] = True
            # Distance 1 - both/union <= 2t with t = 1 - percent/100.
            ring = live & ~near & (100 * both >= (2 * self.percent - 100) * union)
            if self.percent > 50:
                # Below that the window is the whole space: sets that share nothing lie in it too.
                ring &= both > 0
            cell = np.flatnonzero(near)
            for x in cell.tolist():
                self.link(p, x)
            if len(cell) > 1:
                for y in np.flatnonzero(ring).tolist():
                    if self.root(y) == self.root(p):
                        continue
                    o = self.overlaps(y)[cell]
                    if (100 * o >= self.percent * (self.n[cell] + self.n[y] - o)).any():
                        self.link(p, y)
            live[cell] = False
        return [self.ids[self.root(x)] for x in range(len(self.n))]


def _views(col) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in col]


def _overlaps(pivots: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """Shingles that each set shares with each pivot, from the pivots' inverted lists."""
    token = np.concatenate(pivots)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])[order]
    out = np.zeros((len(sets), len(pivots)), np.int64)
    for i, s in enumerate(sets):
        a, b = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
        hit = np.flatnonzero(b > a)
        if len(hit):
            places = np.concatenate([np.arange(x, y) for x, y in zip(a[hit].tolist(), b[hit].tolist())])
            out[i] = np.bincount(owner[places], minlength=len(pivots))
    return out


_PAIR = "a long, b long"


def split_region(rows: DataFrame, weight: DataFrame, *, percent: int, bound: int, rounds: int, pivots: int, tasks: int) -> list[DataFrame]:
    """Links within regions of over ``bound`` shingles: (root, doc_id, n, shingles, keys) rows and a
    (root, w) row a region.

    In each round ``pivots`` documents of a region are pivots. A document within the limit t of one
    links to it and is in its cell; by the triangle inequality whoever links with a cell's document
    is within 2t of the pivot, so that ring alone is copied to the cell and compared with it. Cells
    leave, the remainder goes on. What is left after the rounds is sparse: there each shared shingle
    is a pivot of its own, and its sets are joined where it is one of their rarest, unless blocks of
    the region are fewer copies (``join_sparse``). A cell or shingle that is
    itself over the bound is compared block by block. Nothing is left out, and no task holds more
    than about ``bound`` shingles.
    """
    links: list[DataFrame] = []
    left = rows
    for turn in range(rounds if percent > 50 else 0):
        blocks = F.ceil(2 * F.col("w") / bound).cast("int")
        left = left.join(F.broadcast(weight.select(F.col("root").alias("of"), blocks.alias("blocks"))), F.col("root") == F.col("of")).drop("of")
        slot = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(pivots)).cast("int")
        chosen = left.groupBy("root", slot.alias("slot")).agg(
            F.max("blocks").alias("blocks"), F.min_by(F.struct("doc_id", "n", "shingles"), F.struct(F.xxhash64("doc_id", F.lit(turn + 100)), "doc_id", "n")).alias("p")
        )
        chosen = staged(chosen.select("root", "slot", "p.*", "blocks"), "pivots")
        own = left.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        every = chosen.select("root", "slot", "doc_id", "n", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def place(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(p):
                # A block without documents; of objects, as an empty column of floats is no list.
                return pd.DataFrame(columns=["root", "doc_id", "n", "shingles", "keys", "cell", "linked", "rings"], dtype=object)
            p = p.sort_values("slot")
            both = _overlaps(_views(p["shingles"]), _views(x["shingles"]))
            union = x["n"].to_numpy()[:, None] + p["n"].to_numpy()[None, :] - both
            near = 100 * both >= percent * union
            ring = ~near & (100 * both >= (2 * percent - 100) * union) & (both > 0)
            slots, ids = p["slot"].to_numpy(), p["doc_id"].to_numpy()
            out = x[["root", "doc_id", "n", "shingles", "keys"]].copy()
            out["cell"] = np.where(near.any(1), slots[near.argmax(1)], -1)
            out["linked"] = [ids[r].tolist() for r in near]
            out["rings"] = [slots[r].tolist() for r in ring]
            return out

        schema = "root long, doc_id long, n long, shingles binary, keys array<long>, cell int, linked array<long>, rings array<int>"
        placed = own.groupBy("root", "block").cogroup(every.groupBy("root", "block")).applyInPandas(place, schema)
        placed = staged(placed, "placed")
        links.append(placed.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b")).filter("a <> b"))
        cells = placed.filter("cell >= 0").select("root", "cell", "doc_id", "n", "shingles")
        rings = placed.select("root", F.explode("rings").alias("cell"), "doc_id", "n", "shingles")
        size = lambda t, name: t.groupBy("root", "cell").agg(F.ceil(F.sum(F.length("shingles")) / (4.0 * bound)).cast("int").alias(name))
        # A row a cell that has both a document and a ring: at most ``pivots`` a large region.
        parts = staged(size(cells, "mine").join(size(rings, "theirs"), ["root", "cell"]), "parts")

        def deal(t: DataFrame, own: str, other: str, p: str, q: str):
            t = t.join(F.broadcast(parts), ["root", "cell"]).withColumn(p, F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int"))
            t = t.withColumn(q, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            # Columns of its own for each side: both come from one table, and a cogroup can't tell them apart.
            t = t.select(*(F.col(c).alias(f"{own}_{c}") for c in ("root", "cell", "i", "j", "doc_id", "n", "shingles")))
            return t.groupBy(*t.columns[:4])

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            a, b = [], []
            if len(x) and len(y):
                n = x["mine_n"].to_numpy()
                join = SetJoin(x["mine_doc_id"].tolist(), n, _views(x["mine_shingles"]), percent)
                for doc, size, o in zip(y["theirs_doc_id"], y["theirs_n"], join.shared_with(_views(y["theirs_shingles"]))):
                    hit = np.flatnonzero(100 * o >= percent * (n + size - o))
                    if len(hit):
                        a.append(doc)
                        b.append(join.ids[hit[0]])
            return pd.DataFrame({"a": a, "b": b}, dtype=np.int64)

        links.append(deal(cells, "mine", "theirs", "i", "j").cogroup(deal(rings, "theirs", "mine", "j", "i")).applyInPandas(meet, _PAIR))
        left = placed.filter("cell < 0").select("root", "doc_id", "n", "shingles", "keys")
        weight = staged(left.groupBy("root").agg((F.sum(F.length("shingles")) / 8).alias("w")), "weights")
    return [*links, *join_sparse(left, weight, percent=percent, bound=bound, tasks=tasks)]


def join_sparse(rows: DataFrame, weight: DataFrame, *, percent: int, bound: int, tasks: int) -> list[DataFrame]:
    """Links within large regions, as for ``split_region``, in whichever form copies fewer shingles
    of a region: by its keys, or in blocks of half the bound, each pair of blocks a task.

    Keys that the same rows have are one key: near copies share many, and would be joined in each.
    """
    # Each row once: an equal one would cancel its mark in the sums that tell keys apart.
    rows = staged(rows.withColumn("row", F.xxhash64("doc_id", "n", "shingles")).dropDuplicates(["row"]), "sparse")
    keys = rows.select("root", "row", (F.length("shingles") / 8).alias("size"), F.explode("keys").alias("key"))
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    shared = keys.groupBy("root", "key").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("w"), *same).filter("c > 1")
    shared = staged(shared.groupBy("root", "c", "s1", "s2").agg(F.min("key").alias("key"), F.min("w").alias("w")), "keys")
    # A row a region. One without a key of two rows has no links.
    copies = shared.groupBy("root").agg(F.sum("w").alias("copied")).join(weight, "root")
    blocks = F.when(F.col("w") > bound, F.ceil(2 * F.col("w") / bound)).otherwise(1)
    copies = staged(copies.select("root", "w", (F.col("w") * blocks <= F.col("copied")).alias("whole")), "copies")
    columns = ("root", "doc_id", "n", "shingles", "w")
    inside = rows.drop("keys").join(F.broadcast(copies.filter("whole").select("root", "w")), "root").select(*columns)
    members = keys.select("root", "row", "key").join(shared.select("root", "key", "w"), ["root", "key"])
    members = members.join(F.broadcast(copies.filter("not whole").select("root")), "root", "left_semi")
    by_key = rows.select("row", "doc_id", "n", "shingles").join(members.select("row", F.col("key").alias("root"), "w"), "row").select(*columns)
    return [join_blocks(t, percent=percent, bound=bound, tasks=tasks) for t in (inside, by_key)]


def join_blocks(rows: DataFrame, *, percent: int, bound: int, tasks: int) -> DataFrame:
    """Links within each root of (root, doc_id, n, shingles, w): roots of a weight up to ``bound``
    are one ``SetJoin`` each, many to a task; larger ones are dealt into blocks, and each pair of
    blocks is a task of its own."""
    blocks = F.when(F.col("w") > bound, F.ceil(2 * F.col("w") / bound)).otherwise(1).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    group = F.when(F.col("blocks") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks)))

    def join_group(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in pdf.sort_values("doc_id").groupby(["root", "i", "j"], sort=False):
            ids = g["doc_id"].tolist()
            a += ids
            b += SetJoin(ids, g["n"].to_numpy(), _views(g["shingles"]), percent).run()
        return pd.DataFrame({"a": a, "b": b})

    dealt = dealt.select("root", "doc_id", "n", "shingles", "i", "j", group.alias("task"))
    return dealt.groupBy("task").applyInPandas(join_group, _PAIR).filter("a <> b")


def join_sets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75,
    most_broadcast: int = 1_000_000, region_shingles: int = 2_000_000, bucket_bytes: int = 128 << 20,
    rounds: int = 2, pivots: int = 32,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row with an id.

    1. Texts become sets of shingle hashes where they lie. Equal sets are one class (distance 0),
       whose smallest id stands for it.
    2. A set can only have a partner if ``percent`` of its shingles occur in another set too. The
       frequencies are counted over all documents, on the lower half of the hash space: if more of
       a set's shingles there are its own than it may lack at all, it has no partner. What goes
       over the network is packed: six bytes a shingle. A bucket of hashes is what one task holds;
       there is one for each ``bucket_bytes`` of text, four times as many as tasks at least.
    3. Representatives that are left are counted again on whole sets. Each shared shingle is a
       pivot {s}: the rarest ones of a set, as many as it may lack and one more, are the Voronoi
       regions that it can share with a partner (boundary sets lie in several). Regions that share
       a set are one region, by connected components over stars.
    4. Each region is joined exactly by ``SetJoin``; one of over ``region_shingles`` shingles is
       split by pivots again (``split_region``), and links are merged by connected components.

    Null and blank texts have no shingles and link with nothing; rows without an id are left out, and
    an empty table gives nothing. Rows of one id are one document: what any of its texts links with
    is in its component, and each row has the size of its own set. Nothing is sampled, capped or dropped.
    """
    spark = docs.sparkSession
    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = pick.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = 4 * shuffle_partitions(spark)
    buckets = max(tasks, -(-total // bucket_bytes))

    def deal(wide: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            from sparkloom.llm.shingles import shingle_sets

            release_others("jaccard")
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    ids = part.column(0).to_pylist()
                    keep = [k for k, i in enumerate(ids) if i is not None]
                    texts = part.column(1).to_pylist()
                    if keep:
                        rows = ([ids[k] for k in keep], shingle_sets([texts[k] for k in keep], width))
                        yield _rows(list(_deal(number, rows, buckets, wide)))
                        number += 1

        return run

    counted = pick.mapInArrow(deal(False), _SCHEMA).groupBy("bucket").applyInPandas(lambda p: _shared_counts(p, False), _SCHEMA)

    def filter_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, half, sig = _header(pdf)
        shared = np.zeros(len(ids), np.int64)
        for h, d in pdf.loc[pdf["kind"] == 0, ["hashes", "docs"]].itertuples(index=False):
            shared[np.frombuffer(h, np.uint16)] += np.frombuffer(d, np.uint32)
        may = (half - shared <= allowed(n, percent)) & (n > 0)
        return pd.DataFrame({"doc_id": ids, "n": n, "s1": sig[:, 0], "s2": sig[:, 1], "may": may})

    sets = counted.groupBy("batch").applyInPandas(filter_batch, "doc_id long, n long, s1 long, s2 long, may boolean")
    sets = staged(sets, "sets")
    classes = sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("may").alias("may"))
    classes = staged(classes, "classes")
    reps = staged(classes.filter("may").select(F.col("rep").alias("doc_id")).distinct(), "reps")
    few = reps.count() <= most_broadcast
    # Ids alone, and only up to a checked count; beyond it the texts are shuffled by id.
    left = pick.join(F.broadcast(reps), "doc_id", "left_semi")
    if not few:
        # In a fixed order, so that a task that is run again numbers its documents alike.
        left = pick.join(reps, "doc_id", "left_semi").sortWithinPartitions("doc_id", "text")
    frequent = left.mapInArrow(deal(True), _SCHEMA).groupBy("bucket").applyInPandas(lambda p: _shared_counts(p, True), _SCHEMA)

    def keys_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, _, sig = _header(pdf)
        hs, fs, ds = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.uint16)]
        for h, d in pdf.loc[pdf["kind"] == 0, ["hashes", "docs"]].itertuples(index=False):
            m = len(d) // 2
            hs.append(np.frombuffer(h[: 8 * m], np.uint64))
            fs.append(np.frombuffer(h[8 * m :], np.uint32))
            ds.append(np.frombuffer(d, np.uint16))
        h, f, d = np.concatenate(hs), np.concatenate(fs), np.concatenate(ds).astype(np.int64)
        order = np.lexsort((h, f, d))
        h, d = h[order], d[order]
        cut = np.searchsorted(d, np.arange(len(ids) + 1))
        out, may = [], allowed(n, percent)
        for k in range(len(ids)):
            own = h[cut[k] : cut[k + 1]]
            # Shingles of no other set come first in the order; they are no region.
            room = int(may[k]) + 1 - (int(n[k]) - len(own))
            if room > 0 and len(own):
                out.append((ids[k], n[k], *sig[k].tolist(), np.sort(own).tobytes(), own[:room].view(np.int64)))
        return pd.DataFrame(out, columns=["doc_id", "n", "s1", "s2", "shingles", "keys"])

    kept = frequent.groupBy("batch").applyInPandas(keys_batch, "doc_id long, n long, s1 long, s2 long, shingles binary, keys array<long>")
    # Repeated rows once; other texts of an id stay beside each other.
    kept = staged(kept.dropDuplicates(["doc_id", "s1", "s2"]).drop("s1", "s2"), "kept")
    keys = kept.select("doc_id", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    stars = keys.join(heads, "key").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()
    region = components(stars)
    inside = staged(kept.join(region, kept["doc_id"] == region["id"]).select("root", "doc_id", "n", "shingles", "keys"), "regions")
    weight = staged(inside.groupBy("root").agg((F.sum(F.length("shingles")) / 8).alias("w")), "weights")
    whole, large = weight.agg(F.sum("w"), F.coalesce(F.sum(F.when(F.col("w") > region_shingles, 1)), F.lit(0))).first()
    # Small regions share tasks, a quarter of the bound each on average.
    tasks = max(4 * tasks, int(4 * (whole or 0) / region_shingles))
    joined = inside.drop("keys").join(weight.filter(F.col("w") <= region_shingles), "root")
    links = [join_blocks(joined, percent=percent, bound=region_shingles, tasks=tasks)]
    if large:
        # Fewer than the table's shingles by the bound.
        heavy = weight.filter(F.col("w") > region_shingles)
        rows = inside.join(F.broadcast(heavy.select("root")), "root")
        links += split_region(rows, heavy, percent=percent, bound=region_shingles, rounds=rounds, pivots=pivots, tasks=tasks)
    sure = sets.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("lo"), F.max(F.struct("s1", "s2", "n")).alias("hi"))
    several = staged(sure.filter("lo <> hi").select("doc_id"), "several")
    repeated = several.limit(1).count() > 0
    if repeated:
        # Ids with several texts tie the classes of these together.
        of = sets.join(several, "doc_id", "left_semi").join(classes, ["s1", "s2", "n"])
        links.append(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b"))
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    roots = components(edges)
    named = classes.join(roots, classes["rep"] == roots["id"], "left").select("s1", "s2", "n", F.least("rep", F.coalesce("root", "rep")).alias("component_id"))
    got = sets.join(named, ["s1", "s2", "n"], "left")
    own = F.coalesce("component_id", "doc_id")
    if repeated:
        # A blank text of such an id is in the component of its other texts.
        tied = roots.join(several, roots["id"] == several["doc_id"], "left_semi").withColumnRenamed("root", "tied")
        got = got.join(tied, got["doc_id"] == tied["id"], "left")
        own = F.least(own, F.coalesce("tied", "doc_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = 75) -> list[tuple[int, int, int]]:
    """Reference result for tests, from the shingles themselves; rows of one id are one document."""
    import re

    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    low: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        low[top(k)] = min(d, low.get(top(k), d))
    return [(d, len(sets[k]), low[top(k)]) for k, (d, _) in enumerate(rows)]
