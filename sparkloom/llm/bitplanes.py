"""Operator 2: token ids as plane-shuffled, zstandard-compressed blocks with a chunk index."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import shuffle_partitions

CHUNK_SCHEMA = (
    "shard int, chunk int, first long, n long, planes binary, plane_sizes array<int>, mode string, "
    "doc_ids array<long>, doc_lens array<long>"
)


def pack_block(ids: np.ndarray, mode: str, level: int = 1) -> tuple[bytes, list[int]]:
    """Planes of one block: ``byte`` has 4 planes of n bytes, ``bit`` 32 planes of n/8 bytes; a
    plane of zeros is stored with size 0."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if mode == "byte":
        planes = [raw[:, k].tobytes() if top >> (8 * k) else b"" for k in range(4)]
    elif mode == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    else:
        raise ValueError(f"unknown plane mode {mode!r}")
    z = zstandard.ZstdCompressor(level=level)
    out = [z.compress(p) if p.strip(b"\0") else b"" for p in planes]
    return b"".join(out), [len(p) for p in out]


def unpack_block(data: bytes, sizes: list[int], n: int, mode: str) -> np.ndarray:
    import zstandard

    z, at, planes = zstandard.ZstdDecompressor(), 0, []
    if mode == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, size in enumerate(sizes):
            if size:
                out[:, k] = np.frombuffer(z.decompress(data[at : at + size], max_output_size=n), np.uint8)
            at += size
        return out.view("<u4").ravel()
    width = -(-n // 8)
    for size in sizes:
        p = z.decompress(data[at : at + size], max_output_size=width) if size else bytes(width)
        planes.append(np.frombuffer(p, np.uint8))
        at += size
    bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def pack_ids(ids: np.ndarray, mode: str = "byte", block: int = 65_536, level: int = 1) -> tuple[bytes, list[int]]:
    """A chunk: its fixed-size blocks (the last may be short), planes one after the other."""
    data, sizes = [], []
    for at in range(0, len(ids), block):
        d, s = pack_block(ids[at : at + block], mode, level)
        data.append(d)
        sizes += s
    return b"".join(data), sizes


def unpack_ids(data: bytes, sizes: list[int], n: int, mode: str = "byte", block: int = 65_536) -> np.ndarray:
    per, at, out = (4 if mode == "byte" else 32), 0, []
    for k, start in enumerate(range(0, n, block)):
        s = sizes[k * per : (k + 1) * per]
        out.append(unpack_block(data[at : at + sum(s)], s, min(block, n - start), mode))
        at += sum(s)
    return np.concatenate(out) if out else np.empty(0, "<u4")


def write_ids(
    docs: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 2, shards: int | None = None, shard_bytes: int = 512 << 20, chunk_ids: int = 262_144, block: int = 65_536,
    mode: str = "byte", level: int = 1,
) -> None:
    """Encodes every text and writes ids in ascending ``id_col`` order.

    One range shuffle brings documents into id order (a null id comes first, equal ids by hash and text);
    each range is a shard, one for each ``shard_bytes`` of text or more. A chunk holds whole documents up to about ``chunk_ids`` ids, as blocks
    of ``block`` ids whose byte (or bit) planes are compressed apart. A row of the Parquet
    container is a chunk: everything but ``planes`` is the chunk index, which readers of single
    documents can scan without touching a plane. A null text is empty and gives the end id alone;
    an empty table gives an index without rows. Only Spark's writer touches the file system, so
    the path may be on any store, and lost tasks are redone without a trace.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(CHUNK_SCHEMA))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from sparkloom.llm.tokens import chunk_encoder

        enc, shard = chunk_encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[bytes] = []
        ids: list[int | None] = []
        at, chunk, first = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, at, chunk, first
            lens = [len(x) // 4 for x in held]
            data, sizes = pack_ids(np.frombuffer(b"".join(held), "<u4"), mode, block, level)
            row = [[shard], [chunk], [first], [at], [data], [sizes], [mode], [ids], [lens]]
            first, chunk = first + at, chunk + 1
            held, ids, at = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, out)], schema=out)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, b in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    held.append(b + end)
                    ids.append(doc)
                    at += len(b) // 4 + 1
                    if at >= chunk_ids:
                        yield flush()
        if held:
            yield flush()

    pick = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not shards:
        total = pick.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(shuffle_partitions(spark), -(-total // shard_bytes))
    # Rows of one id, or without one, are in the order of their texts' hashes and can be several shards.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    dealt = pick.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, *, block: int = 65_536, with_ids: bool = True) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    Chunks are decoded where they lie, each on its own. ``start`` counts the ids of all documents
    before: the position in the shard from the index plus the totals of earlier shards, of which
    the driver holds one number a shard.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    base, rows = 0, []
    for shard, n in sorted((r["shard"], r["n"]) for r in totals):
        rows.append((shard, base))
        base += n
    schema = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_ids(r["planes"], r["plane_sizes"], r["n"], r["mode"], block)
                raw, ends = ids.tobytes(), np.cumsum(r["doc_lens"])
                starts = ends - r["doc_lens"]
                cols = [
                    pa.array(np.full(len(ends), r["shard"], np.int32)),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array((starts + r["first"]).astype(np.int64)),
                    pa.array(np.asarray(r["doc_lens"], np.int64)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    found = chunks.mapInArrow(run, schema)
    starts = spark.createDataFrame(rows, "shard int, base long")
    # One row a shard: bounded by the shard count given to the writer.
    return found.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def read_docs(spark: SparkSession, path: str, doc_ids: list[int], *, block: int = 65_536) -> DataFrame:
    """Ids of some documents: the index picks the chunks, only their planes are decoded."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    hit = chunks.filter(F.arrays_overlap("doc_ids", F.lit([int(x) for x in doc_ids])))
    schema = "doc_id long, ids array<long>"
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_ids(r["planes"], r["plane_sizes"], r["n"], r["mode"], block)
                ends = np.cumsum(r["doc_lens"])
                got = [(d, ids[e - n : e].astype(np.int64)) for d, n, e in zip(r["doc_ids"], r["doc_lens"], ends) if d in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                    names=["doc_id", "ids"],
                )

    return hit.mapInArrow(run, schema)
