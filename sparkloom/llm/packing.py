"""Operator 8: harmonic packing of token pieces into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import temporary_path

PIECES = "doc_id long, start long, length long, doc_tokens long, piece long, ids binary"
SEQUENCES = "sequence_id long, fill int, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"


def id_type(tokenizer_path: str, *more: int) -> str:
    """The narrowest of numpy's little-endian types that holds every id of a vocabulary, and ``more``."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), *more) < 1 << 16 else "<u4"


def cut(n: int, size: int, slack: float) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole sequences first, then the rest.

    A rest r has the class k = size // r, whose bins hold k pieces. If it fills its share size/k
    to within ``slack`` it stays whole; else it gives up a piece of exactly size // (k + 1), which
    fills class k + 1, and what is left is cut the same way. Leftovers shrink with the square, so
    a document is cut a few times at most.
    """
    out = [size] * (n // size)
    r = n % size
    while r:
        k = size // r
        if r * k >= (1 - slack) * size or k >= 32:
            out.append(r)
            break
        part = size // (k + 1)
        out.append(part)
        r -= part
    return out


def pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    size: int = 2048, slack: float = 1 / 64, cache: int = 350_000, kind: str = "<u4",
) -> DataFrame:
    """One row for each piece of each document, with its ids (``kind``) and a number of its own.

    A null or empty text has the end id alone. ``cache`` bounds the chunks whose ids a worker keeps:
    fewer take less memory and more CPU. Texts are encoded where they are read.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    width = int(kind[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from sparkloom.llm.tokens import chunk_encoder

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(6)]
                for doc, b in zip(part.column(0).to_pylist(), chunk_encoder(tokenizer_path, cache).encode(part.column(1).to_pylist())):
                    b += end
                    n, first = len(b) // 4, 0
                    if width < 4:
                        b = np.frombuffer(b, "<u4").astype(kind).tobytes()
                    for length in cut(n, size, slack):
                        for o, v in zip(out, (doc, first, length, n, number, b[width * first : width * (first + length)])):
                            o.append(v)
                        first, number = first + length, number + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(out)], names=[f.split()[0] for f in PIECES.split(", ")]
                )

    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pick.mapInArrow(run, PIECES)


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Class k = size // length; every k pieces of a class are a bin.
    What a class has over goes, longest first, into the fullest bin that still has room."""
    k = size // lengths
    order = np.argsort(k, kind="stable")
    ks = k[order]
    first = np.r_[0, np.flatnonzero(np.diff(ks)) + 1]
    rank = np.arange(len(ks)) - np.repeat(first, np.diff(np.r_[first, len(ks)]))
    count = np.repeat(np.diff(np.r_[first, len(ks)]), np.diff(np.r_[first, len(ks)]))
    full = rank < (count // ks) * ks
    bins = np.full(len(lengths), -1, np.int64)
    step = np.where(rank % ks == 0, 1, 0) * full
    bins[order[full]] = np.cumsum(step)[full] - 1
    made = int(step.sum())
    rest = order[~full]
    rest = rest[np.argsort(-lengths[rest], kind="stable")]
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    for i in rest.tolist():
        need = int(lengths[i])
        room = next((r for r in range(need, size + 1) if by_room[r]), None)
        if room is None:
            b, room = made, size
            made += 1
        else:
            b = by_room[room].pop()
        bins[i] = b
        by_room[room - need].append(b)
    by_bin = np.argsort(bins, kind="stable")
    sums = np.cumsum(lengths[by_bin]) - lengths[by_bin]
    starts = np.r_[0, np.flatnonzero(np.diff(bins[by_bin])) + 1] if len(bins) else np.empty(0, np.int64)
    base = np.repeat(sums[starts], np.diff(np.r_[starts, len(bins)]))
    offsets = np.empty(len(bins), np.int64)
    offsets[by_bin] = sums - base
    return bins, offsets


def pack(parts: DataFrame, workers: int, *, size: int = 2048, pad_id: int = 0, kind: str = "<u4") -> DataFrame:
    """Sequences of the pieces (``PIECES``): sequence_id, fill, ids padded to ``size`` unless the fill
    is a power of two, and the pieces in their order.

    Workers pack apart: pieces are dealt to them by the hash of their numbers, so at most the pieces
    that no class could complete (under ``size`` for each of some 90 classes) share mixed bins in a
    worker, whatever the input's size.
    """
    pad = np.full(size, pad_id, kind).tobytes()
    width = int(kind[-1])
    struct = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        meta = {n: table.column(n).to_numpy() for n in ("start", "length", "piece")}
        # The same bins whatever the order in which the shuffle delivers.
        order = np.argsort(meta["piece"], kind="stable")
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = place(meta["length"][order].astype(np.int64), size)
        order = np.lexsort((offsets, bins))
        edge = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1, len(order)]
        first = TaskContext.get().partitionId() << 40
        for at in range(0, len(edge) - 1, 1000):
            cut_at = edge[at : at + 1001]
            rows = order[cut_at[0] : cut_at[-1]]
            some = table.take(pa.array(rows))
            ids, lengths = some.column("ids").to_pylist(), meta["length"][rows]
            cuts = cut_at - cut_at[0]
            fill = np.add.reduceat(lengths, cuts[:-1])
            whole = [
                b"".join(ids[a:b]) + (pad[: width * (size - n)] if n & (n - 1) else b"")
                for a, b, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), fill.tolist())
            ]
            cols = [some.column(n).combine_chunks() for n in ("doc_id", "start", "length", "doc_tokens")]
            made = pa.StructArray.from_arrays([*cols, pa.array(offsets[rows])], fields=list(struct))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first + np.arange(at, at + len(fill))), pa.array(fill.astype(np.int32)), pa.array(whole, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), made),
                ],
                names=["sequence_id", "fill", "ids", "pieces"],
            )

    return parts.repartition(workers, F.xxhash64("piece")).mapInArrow(run, SEQUENCES)


def read_sequences(spark: SparkSession, path: str, *, kind: str) -> DataFrame:
    """The pieces of written sequences: doc_id, start, length, ids_crc32 of their ids as little-endian
    unsigned 32-bit integers, doc_tokens, sequence_id, offset."""
    names = ("doc_id", "start", "length", "doc_tokens", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            got = dict(zip(names, lists.flatten().flatten()))
            at, crc = 0, []
            spans = list(zip(got["offset"].to_pylist(), got["length"].to_pylist()))
            for raw, n in zip(b.column(1).to_pylist(), counts.tolist()):
                ids = memoryview(np.frombuffer(raw, kind).astype("<u4").tobytes())
                crc += [zlib.crc32(ids[4 * o : 4 * (o + size)]) for o, size in spans[at : at + n]]
                at += n
            yield pa.RecordBatch.from_arrays(
                [got["doc_id"], got["start"], got["length"], pa.array(crc, pa.int64()), got["doc_tokens"], pa.array(np.repeat(b.column(0).to_numpy(), counts)), got["offset"]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    rows = spark.read.schema(SEQUENCES).parquet(path).select("sequence_id", "ids", "pieces")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, path: str | None = None, text_col: str = "text", size: int = 2048,
    end_id: int = 1, pad_id: int = 0, worker_bytes: int = 64 << 20, worker_rows: int = 200_000, **more,
) -> DataFrame:
    """Packs whole texts into sequences, writes these to ``path`` (the shared folder, if not given) and
    returns their pieces as read back from there.

    There is a worker for each ``worker_bytes`` of text and ``worker_rows`` documents: an id takes
    a byte of text or more, so this bounds what one holds. Null and empty texts are the end id
    alone; rows without an id and repeated rows are packed like all others; an empty table gives nothing.
    """
    spark = docs.sparkSession
    path = path or temporary_path(spark, "sequences")
    kind = id_type(tokenizer_path, end_id, pad_id)
    total, rows = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.count(F.lit(1))).first()
    workers = max(1, -(-(total or 0) // worker_bytes), -(-rows // worker_rows))
    parts = pieces(docs, tokenizer_path, text_col=text_col, size=size, end_id=end_id, kind=kind, **more)
    pack(parts, workers, size=size, pad_id=pad_id, kind=kind).write.option("compression", "none").parquet(path)
    return read_sequences(spark, path, kind=kind)


def padding(packed: pd.DataFrame, size: int = 2048) -> float:
    """Share of padding over all sequences; one whose fill is a power of two needs none."""
    fill = packed.groupby("sequence_id")["length"].sum().to_numpy()
    pad = np.where((fill & (fill - 1)) == 0, 0, size - fill)
    return float(pad.sum() / max(1, (fill + pad).sum()))
