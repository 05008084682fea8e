"""Concatenate-and-cut packing of documents into sequences (operator 9).

Pass one encodes each partition, keeps the ids and each document's place within
its partition, and sums the partition's tokens. Prefix sums over these totals
give every document its place in the whole token stream. Pass two cuts the
stream into fixed windows; a document that crosses a boundary gives a record per
window it touches. The stream's remainder, shorter than a window, is cut at the
powers of two that make it up, so that no sequence needs padding.

Edge cases: null and empty texts are the single end id; repeated rows and null
ids are packed like any other; an empty table gives no pieces; a text longer than
a window gives as many pieces as it needs; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.bpe import encoder, remembered
from tallyspark.llm.scratch import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed_ids(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def tokenized(docs: DataFrame, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: pid, doc_id, tokens before it in the partition, its tokens and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, pid = encoder(vocab), 0, TaskContext.get().partitionId()
        kind = "<u2" if coder.n_ids <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            known = remembered(vocab, "bytes", _packed_ids)
            ids = [b"".join([known[p] for p in coder.pieces(t or "")] + [end]) for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            places = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            small = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), pid, np.int32)), batch.column(0), pa.array(places), pa.array(counts),
                    pa.array(np.full(len(ids), int(kind[-1]), np.int32)), pa.array(small, pa.binary()),
                ],
                ["pid", "doc_id", "place", "n", "width", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "pid int, doc_id long, place long, n long, width int, ids binary")


def tail_boundaries(total: int, window: int) -> np.ndarray:
    """Where the sequences of the stream's remainder begin, and where it ends."""
    at = total - total % window
    bounds = [at]
    for bit in reversed(range(window.bit_length())):
        if (total - bounds[0]) >> bit & 1:
            at += 1 << bit
            bounds.append(at)
    return np.array(bounds, np.int64)


def pack(
    docs: DataFrame, vocab: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One record per piece: the document's span, its sequence and place there."""
    table = materialize(tokenized(docs, vocab, end_id, id_col, text_col), "packing")
    totals = table.groupBy("pid").agg(F.sum("n").alias("tokens"))  # a row per input split
    before = F.sum("tokens").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("pid", F.coalesce(before, F.lit(0)).alias("base"))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    tail = tail_boundaries(total, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "width", "ids")]
            for doc_id, at, n, width, raw in zip(*columns, strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                bounds = np.arange(at // window + 1, (at + n - 1) // window + 1, dtype=np.int64) * window
                bounds = np.union1d(bounds, tail[(tail > at) & (tail < at + n)])
                edges = [at, *bounds.tolist(), at + n]
                for a, b in zip(edges, edges[1:], strict=False):
                    k = int(np.searchsorted(tail, a, "right")) - 1
                    sequence = a // window if k < 0 else int(tail[0]) // window + k
                    offset = a % window if k < 0 else a - int(tail[k])
                    out.append((doc_id, a - at, b - a, zlib.crc32(ids[a - at : b - at].tobytes()), n, sequence, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    # A row of two numbers per input split: some megabytes even for a million splits.
    placed = table.join(F.broadcast(bases), "pid").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "n", "width", "ids")
    return placed.mapInArrow(cut, PIECES)
