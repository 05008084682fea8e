"""Quality scores by hashed word n-gram logistic regression (operator 1).

Each text is seen as two streams of words: the words themselves, lower-cased, and
their shapes (runs of small letters, capitals, digits and each mark, cut to one;
a word that repeats the one before it has a shape of its own). n-grams of both
streams are hashed into ``2**bits`` weights. Training runs follow-the-regularised-
leader updates over shards of a bounded labelled sample side by side and averages
the shards' weights; a score is the logistic of a sparse dot product with the
text's n-gram shares.

Edge cases: null and empty texts have no n-gram and get the score of the bias;
without any training row every score is 0.5; each input row gives one row; rows
with a null id are scored and never train; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import words as W
from tallyspark.llm.labels import labelled_sample, remainder

#: Labelled documents that training uses at most.
TRAIN_DOCS = 20_000
#: Shards that train side by side.
SHARDS = 8
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0001
#: Scales n-gram shares so that one full share moves a score well.
SCALE = 4.0

_SHAPE = np.where(W.IS_LETTER, ord("a"), np.arange(256)).astype(np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")


def _shape_words(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes, in the words' order."""
    shape = _SHAPE[data]
    shape[space] = 32
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    short = shape[keep]
    blank = short == 32
    return W.word_hashes(short, blank, W.word_starts(blank))


def block_features(data: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, weight index) of each n-gram of a block, stream by stream."""
    space = W.IS_SPACE[data]
    begins = W.word_starts(space)
    rows = W.row_of(begins, starts)
    plain = W.word_hashes(W.LOWER[data], space, begins)
    shapes = _shape_words(data, space)
    again = np.zeros(len(plain), bool)
    again[1:] = (plain[1:] == plain[:-1]) & (rows[1:] == rows[:-1])
    shapes = np.where(again, np.uint64(0x5BD1E995), shapes)
    size = np.uint64((1 << bits) - 1)
    for seed, stream, n in ((1, plain, 1), (2, plain, 2), (3, shapes, 1), (4, shapes, 2), (5, shapes, 3)):
        grams = W.joined_hash(stream, n, seed)
        whole = rows[: len(grams)] == rows[n - 1 :] if len(grams) else np.zeros(0, bool)
        yield rows[: len(grams)][whole], (grams[whole] % size).astype(np.int64) + 1


def sparse_rows(texts: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text, the bias at index 0."""
    for _, n, data, starts in W.blocks(texts):
        found = list(block_features(data, starts, bits))
        share = [SCALE / np.maximum(np.bincount(r, minlength=n), 1) for r, _ in found]
        row = np.concatenate([r for r, _ in found])
        key = row << np.int64(32) | np.concatenate([i for _, i in found])
        value = np.concatenate([s[r] for s, (r, _) in zip(share, found, strict=True)])
        key, where = np.unique(key, return_inverse=True)
        value = np.bincount(where, weights=value, minlength=len(key))
        edges = np.searchsorted(key >> np.int64(32), np.arange(n + 1))
        for i in range(n):
            at = slice(edges[i], edges[i + 1])
            yield np.append(key[at] & np.int64(0xFFFFFFFF), 0), np.append(value[at], 1.0)


def follow_the_leader(texts: list[bytes], labels: np.ndarray, bits: int, epochs: int) -> np.ndarray:
    """Weights after per-coordinate regularised-leader updates over the rows, in turn."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for (at, x), y in zip(sparse_rows(texts, bits), labels, strict=True):
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS, shards: int = SHARDS) -> np.ndarray:
    """The mean of the shards' weights; ``sample`` is bounded (doc_id, text, label)."""

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "label"])
        texts = [(t or "").encode() for t in rows["text"]]
        w = follow_the_leader(texts, rows["label"].to_numpy(float), bits, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    dealt = sample.select("doc_id", "text", "label", F.xxhash64("doc_id", F.lit(7)).alias("order"))
    parts = dealt.groupBy(F.pmod("order", F.lit(shards)).alias("shard")).applyInPandas(shard, "at long, w double")
    mean = parts.groupBy("at").agg((F.sum("w") / shards).alias("w")).toArrow()  # at most 2**bits + 1 rows
    out = np.zeros((1 << bits) + 1)
    out[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return out


def score_blocks(texts: list[bytes], weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.full(len(texts), weights[0])
    for at, n, data, starts in W.blocks(texts):
        for rows, index in block_features(data, starts, bits):
            total = np.bincount(rows, weights=weights[index], minlength=n)
            out[at : at + n] += SCALE * total / np.maximum(np.bincount(rows, minlength=n), 1)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], inside: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of each row; the text is ``docs.text``, or the field ``inside`` of the first kept column."""
    bits = (len(weights) - 1).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(float)
        for batch in batches:
            text = W.text_field(batch.column(0), inside) if inside else batch.column(len(keep))
            found = score_blocks(W.utf8(text), w, bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found)], [*keep, "score"])

    W.small_batches(docs.sparkSession)
    rows = docs.select(*keep) if inside else docs.select(*keep, "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())]))


def classify(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, bound: int = TRAIN_DOCS,
    label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Train on labelled rows outside the held-out remainder and score every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weights = train(labelled_sample(rows, labels, label, remainder("doc_id", modulus) != held_out, bound))
    return score(rows, weights, ["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_poor(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score 0.5 or more; every labelled row may train."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weights = train(labelled_sample(rows.select("doc_id", "text"), labels, "quality", F.lit(True), bound))
    return score(rows, weights, ["row"], text_col).filter("score >= 0.5").select("row.*")
