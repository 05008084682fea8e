"""Vectorised word hashes over batches of UTF-8 texts.

Texts of a batch are laid end to end, parted by blanks, in blocks of about
``BLOCK_BYTES`` (a longer text is a block by itself). Each word's 64-bit hash is
a polynomial in its bytes, taken from one running sum over the block, so the cost
per byte is the same for short and long words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: A block's working arrays take some hundred times its bytes, and a worker keeps what it once took.
BLOCK_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Blank, and tab to carriage return, end a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters of ASCII, and all bytes of other letters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, long enough for n bytes."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


#: Rows, and bytes of rows, that reach a Python worker at a time: texts are long.
BATCH_ROWS, BATCH_BYTES = 2048, 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH_ROWS`` rows at most and end at ``BATCH_BYTES``, which bounds a worker's memory.

    A bound of bytes that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    spark.conf.set(key, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def text_field(column: pa.Array, name: str) -> pa.Array:
    """The text inside a column of whole rows, so that it need not be sent beside them."""
    return pc.struct_field(column, name).cast(pa.string())


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, start of each row's text) for block after block."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        starts = np.cumsum([0, *(len(t) + 1 for t in part)], dtype=np.int64)[:-1]
        yield at, end - at, np.frombuffer(b" ".join(part) + b" ", np.uint8), starts
        at = end


def word_starts(space: np.ndarray) -> np.ndarray:
    begins = ~space
    begins[1:] &= space[:-1]
    return np.flatnonzero(begins)


def word_hashes(data: np.ndarray, space: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hash of the word that begins at each place; blanks count nothing."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    value = _VALUE[data]
    value[space] = 0
    value *= power[: len(data)]
    sums = np.cumsum(value, dtype=np.uint64)
    edge = np.append(begins[1:], len(data)) - 1
    total = sums[edge]
    first = np.where(begins > 0, sums[np.maximum(begins, 1) - 1], np.uint64(0))
    return mix((total - first) * inverse[begins])


def row_of(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row, within the block, of each word."""
    return np.searchsorted(starts, begins, "right") - 1


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def joined_hash(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each run of n words; the last n - 1 words begin none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, (seed * _BASE) & _MASK, np.uint64)
    for j in range(n):
        total = (total + words[j : len(words) - n + 1 + j]) * np.uint64((_BASE * (2 * j + 3)) & _MASK | 1)
        total ^= total >> np.uint64(29)
    return mix(total)
