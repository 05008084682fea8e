"""Held-out splits and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents.

    ``docs`` has doc_id and text. The ids with the smallest hashes are taken, so the
    choice is the same at each run; rows without an id or a label take no part. An
    id with both labels trains with each; of an id whose rows repeat the smallest
    text trains, so copies of one id never swell the sample. The chosen ids are a
    table of at most ``bound`` rows, which is why it may be broadcast.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & keep)
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(bound)
    )
    found = docs.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
