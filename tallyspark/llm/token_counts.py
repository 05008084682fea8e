"""Exact token counts from one length histogram (operator 3).

Documents are aggregated by encoded length; suffix sums over the lengths answer
totals, quantiles and truncated totals for every context limit at once.

Edge cases: null and empty texts have length 0 and count as documents; repeated
rows count each time; an empty table gives an empty histogram; only the text
column is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.bpe import encoder, remembered
from tallyspark.llm.scratch import materialize

#: Lengths that share a block of the suffix sums.
BLOCK = 4096
#: Context limits and quantiles that are answered beside the lengths that occur.
LIMITS = (0, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def encoded_lengths(docs: DataFrame, vocab: str, text_col: str = "text") -> DataFrame:
    """One encoded length per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        for batch in batches:
            known = remembered(vocab, "length", len)
            lengths = [sum([known[p] for p in coder.pieces(t or "")]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length -> n_docs; a row per distinct length leaves each task."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per distinct length L, taken as a context limit.

    ``docs_at_least`` and ``tokens_at_least`` are over documents of L tokens or
    more, ``truncated_tokens`` is the sum of min(length, L) over all documents and
    ``docs_within`` the share of documents that fit. The sums run inside blocks of
    lengths first and then over the blocks' totals.
    """
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens")).withColumn(
        "block", F.floor(F.col("length") / BLOCK)
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy()
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(over).alias("all_docs"),
        F.sum("block_tokens").over(over).alias("all_tokens"),
    )
    return (
        rows.select(
            "block", "length", "n_docs", "n_tokens",
            F.sum("n_docs").over(inside).alias("docs_in"),
            F.sum("n_tokens").over(inside).alias("tokens_in"),
        )
        .join(totals, "block")
        .select(
            F.col("length").alias("context_limit"),
            "n_docs",
            "n_tokens",
            (F.col("docs_in") + F.col("docs_above")).alias("docs_at_least"),
            (F.col("tokens_in") + F.col("tokens_above")).alias("tokens_at_least"),
            (
                F.col("all_tokens") - F.col("tokens_in") - F.col("tokens_above")
                + F.col("length") * (F.col("docs_in") + F.col("docs_above"))
            ).alias("truncated_tokens"),
            (
                (F.col("all_docs") - F.col("docs_in") - F.col("docs_above") + F.col("n_docs")) / F.col("all_docs")
            ).alias("docs_within"),
        )
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The columns of ``suffix_sums`` for any context limits, whether a document has that length or not.

    The sums of a limit are those of the next length at or above it. ``n_docs`` and
    ``n_tokens`` count the documents of just that length.
    """
    asked = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits)))
    rows = sums.withColumn("asked", asked)
    above, same = F.col("context_limit") >= F.col("asked"), F.col("context_limit") == F.col("asked")
    found = rows.groupBy("asked").agg(
        F.coalesce(F.max(F.when(same, F.col("n_docs"))), F.lit(0)).alias("n_docs"), F.coalesce(F.max(F.when(same, F.col("n_tokens"))), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.max(F.when(above, F.col("docs_at_least"))), F.lit(0)).alias("docs_at_least"),
        F.coalesce(F.max(F.when(above, F.col("tokens_at_least"))), F.lit(0)).alias("tokens_at_least"),
        F.max("docs_at_least").alias("all_docs"), F.max("tokens_at_least").alias("all_tokens"),
    )
    return found.select(
        F.col("asked").alias("context_limit"), "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("asked") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("docs_within"),
    )


def at_quantiles(sums: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(quantile, ...): the row of ``suffix_sums`` of the smallest length that so large a share of documents fits."""
    rows = sums.withColumn("quantile", F.explode(F.array(*(F.lit(float(q)) for q in quantiles)))).filter(F.col("docs_within") >= F.col("quantile"))
    first = rows.groupBy("quantile").agg(F.min_by(F.struct(*sums.columns), "context_limit").alias("at"))
    return first.select("quantile", "at.*")


def token_counts(
    docs: DataFrame, vocab: str, limits: Sequence[int] = LIMITS, quantiles: Sequence[float] = QUANTILES, text_col: str = "text"
) -> DataFrame:
    """``suffix_sums`` of every length (kind ``length``), of the limits (``limit``) and of the quantiles (``quantile``)."""
    sums = materialize(suffix_sums(length_histogram(encoded_lengths(docs, vocab, text_col))), "length-sums")
    no_quantile = F.lit(None).cast("double").alias("quantile")
    found = sums.select(F.lit("length").alias("kind"), no_quantile, *sums.columns)
    if limits:
        found = found.unionByName(at_limits(sums, limits).select(F.lit("limit").alias("kind"), no_quantile, *sums.columns))
    if quantiles:
        found = found.unionByName(at_quantiles(sums, quantiles).select(F.lit("quantile").alias("kind"), "quantile", *sums.columns))
    return found
