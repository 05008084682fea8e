"""Running sums and drawdowns of very long sequences, one per key, without a task that holds one.

Rows are range-partitioned by key and order, written once, and each range of a key is
summarised by (sum, highest prefix, rows); these summaries combine in order, so one
row per key and range is all that a second pass needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import settled


def placed(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str], partitions: int | None) -> DataFrame:
    """``df`` with its range ``_part``, and place ``_n`` and sum ``_sum`` within the key's rows there."""
    order = [*keys, *order_by]
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # Written, so that the ranges are drawn once; what is read back is grouped by range where it lies.
    dealt = settled(dealt.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order_by)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumns({"_sum": F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(upto), "_n": F.row_number().over(inside) - 1})


def _offsets(placed: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Per key and range: what lies before it. A row per key and range, so one task may order a key's."""
    totals = placed.groupBy("_part", *keys).agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("_total"), F.max("_sum").alias("_high"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = totals.withColumns(
        {"_base": F.coalesce(F.sum("_total").over(before), F.lit(0.0)), "_first": F.coalesce(F.sum("_rows").over(before), F.lit(0))}
    )
    peak = F.coalesce(F.max(F.col("_base") + F.col("_high")).over(before), F.lit(0.0))
    return shifted.select(F.col("_part").alias("_at"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_base", "_first", peak.alias("_peak"))


def _joined(placed: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    offsets = _offsets(placed, value, keys)
    on: Column = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, on).drop("_at", *(f"_k{i}" for i in range(len(keys))))


def running_sum(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``position`` (from 0) and ``running`` in each key's sequence (null values count as 0)."""
    joined = _joined(placed(df, value, order_by, keys, partitions), value, keys)
    return joined.withColumns({"position": F.col("_first") + F.col("_n"), "running": F.col("_base") + F.col("_sum")}).drop(
        "_part", "_sum", "_n", "_base", "_first", "_peak"
    )


def max_drawdown(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Per key: the largest fall of the running sum from its peak, 0 being the first peak."""
    columns = list(dict.fromkeys([*keys, *order_by, value]))
    joined = _joined(placed(df.select(*columns), value, order_by, keys, partitions), value, keys)
    inside = Window.partitionBy("_part", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("_base") + F.col("_sum")
    peak = F.greatest(F.lit(0.0), F.col("_peak"), F.max(level).over(inside))
    return joined.select(*keys, (peak - level).alias("fall")).groupBy(*keys).agg(F.coalesce(F.max("fall"), F.lit(0.0)).alias("max_drawdown"))
