"""Running totals and drawdowns kept as summaries per journal and day, so that late rows change only their days.

A segment of a sequence is summarised by its total, its highest and lowest prefix and the
largest fall inside it. Two neighbouring segments compose: the later one's prefixes start from
the earlier one's total, and a fall may run from a peak of the earlier to a low of the
later. Days are summaries of the ranges that their rows are dealt to, journals those
of their days; what is stored is a row per journal and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.prefix_scan import placed

SUMMARY = ("rows", "total", "high", "low", "fall")


def composed(segments: DataFrame, keys: Sequence[str], order: str, start: float | None = None) -> DataFrame:
    """``keys`` and SUMMARY of each key's segments in the order of ``order``; ``start`` is a peak before the first, if there is one.

    A row per segment: no task sees more of a key.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    based = segments.withColumn("_base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    based = based.withColumn("_peak", F.max(F.col("_base") + F.col("high")).over(before))
    peak = F.col("_peak") if start is None else F.greatest(F.coalesce("_peak", F.lit(start)), F.lit(start))
    fall = F.greatest(F.col("fall"), F.coalesce(peak - F.col("_base") - F.col("low"), F.lit(0.0)))
    return based.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.max(F.col("_base") + F.col("high")).alias("high"), F.min(F.col("_base") + F.col("low")).alias("low"), F.max(fall).alias("fall")
    )


def day_summaries(df: DataFrame, value: str, order_by: Sequence[str], time: str, keys: Sequence[str] = ("journal_id",), partitions: int | None = None) -> DataFrame:
    """``keys``, day and SUMMARY of the rows that have a time; null values count as 0. Days are dealt by ranges, so a long day is many tasks."""
    columns = list(dict.fromkeys([*keys, *order_by, value, time]))
    rows = df.filter(F.col(time).isNotNull()).select(*columns, F.to_date(time).alias("day"))
    dealt = placed(rows, value, order_by, [*keys, "day"], partitions)
    inside = Window.partitionBy("_part", *keys, "day").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    fallen = dealt.withColumn("_fall", F.max("_sum").over(inside) - F.col("_sum"))
    total = F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("total")
    ranges = fallen.groupBy("_part", *keys, "day").agg(F.count(F.lit(1)).alias("rows"), total, F.max("_sum").alias("high"), F.min("_sum").alias("low"), F.max("_fall").alias("fall"))
    return composed(ranges, [*keys, "day"], "_part")


def refreshed(stored: DataFrame, late: DataFrame, whole: DataFrame, value: str, order_by: Sequence[str], time: str, keys: Sequence[str] = ("journal_id",)) -> DataFrame:
    """``stored`` summaries after ``late`` rows joined ``whole``, the rows as they are now: only the days of late rows are summarised anew.

    Of ``whole`` only the days that late rows fall on are read on; where it is partitioned by day, its others are not read.
    """
    days = late.filter(F.col(time).isNotNull()).select(*keys, F.to_date(time).alias("day")).distinct()
    touched = whole.withColumn("day", F.to_date(time)).join(days, [*keys, "day"], "left_semi").drop("day")
    return stored.join(days, [*keys, "day"], "left_anti").unionByName(day_summaries(touched, value, order_by, time, keys))


def drawdowns(days: DataFrame, keys: Sequence[str] = ("journal_id",)) -> DataFrame:
    """``keys``, rows, total and max_drawdown of whole journals from their days; the first peak is 0."""
    return composed(days, list(keys), "day", 0.0).select(*keys, "rows", "total", F.col("fall").alias("max_drawdown"))
