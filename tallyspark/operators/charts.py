"""Data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import prefix_scan


def monthly_profit(df: DataFrame, keys: Sequence[str], time: str, profit: str) -> DataFrame:
    month = F.date_format(time, "yyyy-MM").alias("month")
    return df.filter(F.col(time).isNotNull()).groupBy(*keys, month).agg(F.sum(F.coalesce(F.col(profit), F.lit(0))).alias("profit"))


def equity_curve(df: DataFrame, keys: Sequence[str], profit: str, order_by: Sequence[str]) -> DataFrame:
    """Position from 0, running sum (missing profit is 0) and the sign of the final total."""
    rows = df.select(*dict.fromkeys([*keys, *order_by]), F.coalesce(F.col(profit).cast("double"), F.lit(0.0)).alias("_value"))
    curve = prefix_scan.running_sum(rows, "_value", order_by, keys)
    totals = rows.groupBy(*keys).agg(F.signum(F.sum("_value")).alias("final_sign"))
    return curve.join(totals, list(keys)).select(*keys, "position", F.col("running").alias("equity"), "final_sign")


def profit_series(df: DataFrame, keys: Sequence[str], profit: str, order_by: Sequence[str]) -> DataFrame:
    value = F.coalesce(F.col(profit), F.lit(0))
    rows = prefix_scan.running_sum(df.select(*dict.fromkeys([*keys, *order_by]), value.alias("_value")), "_value", order_by, keys)
    value = F.col("_value")
    sign = F.when(value > 0, "win").when(value < 0, "loss").otherwise("flat")
    return rows.select(*keys, "position", value.alias("profit"), sign.alias("sign"))


def histogram(df: DataFrame, keys: Sequence[str], profit: str, bins: int = 40) -> DataFrame:
    """Equal bins over [-m, m] with m the largest magnitude; the last bin holds its right end."""
    rows = df.filter(F.col(profit).isNotNull()).select(*keys, F.col(profit).cast("double").alias("p"))
    widest = rows.groupBy(*keys).agg(F.max(F.abs("p")).alias("m")).withColumn("m", F.when(F.col("m") > 0, F.col("m")).otherwise(1.0))
    placed = rows.join(widest, list(keys))
    place = F.least(F.floor((F.col("p") + F.col("m")) / (2 * F.col("m") / bins)), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = widest.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = 2 * F.col("m") / bins
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") * width - F.col("m") + width / 2).alias("midpoint"), width.alias("width"), F.coalesce("n", F.lit(0)).alias("n")
    )


def win_loss(df: DataFrame, keys: Sequence[str], symbol: str, side: str, profit: str) -> DataFrame:
    """Wins and losses (0 is a loss here) by symbol for Overall, Buy and Sell.

    Only the literal sides buy and sell have sections; missing profit counts in neither.
    """
    rows = df.select(*keys, F.col(symbol).alias("symbol"), F.lower(F.trim(side)).alias("side"), F.col(profit).alias("p"))
    rows = rows.withColumn("section", F.when(F.col("side") == "buy", "Buy").when(F.col("side") == "sell", "Sell"))
    sections = F.explode(F.array_compact(F.array(F.lit("Overall"), F.col("section"))))
    return rows.select(*keys, sections.alias("section"), "symbol", "p").groupBy(*keys, "section", "symbol").agg(
        F.count_if(F.col("p") > 0).alias("wins"), F.count_if(F.col("p") <= 0).alias("losses")
    )


def pie(df: DataFrame, keys: Sequence[str], label: str, value: str, least_pct: float = 2.5) -> DataFrame:
    """Shares of each section's total; slices under ``least_pct`` are folded into Other; the largest is flagged."""
    section = Window.partitionBy(*keys)
    share = F.col(value) / F.sum(value).over(section) * 100
    named = df.select(*keys, F.when(share < least_pct, "Other").otherwise(F.col(label)).alias("slice"), F.col(value).alias("v"))
    folded = named.groupBy(*keys, "slice").agg(F.sum("v").alias("total"))
    return folded.select(
        *keys, "slice", "total", (F.col("total") / F.sum("total").over(section) * 100).alias("share_pct"),
        (F.col("total") == F.max("total").over(section)).alias("largest"),
    )


