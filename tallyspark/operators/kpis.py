"""The eighteen performance measures of a journal."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import folded
from tallyspark.operators import prefix_scan

# Measure names in their fixed order, with the column that holds each.
RENDERED = [
    ("Total Trades", "total_trades"), ("Winning Trades", "winning_trades"), ("Losing Trades", "losing_trades"),
    ("Break-even Trades", "breakeven_trades"), ("Win Rate (%)", "win_rate_pct"), ("Total Profit", "total_profit"),
    ("Average Profit", "average_profit"), ("Gross Profit", "gross_profit"), ("Gross Loss", "gross_loss"),
    ("Average Win", "average_win"), ("Average Loss", "average_loss"), ("Profit Factor", "profit_factor"),
    ("Expectancy", "expectancy"), ("Best Trade", "best_trade"), ("Worst Trade", "worst_trade"),
    ("Max Drawdown", "max_drawdown"), ("Sharpe", "sharpe"), ("Volatility", "volatility"),
]


def kpis(df: DataFrame, keys: Sequence[str], profit: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key with a numeric profit. Losses are below 0; break-evens count in the win rate.

    The drawdown comes from a scan over ranges of each key, the rest from one
    aggregation with partial sums, so a key with very many rows is no single task.
    """
    p = F.col(profit)
    rows = df.filter(p.isNotNull() & ~F.isnan(p)).select(*keys, p.cast("double").alias("p"), *(c for c in order_by if c not in keys))
    falls = prefix_scan.max_drawdown(rows, "p", order_by, keys)
    win, loss = F.when(F.col("p") > 0, F.col("p")), F.when(F.col("p") < 0, F.col("p"))
    zero = F.lit(0.0)
    base = rows.groupBy(*keys).agg(
        F.count("p").alias("total_trades"),
        F.count_if(F.col("p") > 0).alias("winning_trades"),
        F.count_if(F.col("p") < 0).alias("losing_trades"),
        F.count_if(F.col("p") == 0).alias("breakeven_trades"),
        F.sum("p").alias("total_profit"),
        F.avg("p").alias("average_profit"),
        F.coalesce(F.sum(win), zero).alias("gross_profit"),
        F.coalesce(F.abs(F.sum(loss)), zero).alias("gross_loss"),
        F.coalesce(F.avg(win), zero).alias("average_win"),
        F.coalesce(F.abs(F.avg(loss)), zero).alias("average_loss"),
        F.max("p").alias("best_trade"),
        F.min("p").alias("worst_trade"),
        F.coalesce(F.stddev_samp("p"), zero).alias("volatility"),
    )
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    base = base.join(falls.withColumnsRenamed({k: f"_{k}" for k in keys}), same).drop(*(f"_{k}" for k in keys))
    return base.withColumns(
        {
            "win_rate_pct": F.col("winning_trades") / F.col("total_trades") * 100,
            "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(
                F.col("gross_profit") > 0, F.lit(float("inf"))
            ),
            "expectancy": F.col("average_profit"),
            "sharpe": F.when(F.col("volatility") > 0, F.col("average_profit") / F.col("volatility")).otherwise(zero),
        }
    )


def _shown(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind in ("bigint", "int"):
        return value.cast("string")
    text = F.format_string("%.2f", value)
    if name == "profit_factor":
        return F.when(value.isNull(), "N/A").when(value == float("inf"), "∞").otherwise(text)
    return text


def rendered(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, position, metric, value): the measures as text to two places, in fixed order."""
    kinds = dict(wide.dtypes)
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(metric).alias("metric"), _shown(c, kinds[c]).alias("value"))
        for i, (metric, c) in enumerate(RENDERED)
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def search_rendered(long: DataFrame, query: object) -> DataFrame:
    """Measures whose name or value text contains the query."""
    wanted = "" if query is None else str(query).strip()
    return long.filter(folded(F.col("metric")).contains(folded(F.lit(wanted))) | folded(F.col("value")).contains(folded(F.lit(wanted)))) if wanted else long
