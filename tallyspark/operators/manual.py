"""Measures of manually kept trades, and position sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import folded
from tallyspark.operators.scope import clean


def risk_reward() -> Column:
    """Reward over risk by side to two places; null without stops or where a stop is on the wrong side."""
    long = F.col("side") == "LONG"
    risk = F.when(long, F.col("entry_price") - F.col("stop_loss")).otherwise(F.col("stop_loss") - F.col("entry_price"))
    reward = F.when(long, F.col("take_profit") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("take_profit"))
    usable = (F.col("stop_loss") != 0) & (F.col("take_profit") != 0) & (risk > 0)
    return F.when(usable, F.bround(reward.cast("double") / risk.cast("double"), 2))


def realised_pnl() -> Column:
    """Closed trades only: signed move times quantity less fees."""
    move = F.when(F.col("side") == "LONG", F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price"))
    closed = (F.col("status") == "CLOSED") & F.col("exit_price").isNotNull()
    return F.when(closed, (move * F.col("quantity") - F.coalesce("fees", F.lit(0))).cast("decimal(20,8)"))


def duration_minutes() -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.col("open_time"), F.col("close_time")) / 60)


def rr_band(rr: Column) -> Column:
    return (
        F.when(rr <= 0, "Invalid").when(rr < 0.5, "Poor").when(rr < 1, "Below average").when(rr < 2, "Fair").when(rr < 3, "Good")
        .when(rr.isNotNull(), "Strong")
    )


def measures(trades: DataFrame) -> DataFrame:
    out = trades.withColumns({"rr": risk_reward(), "realized_pnl": realised_pnl(), "duration_minutes": duration_minutes()})
    return out.withColumn("rr_band", rr_band(F.col("rr")))


def filtered(trades: DataFrame, symbol: object = None, side: object = None, status: object = None, q: object = None) -> DataFrame:
    """Symbol contains, side and status equal, q in any of five columns; newest first."""
    low = lambda c: folded(F.col(c))
    if clean(symbol):
        trades = trades.filter(low("symbol").contains(folded(F.lit(clean(symbol)))))
    for name, value in (("side", side), ("status", status)):
        if clean(value):
            trades = trades.filter(F.col(name) == clean(value))
    if clean(q):
        hit = F.lit(False)
        for c in ("symbol", "tag", "notes", "status", "side"):
            hit |= F.coalesce(low(c).contains(folded(F.lit(clean(q)))), F.lit(False))
        trades = trades.filter(hit)
    return trades.orderBy(F.desc("open_time"))


def position_size(strategies: DataFrame) -> DataFrame:
    """Scaled Kelly fraction and lot size per strategy row; null measures where an input is out of range.

    Inputs: balance, win_rate (percent), rr, atr_pips, atr_mult, kelly_scale, max_risk_pct, pip_value, floor_pct.
    """
    c = F.col
    w = c("win_rate") / 100
    usable = (c("balance") > 0) & (w > 0) & (w < 1) & (c("rr") > 0) & (c("atr_pips") > 0) & (c("atr_mult") > 0) & (c("pip_value") > 0)
    kelly = w - (1 - w) / c("rr")
    kelly = F.when(kelly < 0, c("floor_pct") / 100).otherwise(kelly)
    rows = strategies.withColumns({"_k": F.when(usable, kelly), "_stop": F.when(usable, c("atr_pips") * c("atr_mult"))})
    rows = rows.withColumn("_pct", F.when(usable, F.greatest(c("floor_pct"), F.least(c("_k") * c("kelly_scale") * 100, c("max_risk_pct")))))
    amount = c("balance") * c("_pct") / 100
    lot = amount / (c("_stop") * c("pip_value"))
    return rows.withColumns(
        {
            "raw_kelly_pct": F.round(c("_k") * 100, 3), "risk_pct": F.round("_pct", 3), "risk_amount": F.round(amount, 2),
            "stop_pips": F.round("_stop", 2), "lot": F.when(lot != 0, F.round(lot, 2)),
        }
    ).drop("_k", "_stop", "_pct")
