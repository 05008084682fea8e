"""Checks of market bars: a reason per row, a verdict per bar set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import basename, number, text

# Columns of a bar file.
COLUMNS = ("TimestampUTC", "Symbol", "Open", "High", "Low", "Close")
SYMBOL_CHARS = 64
FILE_FAULTS = ("EMPTY_FILE", "DECODE_ERROR", "CSV_PARSE_ERROR", "TOO_FEW_ROWS", "MISSING_REQUIRED_COLUMNS")
UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$"
OTHER_ZONE = r"[+-]\d{2}:\d{2}$"


def parse(raw: DataFrame) -> DataFrame:
    """(bar_set_id, ts, symbol, open, high, low, close, reason) of raw string bars.

    A file's ``fault``, if there is one, is the reason of its only row; a required
    column that ``raw`` lacks is a fault of all of it.
    """
    lacking = [c for c in COLUMNS if c not in raw.columns]
    if lacking:
        raw = raw.withColumns({c: F.lit(None).cast("string") for c in lacking})
    fault = F.lit("MISSING_REQUIRED_COLUMNS") if lacking else F.col("fault") if "fault" in raw.columns else F.lit(None).cast("string")
    stamp, symbol = F.trim("TimestampUTC"), text(F.col("Symbol"))
    ts = F.try_to_timestamp(F.replace(F.substring(stamp, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    prices = {c.lower(): number(F.col(c)) for c in COLUMNS[2:]}
    o, h, lo, c = prices.values()
    reason = (
        F.when(fault.isNotNull(), fault)
        .when(symbol.isNull(), "EMPTY_SYMBOL").when(F.char_length(symbol) > SYMBOL_CHARS, "SYMBOL_TOO_LONG")
        .when(stamp.isNull(), "INVALID_TIMESTAMP")
        .when(~stamp.rlike(UTC) & stamp.rlike(OTHER_ZONE) & ~stamp.endswith("+00:00"), "NON_UTC_TIMESTAMP")
        .when(~stamp.rlike(UTC), "INVALID_TIMESTAMP")
        .when(stamp.rlike(r"\.\d*[1-9]"), "TIMESTAMP_NOT_MINUTE_ALIGNED").when(ts.isNull(), "INVALID_TIMESTAMP")
        .when(F.second(ts) != 0, "TIMESTAMP_NOT_MINUTE_ALIGNED")
        .when(o.isNull() | h.isNull() | lo.isNull() | c.isNull(), "INVALID_OHLC")
        .when((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), "NON_POSITIVE_OHLC")
        .when((h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c)), "IMPOSSIBLE_OHLC")
    )
    return raw.select("bar_set_id", ts.alias("ts"), symbol.alias("symbol"), *(v.alias(k) for k, v in prices.items()), reason.alias("reason"))


def quality(bars: DataFrame) -> DataFrame:
    """Reasons of typed bars that cannot be: used where bars come from a table, not from text."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumn(
        "reason",
        F.when(o.isNull() | h.isNull() | lo.isNull() | c.isNull(), "INVALID_OHLC")
        .when((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), "NON_POSITIVE_OHLC")
        .when((h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c)), "IMPOSSIBLE_OHLC"),
    )


def duplicates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("bar_set_id", "symbol", "ts").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gaps(bars: DataFrame) -> DataFrame:
    """(bar_set_id, symbol, ts, gap_seconds): seconds since the bar before.

    A symbol's bars are cut by month; each month's first bar takes its
    predecessor from the last bar of the month before that has one.
    """
    month = F.date_format("ts", "yyyy-MM")
    rows = bars.select("bar_set_id", "symbol", "ts", month.alias("month"))
    inside = Window.partitionBy("bar_set_id", "symbol", "month").orderBy("ts")
    lasts = rows.groupBy("bar_set_id", "symbol", "month").agg(F.max("ts").alias("last"))
    before = Window.partitionBy("bar_set_id", "symbol").orderBy("month")
    carried = lasts.select("bar_set_id", "symbol", "month", F.lag("last").over(before).alias("carried"))
    placed = rows.withColumn("prev", F.lag("ts").over(inside)).join(carried, ["bar_set_id", "symbol", "month"])
    prev = F.coalesce("prev", "carried")
    return placed.select("bar_set_id", "symbol", "ts", F.timestamp_diff("SECOND", prev, F.col("ts")).alias("gap_seconds"))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("bar_set_id", "symbol").agg(F.min("ts").alias("first_bar"), F.max("ts").alias("last_bar"), F.count(F.lit(1)).alias("n_bars"))


def verdicts(checked: DataFrame, resolution_seconds: int = 60) -> DataFrame:
    """One row per bar set: OK or the first kind of fault, in order of the checks."""
    sets = checked.groupBy("bar_set_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("reason").alias("row_reason"))
    twice = duplicates(checked).groupBy("bar_set_id").agg(F.lit(True).alias("twice"))
    finest = gaps(checked).groupBy("bar_set_id", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("gap_seconds").alias("gap"))
    coarse = finest.groupBy("bar_set_id").agg(F.bool_or((F.col("n") < 2) | F.col("gap").isNull() | (F.col("gap") != resolution_seconds)).alias("coarse"))
    joined = sets.join(twice, "bar_set_id", "left").join(coarse, "bar_set_id", "left")
    verdict = (
        F.when(F.col("row_reason").isin(*FILE_FAULTS), F.col("row_reason")).when(F.col("n_rows") < 2, "TOO_FEW_ROWS").when(F.col("row_reason").isNotNull(), F.col("row_reason"))
        .when(F.coalesce("twice", F.lit(False)), "DUPLICATE_BAR").when(F.coalesce("coarse", F.lit(True)), "M1_RESOLUTION_UNCONFIRMED").otherwise("OK")
    )
    return joined.select("bar_set_id", "n_rows", verdict.alias("verdict"))


def clean_bars(checked: DataFrame, resolution_seconds: int = 60) -> DataFrame:
    """The bars of faultless sets only."""
    good = verdicts(checked, resolution_seconds).filter("verdict = 'OK'").select("bar_set_id")
    return checked.join(good, "bar_set_id", "left_semi").drop("reason")


def stored(bars: DataFrame, path: str) -> None:
    """Keep bars sorted by symbol and time."""
    bars.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode("overwrite").parquet(path)


def provenance(files: DataFrame, bars: DataFrame) -> DataFrame:
    """Per bar file: name, size, sha256, rows and symbols. ``files`` is a binaryFile table."""
    known = files.select(
        F.col("path").alias("bar_set_id"), basename(F.col("path")).alias("source"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256")
    )
    counts = coverage(bars).groupBy("bar_set_id").agg(
        F.sum("n_bars").alias("n_rows"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("first_bar").alias("first_bar"), F.max("last_bar").alias("last_bar")
    )
    return known.join(counts, "bar_set_id", "left")
