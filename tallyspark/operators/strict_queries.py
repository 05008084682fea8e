"""A closed catalogue of strict queries: one bad value in a used column gives no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import OPEN_COLUMNS, by_header, folded, name_by_header, number, number_class, offset_text, opened, own, own_any, quoted, text
from tallyspark.functions.digests import table_digest
from tallyspark.operators.exact_sum import exact_sums, two_places

# Query names, what each groups by and what it measures.
CATALOGUE = {
    "TRADE_COUNT": (None, "count"),
    "TRADE_COUNT_BY_DAY": ("day", "count"),
    "BUSIEST_TRADING_DAY": ("day", "most"),
    "PROFIT_BY_DAY": ("day", "profit"),
    "TRADE_COUNT_BY_SYMBOL": ("symbol", "count"),
    "MOST_TRADED_SYMBOL": ("symbol", "most"),
    "PROFIT_BY_SYMBOL": ("symbol", "profit"),
    "MONTHLY_PROFIT": ("month", "profit"),
}


@dataclass(frozen=True)
class StrictResult:
    """``rows`` per journal that is OK, and a ``status`` row for every journal."""

    rows: DataFrame
    status: DataFrame


def duplicate_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key: how many rows have a twin. Nulls equal nulls; rows shrink to hashes before the shuffle."""
    hashed = df.select(*keys, F.sha2(F.to_json(F.struct(*map(quoted, columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    counted = hashed.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def symbol_variants(df: DataFrame, keys: list[str], symbol: str = "Symbol") -> DataFrame:
    """Symbols that differ only by case or outer blanks: folded form and number of spellings."""
    spelled = df.filter(text(quoted(symbol)).isNotNull()).select(*keys, folded(F.trim(quoted(symbol))).alias("folded"), quoted(symbol).alias("spelling"))
    counts = spelled.distinct().groupBy(*keys, "folded").agg(F.count(F.lit(1)).alias("spellings"))
    return counts.filter("spellings >= 2")


def input_digest(df: DataFrame, columns: list[str], journal: str = "journal_id") -> DataFrame:
    """Digest of the used columns' values and the row count; no column means the count alone."""
    return table_digest(df, [journal], [quoted(c).cast("string") for c in columns] or [F.lit(1)], "input_sha256")


def run(df: DataFrame, query: str, journal: str = "journal_id", journals: DataFrame | None = None) -> StrictResult:
    """Execute one query of the catalogue on every journal at once, each by its own header.

    ``journals`` lists the journals handed in, such as an audit; one of them without any row is NO_DATA.
    """
    everyone = df.groupBy(journal).agg(F.count(F.lit(1)).alias("n_rows"))
    if query not in CATALOGUE:
        return StrictResult(df.select(journal).limit(0), everyone.select(journal, "n_rows", F.lit("UNSUPPORTED_QUERY").alias("status")))
    by, measure = CATALOGUE[query]
    dated, symbolled, valued = by in ("day", "month"), by == "symbol", measure == "profit"
    none = F.lit(None).cast("string")
    missing = F.lit(False)
    for used, has in ((dated, own_any(df, OPEN_COLUMNS)), (symbolled, own(df, "Symbol")), (valued, own(df, "Profit"))):
        missing |= ~has if used else F.lit(False)
    # A parsed column states no zone.
    zone = by_header(df, OPEN_COLUMNS, lambda value, kind: F.lit("naive") if kind.startswith("timestamp") else F.coalesce(offset_text(value), F.lit("naive")))
    symbol, profit = by_header(df, ["Symbol"]), by_header(df, ["Profit"])
    checked = df.withColumns(
        {
            "_missing": missing, "_date": name_by_header(df, OPEN_COLUMNS) if dated else none, "_day": opened(df) if dated else F.lit(None).cast("timestamp_ntz"),
            "_zone": zone if dated else none, "_symbol": symbol if symbolled else none, "_profit": number_class(profit) if valued else F.lit("ok"),
        }
    ).withColumns(
        {"_bad_date": F.col("_day").isNull() if dated else F.lit(False), "_bad_symbol": text(F.col("_symbol")).isNull() if symbolled else F.lit(False)}
    )
    day = F.col("_day")
    audit = checked.groupBy(journal).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_or("_missing").alias("missing"),
        F.max("_date").alias("date"),
        F.count_if("_bad_date").alias("bad_dates"),
        F.array_sort(F.collect_set(F.when(~F.col("_bad_date"), F.col("_zone")))).alias("zones"),
        F.count_if("_bad_symbol").alias("bad_symbols"),
        *(F.count_if(F.col("_profit") == k).alias(f"profit_{k}") for k in ("missing", "not_numeric", "non_finite")),
    )
    issue = lambda c, reason, column: F.when(F.col(c) > 0, F.struct(F.lit(reason).alias("reason"), column.alias("column"), F.col(c).alias("row_count")))
    issues = F.array_compact(
        F.array(
            issue("bad_dates", "DATE_UNPARSEABLE", F.coalesce("date", F.lit(""))), issue("bad_symbols", "SYMBOL_MISSING", F.lit("Symbol")),
            issue("profit_missing", "PROFIT_MISSING", F.lit("Profit")), issue("profit_not_numeric", "PROFIT_NOT_NUMERIC", F.lit("Profit")),
            issue("profit_non_finite", "PROFIT_NON_FINITE", F.lit("Profit")),
        )
    )
    status = (
        F.when(F.col("n_rows") == 0, "NO_DATA").when(F.col("missing"), "REQUIRED_COLUMN_MISSING").when(F.col("bad_dates") > 0, "INVALID_INPUT")
        .when(F.size("zones") > 1, "AMBIGUOUS_TIME_BASIS").when(F.size("issues") > 0, "INVALID_INPUT").otherwise("OK")
    )
    audit = audit.withColumn("issues", F.when(F.col("missing"), F.array_compact(F.array())).otherwise(issues)).withColumn("status", status)
    good = checked.join(audit.filter("status = 'OK'").select(journal), journal, "left_semi")  # the warnings below decide nothing
    extra = duplicate_rows(df, [journal], [c for c in df.columns if c not in (journal, "row_ord") and not c.startswith("_")])
    if "Symbol" in df.columns:
        spelled = symbol_variants(df, [journal]).groupBy(journal).agg(F.count(F.lit(1)).alias("variants"))
        extra = extra.join(spelled, journal, "left")
    else:
        extra = extra.withColumn("variants", F.lit(0))
    warned = F.array_sort(F.array_compact(F.array(F.when(F.col("duplicate_rows") > 0, "DUPLICATE_ROWS"), F.when(F.coalesce("variants", F.lit(0)) > 0, "SYMBOL_VARIANTS"))))
    audit = audit.join(extra, journal).select(
        journal, "n_rows", "status", "issues", warned.alias("warnings"), "duplicate_rows",
        F.when(F.try_element_at("zones", F.lit(1)) != "naive", F.try_element_at("zones", F.lit(1))).alias("recorded_offset"),
    )
    if journals is not None:
        empty = journals.select(journal).distinct().join(everyone, journal, "left_anti")
        kept = {"n_rows": F.lit(0).cast("long"), "status": F.lit("NO_DATA"), "duplicate_rows": F.lit(0).cast("long")}
        kinds = {f.name: f.dataType for f in audit.schema.fields}
        audit = audit.unionByName(empty.select(journal, *(kept.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in audit.columns if c != journal)))

    keyed = {
        None: lambda: good.withColumn("key", F.lit("ALL")),
        "day": lambda: good.withColumn("key", F.date_format(day, "yyyy-MM-dd")),
        "month": lambda: good.withColumn("key", F.date_format(day, "yyyy-MM")),
        "symbol": lambda: good.withColumn("key", F.col("_symbol")),
    }[by]()
    counts = keyed.groupBy(journal, "key")
    if measure == "profit":
        rows = exact_sums(keyed.select(journal, "key", number(by_header(df, ["Profit"])).alias("value")), [journal, "key"], "value", "value")
        rows = rows.withColumn("display", two_places("value"))
    else:
        rows = counts.agg(F.count(F.lit(1)).alias("value"))
        if measure == "most":
            rows = tied_most(rows, journal)
    return StrictResult(rows, audit)


def tied_most(counts: DataFrame, journal: str) -> DataFrame:
    """All rows with a journal's highest value, and whether there are several."""
    ranked = counts.withColumn("_rank", F.rank().over(Window.partitionBy(journal).orderBy(F.desc("value")))).filter("_rank = 1")
    return ranked.drop("_rank").withColumn("tie", F.count(F.lit(1)).over(Window.partitionBy(journal)) >= 2)


def canonical_json(rows: DataFrame, journal: str) -> DataFrame:
    """Each result row as JSON with its fields in name order."""
    names = sorted(c for c in rows.columns if c != journal)
    return rows.select(journal, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


def row_counts_hold(source: DataFrame, filtered: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Per journal: whether the filtered rows are no more than the source rows."""
    a = source.groupBy(journal).agg(F.count(F.lit(1)).alias("source_rows"))
    b = filtered.groupBy(journal).agg(F.count(F.lit(1)).alias("filtered_rows"))
    joined = a.join(b, journal, "full").na.fill(0, ["source_rows", "filtered_rows"])
    return joined.withColumn("holds", F.col("filtered_rows") <= F.col("source_rows"))
