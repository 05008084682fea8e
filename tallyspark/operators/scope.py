"""Analysis scope: filters with row lineage."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import HEADER, OPEN_COLUMNS, folded, number, opened, own, own_any, quoted

# The columns that a search looks into.
SEARCH_TEXT = ("Symbol", "Type", "Side", "Tag", "Tags", "Notes", "Comment", "Comments", "Strategy", "Reason")
SEARCH_NUMBERS = ("Profit", "Commission", "Swap", "Balance", "Pips", "Size", "Volume")


def clean(value: object) -> str:
    return "" if value is None else str(value).strip()


def _date(value: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(value)
    except ValueError:
        return None


def _any(found: list[Column]) -> Column:
    return functools.reduce(operator.or_, found) if found else F.lit(False)


def search(df: DataFrame, query: str) -> Column:
    """Literal match, case folded, in text, numbers (8 places) or dates; null never matches.

    Text is looked for in the named columns that the row's own journal has, or else in all its text.
    """
    kinds = dict(df.dtypes)
    listed = [c for c in SEARCH_TEXT if c in kinds]
    others = [c for c, k in kinds.items() if k == "string" and c != "journal_id"]
    within = lambda columns: _any([F.coalesce(folded(quoted(c).cast("string")).contains(folded(F.lit(query))), F.lit(False)) for c in columns])
    found = [F.when(own_any(df, listed), within(listed)).otherwise(within(others)) if HEADER in kinds else within(listed or others)]
    try:
        wanted = float(query.replace(",", ""))
        found += [F.round(number(quoted(c)), 8) == round(wanted, 8) for c in SEARCH_NUMBERS if c in kinds]
    except ValueError:
        pass
    dates = [quoted(c) for c, kind in kinds.items() if kind.startswith("timestamp") or kind == "date"]
    dates += [opened(df)] if HEADER in kinds else []
    found += [F.date_format(c, form).contains(query) for c in dates for form in ("yyyy-MM-dd", "yyyy-MM")]
    return F.coalesce(_any([F.coalesce(f, F.lit(False)) for f in found]), F.lit(False))


def predicate(df: DataFrame, params: Mapping[str, object]) -> tuple[Column, dict[str, tuple[Column, str]]]:
    """The scope's predicate, and per filter whether it is active in the row's journal and its value.

    A filter is active where the row's own journal has the column that it needs.
    """
    keep, active = F.lit(True), {}
    dated = own_any(df, OPEN_COLUMNS)
    for key, compare in (("start_date", operator.ge), ("end_date", operator.le)):
        bound = _date(clean(params.get(key)))
        if bound:
            keep &= ~dated | F.coalesce(compare(F.to_date(opened(df)), F.lit(bound)), F.lit(False))
            active[key] = (dated, bound.isoformat())
    wanted = clean(params.get("symbol"))
    if wanted and "Symbol" in df.columns:
        keep &= ~own(df, "Symbol") | F.coalesce(folded(F.col("Symbol").cast("string")).contains(folded(F.lit(wanted))), F.lit(False))
        active["symbol"] = (own(df, "Symbol"), wanted)
    query = clean(params.get("q"))
    if query:
        keep &= search(df, query)
        active["q"] = (F.lit(True), query)
    return keep, active


def apply_scope(df: DataFrame, params: Mapping[str, object]) -> DataFrame:
    return df.filter(predicate(df, params)[0])


def lineage(df: DataFrame, params: Mapping[str, object], journal: str = "journal_id") -> DataFrame:
    """Per journal: source rows, analysed rows, the filters active in it, and whether nothing is left."""
    keep, active = predicate(df, params)
    pairs = F.array_compact(F.array(*(F.when(F.bool_or(on), F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, (on, v) in active.items())))
    filters = F.map_from_entries(pairs) if active else F.expr("map()").cast("map<string,string>")
    counted = df.groupBy(journal).agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(keep).alias("analysed_rows"), filters.alias("active_filters"))
    return counted.withColumn("zero_result", F.col("analysed_rows") == 0)


def select_raw(df: DataFrame, symbol: object) -> DataFrame:
    """The rows of a symbol scope as they are, without any parsing."""
    wanted = clean(symbol)
    return df.filter(folded(F.col("Symbol").cast("string")).contains(folded(F.lit(wanted)))) if wanted and "Symbol" in df.columns else df
