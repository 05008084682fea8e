"""Trade review: realised movement, sorting, paging and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import cleaning as C
from tallyspark.session import settled

DISAGREEMENT = 0.1
PAGE_ROWS = 10
PIPS, POINTS = "pips", "price pts"

# Sort keys, the columns each may stand for, and how each is compared.
SORT_KEYS = {
    "ticket": (("Ticket",), "number"), "open_time": (C.OPEN_COLUMNS, "date"), "close_time": (C.CLOSE_COLUMNS, "date"),
    "symbol": (("Symbol",), "text"), "side": (C.SIDE_COLUMNS, "text"), "volume": (("Volume", "Size"), "number"),
    "entry": (C.ENTRY_COLUMNS, "number"), "exit": (C.EXIT_COLUMNS, "number"), "profit": (("Profit",), "number"),
    "commission": (("Commission", "Commissions"), "number"), "swap": (("Swap",), "number"),
    "movement": (("movement_value",), "number"), "bar_evidence": (("excursion_status",), "text"),
    "interval_high": (("excursion_interval_high",), "number"), "interval_low": (("excursion_interval_low",), "number"),
    "mfe": (("excursion_mfe",), "number"), "mae": (("excursion_mae",), "number"),
}
# Labels of evidence states.
STATUS_LABELS = {
    "COMPUTED": "Computed", "NO_MARKET_DATA": "No market data", "INCOMPLETE_COVERAGE": "Incomplete coverage",
    "INVALID_TRADE_DATA": "Invalid trade data", "AMBIGUOUS_LOCAL_TIME": "Ambiguous local time",
    "NONEXISTENT_LOCAL_TIME": "Nonexistent local time", "TIME_BASIS_INCONSISTENT": "Time basis inconsistent",
    "INVARIANT_VIOLATION": "Evidence unavailable", "JOIN_KEY_UNAVAILABLE": "Join key unavailable",
    "TIME_BASIS_UNDECLARED": "Time basis undeclared", "NO_M1_EVIDENCE": "No M1 evidence",
}


def calculated_movement(side: Column, entry: Column, exit_price: Column) -> Column:
    move = C.number(exit_price) - C.number(entry)
    return F.when(C.side(side) == "buy", move).when(C.side(side) == "sell", -move)


def _movement(told: Column, own: Column) -> dict[str, Column]:
    apart = F.coalesce(F.abs(told - own) > DISAGREEMENT, F.lit(False))
    some = F.when(told.isNotNull(), "BROKER").when(own.isNotNull(), "CALCULATED")
    return {
        "value": F.coalesce(told, own), "label": F.when(told.isNotNull(), PIPS).when(own.isNotNull(), POINTS), "calculated": own,
        "source": F.coalesce(some, F.lit("UNAVAILABLE")), "disagreement": apart,
        "status": F.when(apart, "DISAGREEMENT").when(some.isNotNull(), "OK").otherwise("UNAVAILABLE"),
    }


def movement(pips: Column, side: Column, entry: Column, exit_price: Column) -> Column:
    """struct: value, label, calculated, source, disagreement, status; broker pips win if finite."""
    found = _movement(C.number(pips), calculated_movement(side, entry, exit_price))
    return F.struct(*(v.alias(k) for k, v in found.items()))


def enrich(df: DataFrame) -> DataFrame:
    """Six movement columns beside each trade, from the columns of its own journal's header."""
    cell = lambda names: C.by_header(df, names)
    told, own = C.number(cell(("Pips",))), calculated_movement(cell(C.SIDE_COLUMNS), cell(C.ENTRY_COLUMNS), cell(C.EXIT_COLUMNS))
    joined = df.withColumns({"_told": told, "_own": own})
    found = _movement(F.col("_told"), F.col("_own"))
    return joined.withColumns({f"movement_{k}": v for k, v in found.items()}).drop("_told", "_own")


def sort_values(df: DataFrame, key: str, order_by: str = "row_ord") -> list[Column]:
    """What rows are compared by: the sorted column of each journal's own header, the numeric ticket, the input order.

    Blank and nan-like text is null. A journal without such a column stays in input order.
    """
    names, kind = SORT_KEYS.get(key, ((), ""))
    if not any(c in df.columns for c in names):
        return [F.col(order_by)]
    has = C.own_any(df, names)
    ties = [F.when(has, C.number(C.by_header(df, C.TICKET_COLUMNS)))] if "Ticket" in df.columns else []
    if kind == "number":
        value = C.number(C.by_header(df, names))
    elif kind == "date":
        value = C.opened(df, names)
    else:
        lower = C.folded(C.text(C.by_header(df, names)))
        value = F.when(~lower.isin("nan", "none", "nat", "<na>"), lower)
    return [value, *ties, F.col(order_by)]


def directions(values: Sequence[Column], descending: bool) -> list[Column]:
    """Nulls last either way; only the first value descends."""
    first, *ties = [v.asc_nulls_last() for v in values]
    return [values[0].desc_nulls_last() if descending and ties else first, *ties]


def sort_order(df: DataFrame, key: str, descending: bool = False, order_by: str = "row_ord") -> list[Column]:
    """Nulls (blank and nan-like text too) last either way; ties by numeric ticket, then input order."""
    return directions(sort_values(df, key, order_by), descending)


#: Places up to which each task keeps the first rows of a journal by itself; deeper pages are looked up by counted ranges.
DEEP = 1000


def page(df: DataFrame, key: str, descending: bool = False, number: int = 1, rows: int = PAGE_ROWS, partitions: int | None = None) -> DataFrame:
    """One page of each journal, with each row's place in the sorted journal.

    Spark keeps the first rows of each journal in every task where the last place is
    ``DEEP`` or less. For a deeper page the rows' values are dealt by ranges of (journal,
    values) and counted per range; only the ranges that hold the page are ordered, each by a
    task of its own, so no task sorts a journal. A row's (journal_id, row_ord) is its own.
    """
    lo, hi = (number - 1) * rows + 1, number * rows
    if hi <= DEEP:
        place = F.row_number().over(Window.partitionBy("journal_id").orderBy(*sort_order(df, key, descending)))
        return df.withColumn("place", place).filter(F.col("place").between(lo, hi))
    values = sort_values(df, key)
    names = [f"_v{i}" for i in range(len(values))]
    narrow = df.select("journal_id", F.col("row_ord").alias("_row"), *(v.alias(n) for v, n in zip(values, names, strict=True)))
    order = directions([F.col(n) for n in names], descending)
    ranges = [F.col("journal_id").asc(), *order]
    dealt = narrow.repartitionByRange(partitions, *ranges) if partitions else narrow.repartitionByRange(*ranges)
    # Written, so that the ranges are drawn once.
    dealt = settled(dealt.withColumn("_part", F.spark_partition_id()))
    counted = dealt.groupBy("journal_id", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("journal_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per journal and range
    counted = counted.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    wanted = counted.filter((F.col("_first") < hi) & (F.col("_first") + F.col("_rows") >= lo)).drop("_rows")
    inside = Window.partitionBy("journal_id", "_part").orderBy(*order)
    placed = dealt.join(wanted, ["journal_id", "_part"]).withColumn("place", (F.col("_first") + F.row_number().over(inside)).cast("int"))
    found = placed.filter(F.col("place").between(lo, hi)).select("journal_id", F.col("_row").alias("row_ord"), "place")
    return df.join(found, ["journal_id", "row_ord"])


def first_page(df: DataFrame, key: str, descending: bool = False, rows: int = PAGE_ROWS) -> DataFrame:
    """The first page over all journals: no full sort is needed."""
    return df.orderBy(*sort_order(df, key, descending), "journal_id").limit(rows)


def _stripped(decimal_text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(decimal_text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def volume_text(value: Column) -> Column:
    """Two places, half up, trailing zeros gone; what rounds to 0 is <0.01 or >-0.01."""
    exact = F.when(C.number(value).isNotNull(), C.text(value).try_cast("decimal(38,18)"))
    rounded = F.round(exact, 2).cast("decimal(38,2)")
    return F.coalesce(
        F.when(exact == 0, "0").when((rounded == 0) & (exact > 0), "<0.01").when((rounded == 0) & (exact < 0), ">-0.01")
        .otherwise(_stripped(rounded.cast("string"))),
        F.lit(""),
    )


def signed_text(value: Column) -> Column:
    number = C.number(value)
    size = _stripped(F.format_string("%.2f", F.abs(number)))
    return F.coalesce(F.when(number == 0, "0").when(number > 0, F.concat(F.lit("+"), size)).when(number < 0, F.concat(F.lit("-"), size)), F.lit(""))


def movement_text(value: Column, label: Column) -> Column:
    shown = signed_text(value)
    return F.when(shown == "", "").otherwise(F.concat_ws(" ", shown, F.when(label == PIPS, PIPS).otherwise(POINTS)))


def calculated_note(value: Column) -> Column:
    shown = signed_text(value)
    return F.when(shown == "", "").otherwise(F.concat(F.lit("Calculated move: "), shown, F.lit(f" {POINTS}")))


def evidence_text(value: Column) -> Column:
    """At most twelve places, no exponent, no trailing zeros."""
    plain = F.round(C.number(value), 12).cast("decimal(38,12)").cast("string")
    shown = _stripped(plain)
    return F.coalesce(F.when(shown.isin("-0", "", "-"), "0").otherwise(shown), F.lit(""))


def status_label(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), status, F.lit(""))


def notes(prefix: str = "excursion_") -> Column:
    said = {
        "Entry outside first M1 bar range": F.col(f"{prefix}entry_outside_first_bar_range"),
        "Exit outside last M1 bar range": F.col(f"{prefix}exit_outside_last_bar_range"),
        "Realised move outside M1 envelope": F.col(f"{prefix}realised_outside_interval"),
    }
    boundary = F.col(f"{prefix}high_from_boundary_bar") | F.col(f"{prefix}low_from_boundary_bar")
    texts = [F.when(boundary, "Boundary extreme"), *(F.when(v, k) for k, v in said.items())]
    return F.when(F.col(f"{prefix}status") == "COMPUTED", F.array_join(F.array_compact(F.array(*texts)), "; ")).otherwise("")


def review_columns(df: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """(key, the columns it may stand for) of what a review of some journal of the table shows, in order."""
    return [(k, names) for k, (names, _) in SORT_KEYS.items() if any(c in df.columns for c in names)]


def review_rows(df: DataFrame, bound: bool = True) -> DataFrame:
    """One display cell (value, note, flag) per review column; null shows as blank, a column that the row's journal lacks is null."""
    cells: list[Column] = []
    for key, names in review_columns(df):
        cell, note, flag = C.by_header(df, names), F.lit(""), F.lit("")
        if key == "movement":
            value, note = movement_text(cell, F.col("movement_label")), F.when(F.col("movement_disagreement"), calculated_note(F.col("movement_calculated"))).otherwise("")
            flag = F.when(F.col("movement_disagreement"), "Mismatch").otherwise("")
        elif key == "volume":
            value = volume_text(cell)
        elif key == "bar_evidence":
            value = status_label(cell) if bound else F.lit("No M1 evidence")
            note, flag = (F.coalesce(F.col("excursion_reason"), F.lit("")), notes()) if bound else (note, flag)
        elif key in ("interval_high", "interval_low", "mfe", "mae"):
            value = evidence_text(cell)
        else:
            shown = lambda v, kind: F.date_format(v, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else v.cast("string")
            value = F.coalesce(C.by_header(df, names, shown), F.lit(""))
        shown_cell = F.struct(value.alias("value"), note.alias("note"), flag.alias("flag"))
        cells.append((F.when(C.own_any(df, names), shown_cell) if C.HEADER in df.columns else shown_cell).alias(key))
    return df.select("journal_id", "row_ord", *cells)


def shown_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    known = dict(review_columns(df))
    return [next(c for c in known[k] if c in df.columns) for k in wanted if k in known]
