"""Cleaning of journal cells, as column expressions that never raise."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names in order of preference.
OPEN_COLUMNS = ("Open Time", "Open", "Date")
CLOSE_COLUMNS = ("Close Time", "Close")
SYMBOL_COLUMNS = ("Symbol",)
SIDE_COLUMNS = ("Type", "Side")
ENTRY_COLUMNS = ("Entry", "Price", "Open Price", "Entry Price")
EXIT_COLUMNS = ("Exit", "Price.1", "Close Price", "Exit Price")
TICKET_COLUMNS = ("Ticket",)
DURATION_COLUMNS = ("Trade duration in seconds",)
RR_COLUMNS = ("RR", "rr", "R:R", "risk_reward", "Risk Reward")
NUMERIC_COLUMNS = ("Size", "Profit", "Commission", "Commissions", "Swap", "Balance", "Pips", "Volume")

#: A finite decimal number in the forms that journals use.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
NON_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"
#: A time zone at the end of a date and time.
OFFSET = r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})\s*$"

#: An ISO date, with or without a time, and without a zone.
ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
# Shapes of dates by the form that a column has, in the order tried where no column decides, each with its parts put in ISO order.
CLOCK = r"( \d{2}:\d{2}(?::\d{2})?)"
DATE_SHAPES = {
    "dotted": (rf"^(\d{{4}})\.(\d{{2}})\.(\d{{2}}){CLOCK}$", "$1-$2-$3$4"),
    "named": (rf"^\d{{1,2}} [A-Za-z]{{3}} \d{{4}}{CLOCK}?$", None),
    "day_first": (rf"^(\d{{2}})/(\d{{2}})/(\d{{4}}){CLOCK}?$", "$3-$2-$1$4"),
    "month_first": (rf"^(\d{{2}})/(\d{{2}})/(\d{{4}}){CLOCK}?$", "$3-$1-$2$4"),
}
NAMED_FORMATS = ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy")
FORMS = ("iso", *DATE_SHAPES)

#: Columns of tables that hold journals of different headers: each row's own header, and the form of its dates by column.
HEADER, DATE_FORM = "_header", "_date_form"
#: What the names of columns begin with that this library adds to every journal.
ADDED = ("movement_", "excursion_")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def first_present(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The first wanted name among the columns: a name is chosen, never values merged."""
    return next((c for c in wanted if c in columns), None)


def own(df: DataFrame, name: str) -> Column:
    """Whether the row's own journal has the column."""
    if name not in df.columns:
        return F.lit(False)
    return F.array_contains(HEADER, name) if HEADER in df.columns and not name.startswith(ADDED) else F.lit(True)


def own_any(df: DataFrame, wanted: Sequence[str]) -> Column:
    """Whether the row's own journal has one of the columns."""
    present = [c for c in wanted if c in df.columns]
    if HEADER not in df.columns or not present or any(c.startswith(ADDED) for c in present):
        return F.lit(bool(present))
    return F.arrays_overlap(F.col(HEADER), F.array(*map(F.lit, present)))


def by_header(df: DataFrame, wanted: Sequence[str], cell: Callable[[Column, str], Column] | None = None) -> Column:
    """The cell of the first wanted column that the row's own journal has, as text or by ``cell`` (value, kind); null if it has none.

    A column is chosen by the header, never by what its cells hold. A table without
    ``HEADER`` has one header, its columns.
    """
    kinds = dict(df.dtypes)
    cell = cell or (lambda value, kind: value.cast("string"))
    present = [c for c in wanted if c in kinds]
    if HEADER not in kinds:
        return cell(quoted(present[0]), kinds[present[0]]) if present else cell(F.lit(None).cast("string"), "string")
    out = F.lit(None)
    for c in reversed(present):
        out = F.when(own(df, c), cell(quoted(c), kinds[c])).otherwise(out)
    return out if present else cell(F.lit(None).cast("string"), "string")


def name_by_header(df: DataFrame, wanted: Sequence[str]) -> Column:
    """The name of the column that ``by_header`` takes."""
    present = [c for c in wanted if c in df.columns]
    if HEADER not in df.columns:
        present = present[:1]
    return F.coalesce(*(F.when(own(df, c), c) for c in present), F.lit(None).cast("string"))


def form_by_header(df: DataFrame, wanted: Sequence[str]) -> Column:
    """The form of the dates in the column that ``by_header`` takes; null if it is not known."""
    return F.try_element_at(F.col(DATE_FORM), name_by_header(df, wanted)) if DATE_FORM in df.columns else F.lit(None).cast("string")


def opened(df: DataFrame, wanted: Sequence[str] = OPEN_COLUMNS) -> Column:
    """The recorded wall clock in the journal's own date column, by the column's form."""
    form = form_by_header(df, wanted) if DATE_FORM in df.columns else None
    return by_header(df, wanted, lambda value, kind: value if kind.startswith("timestamp") else recorded_time(value, form))


def text(value: Column) -> Column:
    """The trimmed text of a cell, null if blank."""
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed != "", trimmed)


def folded(value: Column) -> Column:
    """Text with case folded in full, as ``str.casefold`` does: ß is ss, final and other sigmas are one, the dotless i stays.

    Upper and then lower case unfold what is longer in capitals; the dotless i would become a plain one on the way, so it waits aside.
    """
    capitals = F.replace(F.upper(F.translate(value, "\u0131", "\ue000")), F.lit("\u1e9e"), F.lit("SS"))
    return F.translate(F.lower(capitals), "\u03c2\ue000", "\u03c3\u0131")


def number(value: Column) -> Column:
    """The finite number in a cell, else null."""
    cell = text(value)
    found = F.when(cell.rlike(NUMBER), cell.try_cast("double"))
    return F.when(F.abs(found) < float("inf"), found)


def number_class(value: Column) -> Column:
    """missing, not_numeric, non_finite or ok."""
    cell = text(value)
    return (
        F.when(cell.isNull() | F.lower(cell).isin("nan", "none", "<na>"), "missing")
        .when(cell.rlike(NON_FINITE), "non_finite")
        .when(~cell.rlike(NUMBER), "not_numeric")
        .when(number(value).isNull(), "non_finite")
        .otherwise("ok")
    )


def forms_read(value: Column) -> dict[str, Column]:
    """What each form reads in a cell without a zone; null where it does not read it."""
    cell = text(value)
    found = {"iso": F.when(cell.rlike(ISO), cell.try_cast("timestamp_ntz"))}
    for form, (shape, iso) in DATE_SHAPES.items():
        if iso:
            read = F.regexp_replace(cell, shape, iso).try_cast("timestamp_ntz")
        else:
            read = F.coalesce(*(F.try_to_timestamp(cell, F.lit(fmt)).cast("timestamp_ntz") for fmt in NAMED_FORMATS))
        found[form] = F.when(cell.rlike(shape), read)
    return found


def local_time(value: Column, form: Column | None = None) -> Column:
    """The recorded wall clock of a cell without a zone, by its column's form; where that is not known by the first form that fits.

    Canonical text (ISO) is read whatever the form, as columns read before hold it.
    """
    read = forms_read(value)
    if form is None:
        return F.coalesce(*read.values())
    return F.coalesce(read["iso"], *(F.when(form.isNull() | (form == k), read[k]) for k in DATE_SHAPES))


def time_class(value: Column, local: Column | None = None) -> Column:
    """blank, aware (it states a zone), ok or invalid; ``local`` is what was read from the cell, if that has been done."""
    cell = text(value)
    local = local_time(value) if local is None else local
    return (
        F.when(cell.isNull(), "blank").when(cell.rlike(OFFSET), "aware")
        .when(local.isNotNull(), "ok").otherwise("invalid")
    )


def offset_text(value: Column) -> Column:
    """The zone that a cell states, as +hh:mm; null if none."""
    zone = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), OFFSET, 1)
    plain = F.regexp_replace(zone, ":", "")
    return F.when(F.lower(zone) == "z", "+00:00").when(zone != "", F.concat(plain.substr(1, 3), F.lit(":"), plain.substr(4, 2)))


def without_zone(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\s*(Z|z|[+-]\d{2}:?\d{2})\s*$", "")


def recorded_time(value: Column, form: Column | None = None) -> Column:
    """The wall clock of a cell as written, its zone left aside."""
    return local_time(without_zone(value), form).cast("timestamp_ntz")


def ticket(value: Column) -> Column:
    """123, 123.0 and '123.00' are '123'; other text keeps its case; blank or non-finite is null."""
    cell = text(value)
    whole = F.regexp_extract(cell, r"^([+-]?\d+)(?:\.0*)?$", 1)
    exponent = F.when(cell.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$"), cell.try_cast("decimal(38,10)"))
    as_whole = F.when(exponent == F.floor(exponent), F.floor(exponent).cast("string"))
    digits = whole.try_cast("decimal(38,0)").cast("string")
    return (
        F.when(cell.rlike(NON_FINITE) | F.lower(cell).isin("none", "<na>", "nat"), None)
        .when(whole != "", F.coalesce(digits, cell))
        .when(as_whole.isNotNull(), as_whole)
        .otherwise(cell)
    )


def side(value: Column) -> Column:
    cell = F.lower(text(value))
    return F.when(cell.isin("buy", "long"), "buy").when(cell.isin("sell", "short"), "sell")


def symbol(value: Column) -> Column:
    """Trimmed, blank is null, case kept."""
    return text(value)


def price(value: Column) -> Column:
    """A positive finite price, else null."""
    found = number(value)
    return F.when(found > 0, found)


def price_reason(value: Column, name: str) -> Column:
    return F.when(number(value) <= 0, f"NON_POSITIVE_{name}").when(number(value).isNull(), f"INVALID_{name}")


def duration_class(value: Column) -> Column:
    """skip (blank), ok or invalid (negative, not finite, text)."""
    cell = text(value)
    return F.when(cell.isNull() | F.lower(cell).isin("nan", "none"), "skip").when(number(value) >= 0, "ok").otherwise("invalid")


def basename(path: Column) -> Column:
    """The last part of a Windows or POSIX path."""
    name = F.trim(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    return F.when(name != "", name)


#: Names of columns that an export adds to count its rows.
INDEX_COLUMN = r"Unnamed: \d+|_c\d+"


def is_trade_like(df: DataFrame) -> bool:
    return "Profit" in df.columns or {"Symbol", "Type"} <= set(df.columns)


def normalise(df: DataFrame, key_columns: Sequence[str] = ("journal_id", "row_ord", HEADER, DATE_FORM), read: bool = False) -> DataFrame:
    """Trim header names, drop index columns and empty rows, rename, parse dates and numbers.

    ``key_columns`` are not journal data: an all-empty row is dropped whatever its keys. Where the caller has
    ``read`` the files, it has dropped empty rows and parsed dates.
    """
    names = [c if c in key_columns else c.strip() for c in df.columns]
    df = df.toDF(*names)
    df = df.drop(*[c for c in names if re.fullmatch(INDEX_COLUMN, c)])
    data = [c for c in df.columns if c not in key_columns]
    df = df.filter(F.coalesce(*(text(quoted(c)) for c in data)).isNotNull()) if data and not read else df
    if "Commissions" in data and "Commission" not in data:
        df = df.withColumnRenamed("Commissions", "Commission")
    date = first_present(df.columns, OPEN_COLUMNS)
    changed = {c: number(quoted(c)) for c in df.columns if c in NUMERIC_COLUMNS}
    if date and not read:
        changed[date] = recorded_time(quoted(date))
    return df.withColumns(changed) if changed else df


def contract(df: DataFrame, journal: str = "journal_id") -> DataFrame:
    """One status per journal: OK, EMPTY_DATASET, MISSING_PROFIT (by its own header) or NO_PARSABLE_PROFIT."""
    profit = number(quoted("Profit")) if "Profit" in df.columns else F.lit(None)
    counts = df.groupBy(journal).agg(F.count(F.lit(1)).alias("n_rows"), F.count(profit).alias("n_profits"), F.bool_or(own(df, "Profit")).alias("has"))
    status = (
        F.when(F.col("n_rows") == 0, "EMPTY_DATASET").when(~F.col("has"), "MISSING_PROFIT")
        .when(F.col("n_profits") == 0, "NO_PARSABLE_PROFIT").otherwise("OK")
    )
    return counts.select(journal, "n_rows", status.alias("status"))
