"""Journal and bar files in, cleaned tables and exports out."""

from __future__ import annotations

import csv
import functools
import io
import itertools
import operator
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.cleaning import (
    CLOSE_COLUMNS, DATE_FORM, FORMS, HEADER, INDEX_COLUMN, OPEN_COLUMNS, RR_COLUMNS, basename, by_header, contract, folded, forms_read, normalise, number, own, quoted,
    recorded_time, text, without_zone,
)
from tallyspark.session import settled
from tallyspark.sources.csv_text import DELIMITERS, decoded, delimiter, header_names, records
from tallyspark.sources.ranges import range_cells

# The columns of a bar file.
BAR_COLUMNS = ("TimestampUTC", "Symbol", "Open", "High", "Low", "Close")
#: Rows that leave a file's reader together.
BATCH_ROWS = 10_000

JOURNAL_ROWS = "journal_id string, row_ord long, cells map<string,string>, fault string"
BAR_ROWS = "bar_set_id string, fault string, " + ", ".join(f"{c} string" for c in BAR_COLUMNS)


def journal_lines(content: bytes) -> Iterator[tuple[int | None, list[tuple[str, str]], str | None]]:
    """(place, cells, fault) of a journal file's data rows; a quoted field may hold line breaks.

    Rows with more fields than the header are left out, short ones lack their last
    cells, blank lines are no rows. What is no CSV, or ends inside quotes, ends with a row of
    the fault UNREADABLE_FILE, which goes for the whole file.
    """
    text = decoded(content)
    names: list[str] = []
    place = 0
    try:
        for fields, whole in records(text, delimiter(text)):
            if not whole:
                raise csv.Error("the file ends inside quotes")
            if not fields:
                continue
            if not names:
                names = header_names(fields)
            elif len(fields) <= len(names):
                yield place, [*zip(names, fields, strict=False), *((n, None) for n in names[len(fields) :])], None
                place += 1
    except csv.Error:
        yield None, [], "UNREADABLE_FILE"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(journal_id) of every file below ``path``, empty ones too, of which Spark's readers give no row; a name per file, as Spark itself lists them."""
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in _files(spark, path).inputFiles()]  # as Spark writes paths in rows
    return spark.createDataFrame(names, "journal_id string")


def _parsed(files: DataFrame, read: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``read`` gives for each file, in batches; a file is read by one task, which a quoted line break demands."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = read(path, content.as_py())
                while chunk := list(itertools.islice(rows, BATCH_ROWS)):
                    kinds = [pa.map_(pa.string(), pa.string()) if n == "cells" else pa.int64() if n == "row_ord" else pa.string() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk, strict=True), kinds, strict=True)], names)

    return files.filter(F.lower("path").endswith(".csv")).select("path", "content").mapInArrow(run, schema)


#: Bytes from which on a journal file is read in ranges, by many tasks; a smaller one is read whole by one.
LARGE_FILE = 64 << 20


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(journal_id, row_ord, cells, fault) of all CSV files below ``path``: the file, the row's place in it, name -> text.

    The names of large files, as many at most as the data have ``LARGE_FILE`` bytes, reach the driver.
    """
    files = _files(spark, path).filter(F.lower("path").endswith(".csv"))
    large = {r[0]: r[1] for r in files.filter(F.col("length") > LARGE_FILE).select("path", "length").collect()}
    small = _parsed(files.filter(F.col("length") <= LARGE_FILE), lambda p, content: ((p, *row) for row in journal_lines(content)), JOURNAL_ROWS)
    return small.unionByName(range_cells(spark, large, DELIMITERS)) if large else small


def date_forms(cells: DataFrame) -> DataFrame:
    """(journal_id, column, form, verdict) of every date column of the journals in ``cells``.

    Each form is counted over the cells that it reads, and the column has the form that
    reads most; among equals one that reads the column's first cell, and of those
    month before day. The verdict is AMBIGUOUS where both of them read every cell of the
    column, PARTIAL where some cell is not read by the form, else OK. Each task sends one row
    of counts per journal and column.
    """
    dates = [c for c in (*OPEN_COLUMNS, *CLOSE_COLUMNS)]
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.try_element_at("cells", F.lit(c)).alias("cell")) for c in dates))
    listed = cells.select("journal_id", "row_ord", F.inline(pairs)).select("journal_id", "row_ord", "column", without_zone(text(F.col("cell"))).alias("cell"))
    listed = listed.filter("cell IS NOT NULL")
    read = listed.select("journal_id", "row_ord", "column", *(v.isNotNull().alias(k) for k, v in forms_read(F.col("cell")).items()))
    first = F.min_by(F.struct(*FORMS), "row_ord")
    counted = read.groupBy("journal_id", "column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("day_first") & F.col("month_first")).alias("either"), first.alias("first"), *(F.count_if(k).alias(k) for k in FORMS)
    )
    order = ("month_first", "day_first", *(k for k in FORMS if k not in ("month_first", "day_first")))
    votes = F.array(*(F.struct(F.col(k).alias("cells"), F.col("first")[k].alias("first"), F.lit(-i).alias("rank"), F.lit(k).alias("form")) for i, k in enumerate(order)))
    won = counted.withColumn("won", F.array_max(votes))
    verdict = F.when(F.col("either") == F.col("n"), "AMBIGUOUS").when(F.col("won.cells") < F.col("n"), "PARTIAL").otherwise("OK")
    return won.select("journal_id", "column", F.when(F.col("won.cells") > 0, F.col("won.form")).alias("form"), verdict.alias("verdict"))


#: Names that a table of journals of several headers may have in all; more are told apart by the reader, in parts.
MAX_NAMES = 4096


def widened(cells: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """A column per name that any file has, and each row's own header and date forms.

    Each journal is read by its own header. Its date column, the first of the open columns
    there, is parsed by the column's form. Of the headers only their distinct names reach
    the driver.
    """
    names = sorted(r[0] for r in cells.select(F.explode(F.map_keys("cells"))).distinct().limit(MAX_NAMES + 1).collect())
    if len(names) > MAX_NAMES:
        raise ValueError(f"the files have more than {MAX_NAMES} column names; read them in parts")
    forms = date_forms(cells) if forms is None else forms
    by_journal = forms.filter("form IS NOT NULL").groupBy("journal_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "form"))).alias(DATE_FORM))  # three columns at most
    data = F.map_filter("cells", lambda name, value: ~name.rlike(f"^({INDEX_COLUMN})$"))
    cells = cells.filter(F.exists(F.map_values(data), lambda value: text(value).isNotNull()))
    rows = cells.select("journal_id", "row_ord", F.map_keys("cells").alias(HEADER), *(F.try_element_at("cells", F.lit(n)).alias(n) for n in names))
    rows = rows.join(by_journal, "journal_id", "left")
    dates = {}
    for i, c in enumerate(OPEN_COLUMNS):
        if c in names:
            earlier = [~own(rows, x) for x in OPEN_COLUMNS[:i] if x in names]
            parsed = recorded_time(quoted(c), F.try_element_at(F.col(DATE_FORM), F.lit(c)))
            if any(x in names for x in OPEN_COLUMNS if x != c):  # some journal may have this column as plain text
                chosen = functools.reduce(operator.and_, earlier, F.lit(True))
                parsed = F.when(chosen, F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")).otherwise(quoted(c))
            dates[c] = parsed
    return normalise(rows.withColumns(dates), read=True)


def read_journals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows of all usable journals, audit of every file) below a folder.

    Encoding, delimiter and header are found per file where the file is read.
    Unsupported extensions, files that are no CSV to their end and unusable journals are
    rows of the audit, never errors, and no row of such a file is handed on.
    """
    cells = settled(read_cells(spark, path))
    broken = cells.filter("fault IS NOT NULL").select("journal_id", "fault").distinct()
    sound = cells.filter("fault IS NULL").drop("fault").join(broken.select("journal_id"), "journal_id", "left_anti")
    forms = settled(date_forms(sound))
    cleaned = widened(sound, forms)
    files = listed_files(spark, path)
    kind = F.lower(F.regexp_extract("journal_id", r"\.([^./\\]+)$", 1))
    files = files.withColumn("supported", kind == "csv")
    verdict = contract(cleaned)
    # A file's date column is the first of the open columns; of the forms of others nothing is parsed.
    rank = F.array_position(F.array(*map(F.lit, OPEN_COLUMNS)), F.col("column"))
    dates = forms.filter(F.col("column").isin(*OPEN_COLUMNS)).groupBy("journal_id").agg(F.min_by(F.struct("form", "verdict"), rank).alias("date"))
    audit = files.join(verdict, "journal_id", "left").join(broken, "journal_id", "left").join(dates, "journal_id", "left").select(
        "journal_id",
        F.when(~F.col("supported"), "UNSUPPORTED_FILE").otherwise(F.coalesce("fault", "status", F.lit("EMPTY_DATASET"))).alias("reason"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("date.form").alias("date_form"), F.col("date.verdict").alias("date_verdict"),
    )
    cleaned = cleaned.join(verdict.filter("status = 'OK'").select("journal_id"), "journal_id", "left_semi")
    audit = audit.withColumn("status", F.when(F.col("reason") == "OK", "processed").otherwise("error")).withColumn("file", basename(F.col("journal_id")))
    return cleaned, audit


def append_audit(audit: DataFrame, path: str) -> None:
    """Keep the outcomes of a run beside those of earlier ones."""
    audit.withColumn("seen_at", F.current_timestamp()).write.mode("append").parquet(path)


def outcomes(files: DataFrame, kept: DataFrame) -> DataFrame:
    """(journal_id, status, reason, n_rows) of each listed file: its last kept outcome, or pending."""
    last = kept.groupBy("journal_id").agg(F.max_by(F.struct("status", "reason", "n_rows"), "seen_at").alias("last"))
    joined = files.select("journal_id").distinct().join(last, "journal_id", "left")
    return joined.select("journal_id", F.coalesce("last.status", F.lit("pending")).alias("status"), "last.reason", F.coalesce("last.n_rows", F.lit(0)).alias("n_rows"))


def bar_lines(path: str, content: bytes) -> Iterator[tuple]:
    """(file, fault, the six columns) of a bar file's rows by its own header: short rows padded, further fields and columns ignored.

    A file that cannot be read as a whole is one row with its fault.
    """
    nothing = (None,) * len(BAR_COLUMNS)
    if not content:
        yield (path, "EMPTY_FILE", *nothing)
        return
    try:
        text = content.decode("utf-8-sig")
        rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except (UnicodeDecodeError, csv.Error) as error:
        yield (path, "DECODE_ERROR" if isinstance(error, UnicodeDecodeError) else "CSV_PARSE_ERROR", *nothing)
        return
    names = [n.strip() for n in rows[0]] if rows else []
    if len(rows) < 3:
        yield (path, "TOO_FEW_ROWS", *nothing)
    elif missing := [c for c in BAR_COLUMNS if c not in names]:
        yield (path, "MISSING_REQUIRED_COLUMNS", *(c if c in missing else None for c in BAR_COLUMNS))
    else:
        at = [len(names) - 1 - names[::-1].index(c) for c in BAR_COLUMNS]  # of a repeated name the last counts
        for fields in rows[1:]:
            yield (path, None, *(fields[i] if i < len(fields) else "" for i in at))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Raw bars as strings with ``bar_set_id`` and the file's ``fault``, each file by its own header. Spark lists no empty files."""
    return _parsed(_files(spark, path), bar_lines, BAR_ROWS)


def download(df: DataFrame, path: str) -> None:
    """The whole cleaned table as CSV, whatever filters a view has."""
    df.drop(HEADER, DATE_FORM).write.mode("overwrite").option("header", True).csv(path)


def export_rows(df: DataFrame, columns: Sequence[str], min_rr: float | None = None) -> DataFrame:
    """The export's rows: chosen columns that exist, dates to the minute, blanks for nulls."""
    if min_rr is not None and any(c in df.columns for c in RR_COLUMNS):
        df = df.filter(number(by_header(df, RR_COLUMNS)) >= min_rr)
    kinds = dict(df.dtypes)
    shown = [c for c in columns if c in df.columns]

    def cell(c: str) -> Column:
        value = F.date_format(quoted(c), "yyyy-MM-dd HH:mm") if kinds[c].startswith("timestamp") or kinds[c] == "date" else quoted(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return df.select(*map(cell, shown))


def export(df: DataFrame, path: str, columns: Sequence[str], meta: DataFrame, kpis: DataFrame | None = None, min_rr: float | None = None) -> None:
    """Three datasets: trades, export_meta and, if given, kpis (of the scope, not of the refined rows)."""
    rows = export_rows(df, columns, min_rr)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/trades")
    meta.withColumn("exported_rows", F.lit(rows.count())).write.mode("overwrite").option("header", True).csv(f"{path}/export_meta")
    if kpis is not None:
        kpis.write.mode("overwrite").option("header", True).csv(f"{path}/kpis")


# Columns that a report shows first.
PREVIEW_COLUMNS = (
    "Open Time", "Open", "Date", "Symbol", "Type", "Side", "Size", "Volume", "Profit", "Commission", "Swap", "Balance", "Pips",
)


def preview(df: DataFrame, order_by: str = "row_ord", rows: int = 25, columns: Sequence[str] = PREVIEW_COLUMNS) -> DataFrame:
    """Up to 8 preferred columns of each journal's first rows, with total and displayed counts."""
    kinds = dict(df.dtypes)
    shown = [c for c in columns if c in df.columns][:8]

    def cell(c: str) -> Column:
        if kinds[c].startswith("timestamp"):
            return F.date_format(quoted(c), "yyyy-MM-dd HH:mm").alias(c)
        return (F.round(quoted(c), 2) if kinds[c] in ("double", "float") else quoted(c)).alias(c)

    place = F.row_number().over(Window.partitionBy("journal_id").orderBy(order_by))
    totals = df.groupBy("journal_id").agg(F.count(F.lit(1)).alias("total_rows"))
    first = df.select("journal_id", place.alias("place"), *map(cell, shown)).filter(F.col("place") <= rows)
    return first.join(totals, "journal_id").withColumn("displayed_rows", F.least(F.col("total_rows"), F.lit(rows)))


def registry(files: DataFrame, name: str | None = None, status: str | None = None) -> DataFrame:
    """File registry, newest first; ``name`` is contained, ``status`` equal, case aside."""
    if text_of(name):
        files = files.filter(folded(F.col("file")).contains(folded(F.lit(text_of(name)))))
    if text_of(status):
        files = files.filter(folded(F.col("status")) == folded(F.lit(text_of(status))))
    return files.orderBy(F.desc("uploaded_at"), "file")


def text_of(value: object) -> str:
    return "" if value is None else str(value).strip()


MANUAL_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("symbol", "side", "status")]
    + [T.StructField(n, T.DecimalType(20, 8)) for n in ("quantity", "entry_price", "exit_price", "stop_loss", "take_profit")]
    + [T.StructField("fees", T.DecimalType(12, 2))]
    + [T.StructField(n, T.TimestampType()) for n in ("open_time", "close_time")]
    + [T.StructField(n, T.StringType()) for n in ("tag", "notes")]
)


def read_manual_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANUAL_SCHEMA).parquet(path)


