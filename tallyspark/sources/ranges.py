"""One large journal file read by many tasks, with the rows that a reader of the whole file gives.

A range is a split of the file at a line's end, so a range may begin inside quotes. The
first pass runs over the lines of each range and tells, for either state at its
beginning and each character that may part fields, in which state it ends; it also notes the
file's head and which encodings read the range. States compose: over a file's ranges, a row
each, a window finds the last range before that ends in one state whatever it begins in, and
counts the ranges since then that turn the state. The second pass reads each range from its
known state. A record that crosses ranges is put together from its fragments, a row per
range that it touches. No task holds more than a batch of lines, a record, or a file's list
of ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import settled
from tallyspark.sources.csv_text import delimiter, header_names, records

#: Bytes of a file's beginning that must hold its header.
HEAD_BYTES = 1 << 16
#: Ranges whose states are sent to all tasks at once, some 200 bytes each; files with more in all are read in parts.
RANGES_A_PART = 100_000
BOM = b"\xef\xbb\xbf"
#: Bytes that stand for nothing in cp1252.
NOT_CP1252 = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")


class Quotes:
    """Whether a line ends inside quotes, for one character that parts fields.

    Quotes count where a field begins: at the line's beginning, after the parting
    character or after a lone carriage return. Inside, a doubled quote is a quote.
    """

    def __init__(self, parting: str) -> None:
        self.opens = re.compile(b"[" + re.escape(parting.encode()) + rb'\r]"')

    def after(self, line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at = 0
        if not inside:
            if line[:1] == b'"':
                at = 1
            elif found := self.opens.search(line):
                at = found.end()
            else:
                return False
        while True:
            closing = line.find(b'"', at)
            if closing < 0:
                return True
            if line[closing + 1 : closing + 2] == b'"':
                at = closing + 2
                continue
            found = self.opens.search(line, closing + 1)
            if not found:
                return False
            at = found.end()


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, line) of the files' lines, in order within each task; a task reads the ranges of some files one after the other."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[bytes]]]:
    """((path, start), first row, lines): the lines of a batch that lie in one range."""
    paths, starts, lines = (batch.column(c).to_pylist() for c in range(3))
    first = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or starts[i] != starts[first] or paths[i] != paths[first]:
            yield (paths[first], starts[first]), first, lines[first:i]
            first = i


def scanned(lines: DataFrame, partings: str) -> DataFrame:
    """(path, start, head, utf8, cp1252, ends) of every range: ``ends`` holds per parting character the state after it, from outside and from inside."""
    schema = "path string, start long, head binary, utf8 boolean, cp1252 boolean, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = [Quotes(c) for c in partings]
        now, head, utf8, cp1252, ends = None, b"", True, True, []

        def told() -> pa.RecordBatch:
            values = [[now[0]], [now[1]], [head], [utf8], [cp1252], [[int(e) for e in ends]]]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["path", "start", "head", "utf8", "cp1252", "ends"])

        for key, _, some in (run for batch in batches for run in _runs(batch)):
            if key != now:
                if now:
                    yield told()
                now, head, utf8, cp1252, ends = key, b"", True, True, [False, True] * len(quotes)
            whole = b"\n".join(some)
            if now[1] == 0:
                if not head and some[0].startswith(BOM):
                    some[0] = some[0][len(BOM) :]
                head += (whole + b"\n")[: max(0, HEAD_BYTES - len(head))]
            if utf8:
                try:
                    whole.decode()
                except UnicodeDecodeError:
                    utf8 = False
            cp1252 = cp1252 and not NOT_CP1252.search(whole)
            if b'"' in whole:
                for line in some:
                    if b'"' in line:
                        ends = [quotes[i // 2].after(line, e) for i, e in enumerate(ends)]
        if now:
            yield told()

    return lines.mapInArrow(run, schema)


def known_files(ranges: DataFrame, partings: str) -> DataFrame:
    """(path, encoding, parting, names) of each file, from its head and from what reads all its ranges; names are null without a whole header in the head."""
    files = ranges.groupBy("path").agg(F.max_by("head", -F.col("start")).alias("head"), F.bool_and("utf8").alias("utf8"), F.bool_and("cp1252").alias("cp1252"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, head, utf8, cp1252 in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                encoding = "utf-8" if utf8 else "cp1252" if cp1252 else "iso-8859-1"
                text = (head.removeprefix(BOM) if utf8 else head).decode(encoding, "ignore")
                parting = delimiter(text)
                names = next((header_names(fields) for fields, sound in records(text, parting) if fields and sound), None)
                out.append((path, encoding, parting, names))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "encoding", "parting", "names"])

    return files.mapInArrow(run, "path string, encoding string, parting string, names array<string>")


def started(ranges: DataFrame, files: DataFrame, partings: str) -> DataFrame:
    """(path, start, inside, closed, ...) of every range, in which state it begins, whether its file ends outside quotes, and what is known of the file."""
    place = F.instr(F.lit(partings), F.col("parting"))
    rows = ranges.join(files, "path").select(
        "path", "start", "encoding", "parting", "names", F.get("ends", (place - 1) * 2).alias("from_outside"), F.get("ends", (place - 1) * 2 + 1).alias("from_inside")
    )
    order = Window.partitionBy("path").orderBy("start")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    settles, turns = F.col("from_outside") == F.col("from_inside"), (F.col("from_outside") == 1) & (F.col("from_inside") == 0)
    rows = rows.withColumn("turned", F.sum(turns.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(settles, F.struct(F.col("from_outside").alias("state"), "turned")), True).over(before)
    rows = rows.withColumns({"last": last, "upto": F.coalesce(F.max("turned").over(before), F.lit(0))})
    state = (F.coalesce(F.col("last.state"), F.lit(0)) + F.col("upto") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2
    rows = rows.withColumn("inside", state == 1).withColumn("end", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    rows = rows.withColumn("closed", F.max_by("end", "start").over(whole) == 0)
    return rows.select("path", "start", "inside", "closed", "encoding", "parting", "names")


ROWS = "path string, start long, n long, fields array<string>, piece binary, kind int"
#: Kinds of what a range gives: a record, and the fragments of one that began before, goes through it, or goes on after it.
RECORD, TAIL_END, MIDDLE, BEGUN = 0, 1, 2, 3


def read(lines: DataFrame) -> DataFrame:
    """ROWS of the lines (path, start, line, inside, encoding, parting): records with their number in the range, and fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, quotes, encoding, parting = None, False, None, "", ""
        held: list[bytes] = []  # lines of a record that is not whole
        opened, n, header = True, 0, False  # whether the held lines' record began in this range; whether the header is still to come

        def rest() -> list[tuple]:
            if not held:
                return []
            return [(*now, -1 if header else n, None, b"\n".join(held), BEGUN if opened else MIDDLE)]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int32()]
            columns = zip(*out, strict=True) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "n", "fields", "piece", "kind"])

        for batch in batches:
            out: list[tuple] = []
            for key, row, some in _runs(batch):
                if key != now:
                    out += rest()
                    now = key
                    inside, encoding, parting = (batch.column(c)[row].as_py() for c in ("inside", "encoding", "parting"))
                    quotes, held, opened, n, header = Quotes(parting), [], not inside, 0, key[1] == 0
                    if header and encoding == "utf-8" and some[0].startswith(BOM):
                        some[0] = some[0][len(BOM) :]
                ready: list[bytes] = []
                for line in some:
                    inside = quotes.after(line, inside)
                    held.append(line)
                    if not inside:
                        if opened:
                            ready += held
                        else:  # the end of a record that began before
                            out.append((*now, n, None, b"\n".join(held), TAIL_END))
                            opened = True
                        held = []
                if ready:
                    for fields, _ in records((b"\n".join(ready) + b"\n").decode(encoding), parting):
                        if not fields:
                            continue
                        if header:
                            header = False
                            continue
                        out.append((*now, n, fields, None, RECORD))
                        n += 1
            yield batch_of(out)
        if now:
            yield batch_of(rest())

    return lines.mapInArrow(run, ROWS)


def joined_records(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """The records of ``fragments``, numbered as the last of the range in which they begin."""
    order = Window.partitionBy("path").orderBy("start", "kind")  # a row or two per range
    told = fragments.withColumn("of", F.sum((F.col("kind") == BEGUN).cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "piece", "n")))
    whole = told.groupBy("path", "of").agg(pieces.alias("pieces")).join(files.select("path", "encoding", "parting"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, parts, encoding, parting in zip(*(batch.column(c).to_pylist() for c in ("path", "pieces", "encoding", "parting")), strict=True):
                text = b"\n".join(p["piece"] for p in parts).decode(encoding)
                if parts[0]["n"] >= 0:  # else it is the header
                    out += [(path, parts[0]["start"], parts[0]["n"], fields) for fields, _ in records(text, parting) if fields]
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "n", "fields"])

    return whole.mapInArrow(run, "path string, start long, n long, fields array<string>")


def _part(spark: SparkSession, paths: list[str], partings: str) -> DataFrame:
    lines = _lines(spark, paths)
    ranges = settled(scanned(lines, partings))
    files = settled(known_files(ranges, partings))
    states = settled(started(ranges, files, partings))
    sound = states.filter("closed AND names IS NOT NULL")
    known = sound.select("path", "start", "inside", "encoding", "parting")
    found = settled(read(lines.join(F.broadcast(known), ["path", "start"]).select("path", "start", "line", "inside", "encoding", "parting")))  # RANGES_A_PART rows
    records = found.filter(F.col("kind") == RECORD).select("path", "start", "n", "fields")
    crossing = joined_records(found.filter(F.col("kind") != RECORD).select("path", "start", "n", "piece", "kind"), files)
    rows = records.unionByName(crossing).join(F.broadcast(files.select("path", "names")), "path")
    rows = settled(rows.filter(F.size("fields") <= F.size("names")))
    # Places in the file: those before the range, then those in it.
    in_range = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("rows")).select("path", "start", F.coalesce(F.sum("rows").over(in_range), F.lit(0)).alias("base"))
    order = Window.partitionBy("path", "start").orderBy("n")
    placed = rows.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(bases), ["path", "start"])
    cells = F.map_from_arrays("names", F.transform("names", lambda _, i: F.get("fields", i)))
    lost = states.filter("NOT closed OR names IS NULL").select("path").distinct()
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fault = lost.select("path", F.lit(None).cast("long").alias("row_ord"), none.alias("cells"), F.lit("UNREADABLE_FILE").alias("fault"))
    good = placed.select("path", (F.col("base") + F.col("at")).alias("row_ord"), cells.alias("cells"), F.lit(None).cast("string").alias("fault"))
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return good.unionByName(fault).select(plain.alias("journal_id"), "row_ord", "cells", "fault")


def range_cells(spark: SparkSession, sizes: dict[str, int], partings: str, range_bytes: int | None = None) -> DataFrame:
    """(journal_id, row_ord, cells, fault) of the files (path -> bytes), as a reader of whole files gives them.

    Ranges are the session's file splits, or of ``range_bytes``; all that reads the files has run when this returns.
    """
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", str(range_bytes or before).lower()).groups()
    split = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    parts: list[list[str]] = [[]]
    used = 0
    for path, size in sizes.items():
        if used and used + size // split + 1 > RANGES_A_PART:
            parts.append([])
            used = 0
        parts[-1].append(path)
        used += size // split + 1
    try:
        spark.conf.set(key, str(split))
        found = [_part(spark, paths, partings) for paths in parts]
    finally:
        spark.conf.set(key, before)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
