"""Journals of several headers and date forms in one folder give what each gives alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import cleaning as C
from tallyspark.operators import excursion, review, strict_queries
from tallyspark.sources import journals

LONG = "Ticket,Open Time,Close Time,Symbol,Type,Entry,Exit,Profit\n1,2031-01-05 10:00:00,2031-01-05 11:00:00,TIN,buy,10,11,5\n2,2031-01-06 10:00:00,2031-01-06 11:00:00,TIN,sell,10,11,-5\n"
SHORT = "Date,Close,Entry Price,Exit Price,Side,Symbol,Profit,Ticket\n13/01/2031 09:30,13/01/2031 10:00,4,5,long,ZINC,2,7\n02/03/2031 09:30,02/03/2031 10:00,4,5,short,ZINC,1,8\n"
MONTHS = "Ticket;Open;Close;Symbol;Type;Price;Price.1;Profit\n1;02/13/2031 10:00;02/13/2031 10:30;LEAD;sell;3;2;9\n2;02/03/2031 10:00;02/03/2031 10:30;LEAD;buy;3;2;-9\n"
BARE = "Symbol,Profit,Comment\nTIN,1,no times\nZINC,2,\n"
FILES = {"long.csv": LONG, "short.csv": SHORT, "months.csv": MONTHS, "bare.csv": BARE}


def folder(tmp_path, name, files):
    place = tmp_path / name
    place.mkdir()
    for file, text in files.items():
        (place / file).write_text(text)
    return str(place)


def results(spark, path):
    """What the operators give for each file below ``path``."""
    rows, audit = journals.read_journals(spark, path)
    file = C.basename(F.col("journal_id")).alias("file")
    bases = audit.select("journal_id", F.lit("UTC").alias("kind"), F.lit(None).cast("int").alias("offset_minutes"), F.lit(None).cast("string").alias("zone"))
    checked = excursion.checked_trades(rows, bases).select(file, "row_ord", "ticket", "symbol", "side", "entry", "exit", "open_utc", "close_utc", "reason")
    strict = [strict_queries.run(rows, q) for q in ("PROFIT_BY_DAY", "TRADE_COUNT_BY_SYMBOL")]
    gate = excursion.key_gate(rows, C.by_header(rows, C.TICKET_COLUMNS), present=C.own_any(rows, C.TICKET_COLUMNS)).select(file, "gate")
    placed = review.page(review.enrich(rows), "open_time", descending=True).select(file, "row_ord", "place", "movement_value")
    prints = excursion.fingerprint(rows).select(file, "journal_fingerprint")
    tables = [checked, gate, placed, prints, *(s.status.select(file, "n_rows", "status", "issues") for s in strict), *(s.rows.select(file, "key", "value") for s in strict)]
    return [sorted(map(tuple, t.collect()), key=str) for t in tables]


def test_together_as_alone(spark, tmp_path):
    together = results(spark, folder(tmp_path, "all", FILES))
    alone = [results(spark, folder(tmp_path, f"only-{n}", {name: text})) for n, (name, text) in enumerate(FILES.items())]
    for k, rows in enumerate(together):
        assert rows == sorted((r for found in alone for r in found[k]), key=str), k
    checked = {(r[0], r[1]): r for r in together[0]}
    assert checked["short.csv", 1][7] == dt.datetime(2031, 3, 2, 9, 30) and checked["months.csv", 1][7] == dt.datetime(2031, 2, 3, 10)
    assert {r[0]: r[-1] for r in together[0]} == {"long.csv": None, "short.csv": None, "months.csv": None, "bare.csv": "MISSING_OPEN"}
    assert dict(together[1]) == {"long.csv": "OK", "short.csv": "OK", "months.csv": "OK", "bare.csv": "TICKET_COLUMN_MISSING"}
    assert {r[0]: r[2] for r in together[4]} == {"long.csv": "OK", "short.csv": "OK", "months.csv": "OK", "bare.csv": "REQUIRED_COLUMN_MISSING"}


@pytest.mark.parametrize(
    ("cells", "form", "verdict", "read"),
    [
        (["02/13/2031 10:00", "02/03/2031 10:00"], "month_first", "OK", ["2031-02-13 10:00", "2031-02-03 10:00"]),
        (["03/02/2031", "", "13/02/2031"], "day_first", "OK", ["2031-02-03 00:00", None, "2031-02-13 00:00"]),
        (["03/02/2031", "04/02/2031"], "month_first", "AMBIGUOUS", ["2031-03-02 00:00", "2031-04-02 00:00"]),
        (["13/02/2031", "02/13/2031"], "day_first", "PARTIAL", ["2031-02-13 00:00", None]),
        (["02/13/2031", "13/02/2031"], "month_first", "PARTIAL", ["2031-02-13 00:00", None]),
        (["2031.02.03 10:00", "soon", "2031.02.04 10:00:30"], "dotted", "PARTIAL", ["2031-02-03 10:00", None, "2031-02-04 10:00"]),
        (["3 Feb 2031", "13 Feb 2031 07:05"], "named", "OK", ["2031-02-03 00:00", "2031-02-13 07:05"]),
        (["2031-02-03T10:00:00Z", "2031-02-30"], "iso", "PARTIAL", ["2031-02-03 10:00", None]),
        (["soon", "31/02/2031"], None, "PARTIAL", [None, None]),
    ],
)
def test_one_form_a_column(spark, tmp_path, cells, form, verdict, read):
    path = folder(tmp_path, "in", {"a.csv": "Date,Profit\n" + "".join(f"{c},1\n" for c in cells), "b.csv": "Open,Profit\n25/12/2031,1\n"})
    rows, audit = journals.read_journals(spark, path)
    told = {r["file"]: (r["reason"], r["date_form"], r["date_verdict"]) for r in audit.collect()}
    assert told == {"a.csv": ("OK", form, verdict), "b.csv": ("OK", "day_first", "OK")}
    at = rows.filter(F.col("journal_id").endswith("a.csv")).orderBy("row_ord").select(F.date_format(C.opened(rows), "yyyy-MM-dd HH:mm")).collect()
    assert [r[0] for r in at] == read


def test_every_outcome_of_a_file(spark, tmp_path):
    wide = "Symbol,Profit\nTIN,5\n"
    files = {
        "ok.csv": wide, "cut.csv": 'Symbol,Profit,Notes\nTIN,5,fine\nTIN,6,"never closed\nTIN,7,x\n', "empty.csv": "", "blank.csv": "\n\n", "none.csv": "Symbol,Profit\n",
        "void.csv": "Symbol,Profit\n,\n", "text.csv": "Symbol\nTIN\n", "lost.csv": "Symbol,Profit\nTIN,much\n", "zero.csv": wide + "\0,1\n", "book.xlsx": "PK", "with space.csv": wide,
    }
    rows, audit = journals.read_journals(spark, folder(tmp_path, "in", files))
    assert {r["file"]: r["reason"] for r in audit.collect()} == {
        "ok.csv": "OK", "cut.csv": "UNREADABLE_FILE", "empty.csv": "EMPTY_DATASET", "blank.csv": "EMPTY_DATASET", "none.csv": "EMPTY_DATASET", "void.csv": "EMPTY_DATASET",
        "text.csv": "MISSING_PROFIT", "lost.csv": "NO_PARSABLE_PROFIT", "zero.csv": "OK", "book.xlsx": "UNSUPPORTED_FILE", "with space.csv": "OK",
    }
    assert {file_name(r["journal_id"]) for r in rows.collect()} == {"ok.csv", "zero.csv", "with space.csv"}
    with pytest.raises(ValueError, match="column names"):
        limit, journals.MAX_NAMES = journals.MAX_NAMES, 1
        try:
            journals.read_journals(spark, str(tmp_path / "in"))
        finally:
            journals.MAX_NAMES = limit


def file_name(path):
    return path.rsplit("/", 1)[1].replace("%20", " ")


def test_a_journal_without_rows_has_no_data(spark):
    rows = spark.createDataFrame([("a", 0, 1.5, ["Profit"])], "journal_id string, row_ord long, Profit double, _header array<string>")
    listed = spark.createDataFrame([("a",), ("b",)], "journal_id string")
    found = {r["journal_id"]: (r["n_rows"], r["status"]) for r in strict_queries.run(rows, "TRADE_COUNT", journals=listed).status.collect()}
    assert found == {"a": (1, "OK"), "b": (0, "NO_DATA")}


@pytest.mark.parametrize("key", ["profit", "symbol", "open_time", "no_such_key"])
@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_by_ranges(spark, monkeypatch, key, descending):
    """Every page by counted ranges is that of the sorted journal, with ties, nulls and a journal far larger than the others."""
    rows = [("hot" if i % 5 else f"j{i % 3}", i, str(i % 50), (i * 37) % 11 if i % 7 else None, ["TIN", "tin", None, " ", "nan"][i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "journal_id string, row_ord long, Ticket string, Profit long, Symbol string").repartition(4)
    pages = [review.page(df, key, descending, number=n, rows=60).select("journal_id", "row_ord", "place").collect() for n in range(1, 8)]
    monkeypatch.setattr(review, "DEEP", 0)
    deep = [review.page(df, key, descending, number=n, rows=60, partitions=7) for n in (1, 3, 6, 7)]
    for n, found in zip((1, 3, 6, 7), deep, strict=True):
        assert sorted(map(tuple, found.select("journal_id", "row_ord", "place").collect())) == sorted(map(tuple, pages[n - 1]))
