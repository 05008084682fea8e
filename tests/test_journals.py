"""Golden values of journal cleaning, scope, measures and charts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import cleaning as C
from tallyspark.operators import bars, charts, kpis, prefix_scan, scope, strict_queries
from tallyspark.operators.exact_sum import exact_sums, two_places
from tallyspark.session import settled
from tallyspark.sources import journals, versions


def profits(spark, values):
    rows = [("j", i, None if v is None else str(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "journal_id string, row_ord long, Profit string").withColumn("Profit", C.number(F.col("Profit")))


def measured(spark, values):
    return {r["metric"]: r["value"] for r in kpis.rendered(kpis.kpis(profits(spark, values), ["journal_id"], "Profit", ["row_ord"]), ["journal_id"]).collect()}


def test_eighteen_measures(spark):
    found = measured(spark, [100, -50, 0, 25])
    assert found == {
        "Total Trades": "4", "Winning Trades": "2", "Losing Trades": "1", "Break-even Trades": "1", "Win Rate (%)": "50.00",
        "Total Profit": "75.00", "Average Profit": "18.75", "Gross Profit": "125.00", "Gross Loss": "50.00", "Average Win": "62.50",
        "Average Loss": "50.00", "Profit Factor": "2.50", "Expectancy": "18.75", "Best Trade": "100.00", "Worst Trade": "-50.00",
        "Max Drawdown": "50.00", "Sharpe": "0.30", "Volatility": "62.50",
    }


@pytest.mark.parametrize(
    ("values", "fall"),
    [([-50, 100, 0, 25], 50), ([-10, -20], 30), ([100, -80, -30, 50], 110), ([-80, 100, -30, 50], 80), ([100, -40, -80, 50], 120)],
)
def test_drawdown_depends_on_order(spark, values, fall):
    assert float(measured(spark, values)["Max Drawdown"]) == fall
    assert prefix_scan.max_drawdown(profits(spark, values), "Profit", ["row_ord"], partitions=3).first()[0] == fall


@pytest.mark.parametrize(("values", "factor"), [([10, 20], "∞"), ([0, 0], "N/A"), ([100, -25], "4.00")])
def test_profit_factor(spark, values, factor):
    assert measured(spark, values)["Profit Factor"] == factor


def test_bad_profits_are_dropped_or_nothing_is_left(spark):
    assert measured(spark, ["invalid", 10, None])["Total Trades"] == "1"
    assert measured(spark, ["invalid", None]) == {}


def test_prefix_scan_equals_window(spark):
    values = [math.sin(i * 7) * 100 for i in range(500)]
    df = profits(spark, values)
    curve = {r["position"]: r["running"] for r in prefix_scan.running_sum(df, "Profit", ["row_ord"], partitions=7).collect()}
    total = 0.0
    for i, v in enumerate(values):
        total += v
        assert curve[i] == pytest.approx(total)


def test_exact_sum(spark):
    df = spark.createDataFrame([("a", v) for v in [0.1] * 10 + [1e16, -1e16]] + [("b", None)], "k string, v double").repartition(5)
    found = {r["k"]: r["exact_sum"] for r in exact_sums(df, ["k"], "v").collect()}
    assert found == {"a": 1.0, "b": 0.0}


def test_tickets(spark):
    cells = [("123", "123"), ("123.0", "123"), ("123.00", "123"), ("1e2", "100"), (" Ab-1 ", "Ab-1"), ("", None), ("nan", None), ("inf", None), (None, None)]
    df = spark.createDataFrame([(c,) for c, _ in cells], "c string")
    assert [r[0] for r in df.select(C.ticket(F.col("c"))).collect()] == [t for _, t in cells]


def test_times(spark):
    cells = [
        ("25 Jun 2026 10:30:15", "ok", dt.datetime(2026, 6, 25, 10, 30, 15)), ("2026-06-25T10:30", "ok", dt.datetime(2026, 6, 25, 10, 30)),
        ("2026-06-25 10:30:15+02:00", "aware", None), ("not-a-date", "invalid", None), ("", "blank", None),
        ("2026-06-25 10:30:15.250", "ok", dt.datetime(2026, 6, 25, 10, 30, 15, 250000)),
    ]
    df = spark.createDataFrame([(c,) for c, _, _ in cells], "c string")
    found = df.select(C.time_class(F.col("c")), C.local_time(F.col("c"))).collect()
    assert [(r[0], r[1]) for r in found] == [(k, t) for _, k, t in cells]


def test_files(spark, tmp_path):
    (tmp_path / "semi.csv").write_text(" Symbol ;Profit\nEURUSD;10\nUSD;-5\n;\n")
    (tmp_path / "latin.csv").write_bytes("Notes,Profit,Commissions,Unnamed: 0,#\n£ gain,7,1,0,9\nx,1,2,3,4,5,6\nshort\n".encode("cp1252"))
    (tmp_path / "none.csv").write_text("Symbol,Profit\n")
    (tmp_path / "text.csv").write_text("Symbol\nEURUSD\n")
    (tmp_path / "bad.csv").write_text("Symbol,Profit\nEURUSD,abc\n")
    (tmp_path / "book.xlsx").write_bytes(b"PK")
    rows, audit = journals.read_journals(spark, str(tmp_path))
    reasons = {r["file"]: r["reason"] for r in audit.collect()}
    assert reasons == {
        "semi.csv": "OK", "latin.csv": "OK", "none.csv": "EMPTY_DATASET", "text.csv": "MISSING_PROFIT", "bad.csv": "NO_PARSABLE_PROFIT",
        "book.xlsx": "UNSUPPORTED_FILE",
    }
    assert {"Commission", "#"} <= set(rows.columns) and "Unnamed: 0" not in rows.columns
    found = sorted((r["Profit"] for r in rows.collect() if r["Profit"] is not None))
    assert found == [-5.0, 7.0, 10.0]
    assert "£ gain" in {r["Notes"] for r in rows.collect()}


def test_quoted_line_breaks_and_places(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Symbol,Notes,Profit\nCORN,"first\nsecond",5\nRICE,plain,-2\n\nOATS,"x ""y"" z",1\n')
    (tmp_path / "b.csv").write_text("Date,Profit,Profit\n2025-03-10,1,2\n")
    (tmp_path / "c.csv").write_text("Open Time,Date,Profit\n2025-03-11 10:00:00,as text,4\n")
    rows, _ = journals.read_journals(spark, str(tmp_path))
    found = {(r["journal_id"].rsplit("/", 1)[1], r["row_ord"]): r for r in rows.collect()}
    assert {k: r["Profit"] for k, r in found.items()} == {("a.csv", 0): 5, ("a.csv", 1): -2, ("a.csv", 2): 1, ("b.csv", 0): 1, ("c.csv", 0): 4}
    assert found["a.csv", 0]["Notes"] == "first\nsecond" and found["a.csv", 2]["Notes"] == 'x "y" z'
    assert (found["b.csv", 0]["Date"], found["c.csv", 0]["Date"], found["b.csv", 0]["Profit.1"]) == ("2025-03-10 00:00:00", "as text", "2")


def test_outcomes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Symbol,Profit\nCORN,5\n")
    _, audit = journals.read_journals(spark, str(tmp_path / "in"))
    journals.append_audit(audit, str(tmp_path / "audit"))
    journals.append_audit(audit.withColumn("reason", F.lit("AGAIN")), str(tmp_path / "audit"))
    listed = audit.select("journal_id").unionByName(spark.createDataFrame([("later.csv",)], "journal_id string"))
    found = {r["journal_id"].rsplit("/", 1)[-1]: (r["status"], r["reason"]) for r in journals.outcomes(listed, spark.read.parquet(str(tmp_path / "audit"))).collect()}
    assert found == {"a.csv": ("processed", "AGAIN"), "later.csv": ("pending", None)}


def test_an_empty_bar_file():
    assert [r[1] for r in journals.bar_lines("d.csv", b"")] == ["EMPTY_FILE"]


def test_bar_files_by_their_own_headers(spark, tmp_path):
    row = "2025-03-10T00:0{}:00.000Z,CORN,2,3,1,2\n"
    (tmp_path / "a.csv").write_text("TimestampUTC,Symbol,Open,High,Low,Close\n" + row.format(0) + row.format(1))
    (tmp_path / "b.csv").write_text("\ufeff Close ,Low,High,Open,Symbol,TimestampUTC,More\n2,1,3,2,RICE,2025-03-10T00:00:00Z,x,y\n2,1,3,2,RICE,2025-03-10T00:01:00+00:00\n", "utf-8")
    (tmp_path / "c.csv").write_text("TimestampUTC,Symbol,Open\n" + row.format(0) * 2)
    (tmp_path / "e.csv").write_bytes(b"TimestampUTC,Symbol\n\xff\xfe\n\n")
    (tmp_path / "f.csv").write_text("TimestampUTC,Symbol,Open,High,Low,Close\n" + row.format(0))
    checked = settled(bars.parse(journals.read_bars(spark, str(tmp_path))))
    verdicts = {r["bar_set_id"].rsplit("/", 1)[1]: r["verdict"] for r in bars.verdicts(checked).collect()}
    assert verdicts == {"a.csv": "OK", "b.csv": "OK", "c.csv": "MISSING_REQUIRED_COLUMNS", "e.csv": "DECODE_ERROR", "f.csv": "TOO_FEW_ROWS"}
    good = {(r["symbol"], r["open"], r["high"], r["low"], r["close"]) for r in bars.clean_bars(checked).collect()}
    assert good == {("CORN", 2, 3, 1, 2), ("RICE", 2, 3, 1, 2)}


STAMPS = {
    "2025-03-10T00:00:00Z": None, "2025-03-10T00:00:00.000Z": None, "2025-03-10T00:00:00+00:00": None, "2025-03-10T00:00:00.001Z": "TIMESTAMP_NOT_MINUTE_ALIGNED",
    "2025-03-10T00:00:30Z": "TIMESTAMP_NOT_MINUTE_ALIGNED", "2025-03-10T00:00:00+01:00": "NON_UTC_TIMESTAMP", "2025-03-10 00:00:00Z": "INVALID_TIMESTAMP",
    "2025-03-10T00:00Z": "INVALID_TIMESTAMP", "2025-03-10T00:00:00": "INVALID_TIMESTAMP", "2025-02-30T00:00:00Z": "INVALID_TIMESTAMP", None: "INVALID_TIMESTAMP",
}


def test_bar_stamps(spark):
    rows = [("s", i, t, "CORN", "2", "3", "1", "2") for i, t in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, "bar_set_id string, i int, TimestampUTC string, Symbol string, Open string, High string, Low string, Close string")
    assert {(r["reason"]) for r in bars.parse(df.drop("Close")).collect()} == {"MISSING_REQUIRED_COLUMNS"}
    for t, want in STAMPS.items():
        assert bars.parse(df.filter(F.col("TimestampUTC").eqNullSafe(F.lit(t)))).first()["reason"] == want, t


def scoped(spark):
    """Two journals: one of dated rows around midnight with a missing date and a missing symbol, one of a single row."""
    rows = [
        ("a", 1, "2031-05-04 00:00:00", "Copper", 1250.5, None), ("a", 2, "2031-05-04 23:59:59", "copper.x", -3.25, "late"), ("a", 3, "2031-05-05 00:00:00", None, 7.0, "COPPER in the note"),
        ("a", 4, None, "Copper", 0.0, "undated"), ("a", 5, "2031-06-01 12:00:00", "Tin", None, "1250.5 as text"), ("b", 6, "2031-05-04 12:00:00", "Tin", 1250.500000001, None),
    ]
    df = spark.createDataFrame(rows, "journal_id string, n int, t string, Symbol string, Profit double, Notes string")
    return df.withColumn("Date", F.col("t").cast("timestamp_ntz")).drop("t")


@pytest.mark.parametrize(
    ("params", "kept"),
    [
        ({"start_date": "2031-05-04", "end_date": "2031-05-04"}, {1, 2, 6}), ({"start_date": "2031-05-05"}, {3, 5}), ({"end_date": "2031-05-03"}, set()),
        ({"symbol": " COPPER "}, {1, 2, 4}), ({"symbol": "tin", "start_date": "2031-05-05"}, {5}), ({"q": "copper"}, {1, 2, 3, 4}), ({"q": "1,250.5"}, {1, 6}),
        ({"q": "1250.5"}, {1, 5, 6}), ({"q": "2031-06"}, {5}), ({"q": "%"}, set()), ({"q": " "}, {1, 2, 3, 4, 5, 6}), ({"start_date": "2031-13-01"}, {1, 2, 3, 4, 5, 6}),
    ],
)
def test_scope(spark, params, kept):
    assert {r["n"] for r in scope.apply_scope(scoped(spark), params).collect()} == kept


def test_lineage(spark):
    found = {r["journal_id"]: r for r in scope.lineage(scoped(spark), {"symbol": "copper", "end_date": "2031-05-31", "start_date": "soon"}).collect()}
    assert [(found[j]["source_rows"], found[j]["analysed_rows"], found[j]["zero_result"]) for j in "ab"] == [(5, 2, False), (1, 0, True)]
    assert all(r["active_filters"] == {"end_date": "2031-05-31", "symbol": "copper"} for r in found.values())


def strict(spark, rows, schema, query):
    df = spark.createDataFrame(rows, schema).withColumns({"journal_id": F.lit("j"), "row_ord": F.monotonically_increasing_id()})
    found = strict_queries.run(df, query)
    return found.status.first(), sorted(((r["key"], r["value"]) for r in found.rows.collect()))


def test_strict_queries(spark):
    status, rows = strict(spark, [("2024-01-31 23:59:00", 10.0), ("2024-02-01 00:01:00", 5.0)], "`Open Time` string, Profit double", "MONTHLY_PROFIT")
    assert status["status"] == "OK" and rows == [("2024-01", 10.0), ("2024-02", 5.0)]
    status, rows = strict(spark, [("a", None), ("a", "x"), ("a", "NaN"), ("a", "10")], "Symbol string, Profit string", "PROFIT_BY_SYMBOL")
    assert status["status"] == "INVALID_INPUT" and rows == [] and {i["reason"] for i in status["issues"]} >= {"PROFIT_MISSING", "PROFIT_NOT_NUMERIC"}
    status, _ = strict(spark, [("2024-01-15 10:00:00+01:00",), ("2024-01-15 10:00:00-05:00",)], "`Open Time` string", "TRADE_COUNT_BY_DAY")
    assert status["status"] == "AMBIGUOUS_TIME_BASIS"
    status, rows = strict(spark, [("2024-01-15T10:00:00+05:00",)] * 2, "`Open Time` string", "TRADE_COUNT_BY_DAY")
    assert (status["status"], status["recorded_offset"], rows) == ("OK", "+05:00", [("2024-01-15", 2)])
    status, rows = strict(spark, [("us100",), (" US100 ",), ("US100",), ("DE40",)], "Symbol string", "TRADE_COUNT_BY_SYMBOL")
    assert len(rows) == 4 and "SYMBOL_VARIANTS" in status["warnings"]
    status, _ = strict(spark, [("a",)] * 3, "Symbol string", "TRADE_COUNT")
    assert status["duplicate_rows"] == 3
    status, rows = strict(spark, [("a",), ("b",)], "Symbol string", "MOST_TRADED_SYMBOL")
    assert rows == [("a", 1), ("b", 1)]
    status, rows = strict(spark, [("a",)], "Symbol string", "PROFIT_BY_DAY")
    assert status["status"] == "REQUIRED_COLUMN_MISSING" and rows == []


def test_half_even_display(spark):
    df = spark.createDataFrame([(1.005,), (1.015,), (0.1 + 0.2 + 0.3,), (1e30,), (None,)], "v double")
    found = [r[0] for r in df.select(two_places(F.col("v"))).collect()]
    assert found == ["1.00", "1.02", "0.60", "1" + "0" * 30 + ".00", None]


SUMS = {"tiny": [1e-11, 2e-11], "huge": [1e30, 1.0, -1e30], "wide": [1e308, 1e-320, -1e308, 5e-324], "tenths": [0.1] * 10, "none": [0.0, -0.0], "over": [1.7e308] * 3}


def test_sums_are_exact_in_any_order(spark):
    rows = [(k, v) for k, values in SUMS.items() for v in values] + [("tiny", None), ("odd", float("inf")), ("odd", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for dealt in (df, df.orderBy(F.desc("v")).repartition(5)):
        found = {r["k"]: r["exact_sum"] for r in exact_sums(dealt, ["k"], "v").collect()}
        assert found == {k: math.fsum(v) for k, v in SUMS.items() if k != "over"} | {"over": math.inf, "odd": math.inf}
    r = np.random.default_rng(4)
    values = (r.normal(size=3000) * 10.0 ** r.integers(-40, 40, 3000)).tolist()
    found = exact_sums(spark.createDataFrame([(v,) for v in values], "v double").repartition(6), [], "v").first()["exact_sum"]
    assert found == math.fsum(values)


def test_one_large_cell_spoils_no_journal(spark):
    status, rows = strict(spark, [("a", "1e30"), ("a", "1"), ("b", "0.00000000001"), ("b", "2e-11")], "Symbol string, Profit string", "PROFIT_BY_SYMBOL")
    assert status["status"] == "OK" and rows == [("a", 1e30), ("b", math.fsum([1e-11, 2e-11]))]


def test_digest_ignores_order(spark):
    df = profits(spark, range(50))
    one, other = (strict_queries.input_digest(d, ["Profit"]).first()["input_sha256"] for d in (df, df.orderBy(F.desc("Profit")).repartition(7)))
    changed = strict_queries.input_digest(profits(spark, range(51)), ["Profit"]).first()["input_sha256"]
    assert one == other != changed


def test_histogram_edges(spark):
    found = {r["bin"]: r["n"] for r in charts.histogram(profits(spark, [-40, 40, 0, 39.9]), ["journal_id"], "Profit").collect()}
    assert len(found) == 40 and (found[0], found[20], found[39]) == (1, 1, 2)


def test_pie_folds_small_slices(spark):
    df = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "k string, v long")
    found = {r["slice"]: (r["total"], r["largest"]) for r in charts.pie(df, [], "k", "v").collect()}
    assert found == {"a": (90, True), "b": (9, False), "Other": (1, False)}


def test_exports(spark, tmp_path):
    df = scoped(spark).withColumn("RR", F.lit(2.0))
    assert journals.export_rows(df, ["Date", "Symbol"], 2.5).count() == 0
    shown = {tuple(r) for r in journals.export_rows(df, ["Date", "Symbol", "Nope"], 2.0).collect()}
    assert {("2031-05-04 00:00", "Copper"), ("2031-05-05 00:00", ""), ("", "Copper")} <= shown
    versions.write(df.withColumn("row_ord", F.monotonically_increasing_id()), str(tmp_path / "kept"))
    assert versions.load(spark, str(tmp_path / "kept")).count() == 6
