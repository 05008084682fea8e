"""Bars, time bases, excursion evidence, review text and manual trades."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.timebasis import create_time_basis, to_utc
from tallyspark.operators import bars as B
from tallyspark.operators import excursion, manual, review

BARS = [("b", f"2026-06-25T10:{30 + i}:00Z", "US100.cash", "100", str(110 + i), str(90 - i), "101") for i in range(5)]
BAR_SCHEMA = "bar_set_id string, TimestampUTC string, Symbol string, Open string, High string, Low string, Close string"
TRADE = {"journal_id": "j", "row_ord": 1, "Ticket": "1", "Open Time": "2026-06-25 10:30:15", "Close Time": "2026-06-25 10:32:47", "Symbol": "US100.cash", "Type": "buy", "Entry": "100", "Exit": "105", "Profit": "50"}


def bars(spark, rows=BARS):
    return B.parse(spark.createDataFrame(rows, BAR_SCHEMA))


def basis(spark, kind="UTC", offset=None, zone=None):
    return spark.createDataFrame([("j", kind, offset, zone)], "journal_id string, kind string, offset_minutes int, zone string")


def one(spark, changes=(), where=None, basis_of=("UTC", None, None), more=()):
    rows = [TRADE | dict(changes), *({**TRADE, **dict(m)} for m in more)]
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = ", ".join(f"`{k}` {'long' if k == 'row_ord' else 'string'}" for k in names)
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], kinds)
    found = excursion.evidence(df, basis(spark, *basis_of), where if where is not None else bars(spark).drop("reason"))
    return found.orderBy("row_ord").collect()


def test_computed(spark):
    r = one(spark)[0]
    assert (r["status"], r["interval_high"], r["interval_low"], r["mfe"], r["mae"], r["bars_used"], r["bars_expected"]) == ("COMPUTED", 112.0, 88.0, 12.0, -12.0, 3, 3)
    assert r["high_from_boundary_bar"] and r["low_from_boundary_bar"] and not r["realised_outside_interval"]


CASES = [
    ({"Open Time": "bad"}, "INVALID_TRADE_DATA", "INVALID_OPEN"), ({"Close Time": "2026-06-25 10:32:47Z"}, "INVALID_TRADE_DATA", "AWARE_TIMESTAMP"),
    ({"Symbol": " "}, "INVALID_TRADE_DATA", "BLANK_SYMBOL"), ({"Type": "hold"}, "INVALID_TRADE_DATA", "INVALID_SIDE"),
    ({"Entry": "abc"}, "INVALID_TRADE_DATA", "INVALID_ENTRY"), ({"Entry": "0"}, "INVALID_TRADE_DATA", "NON_POSITIVE_ENTRY"),
    ({"Exit": "-1"}, "INVALID_TRADE_DATA", "NON_POSITIVE_EXIT"), ({"Close Time": "2026-06-25 10:00:00"}, "INVALID_TRADE_DATA", "CLOSE_BEFORE_OPEN"),
    ({"Symbol": "EURUSD"}, "NO_MARKET_DATA", "NO_MARKET_DATA"), ({"Close Time": "2026-06-25 10:40:00"}, "INCOMPLETE_COVERAGE", "OUTSIDE_FILE_RANGE"),
    ({"Close Time": "2026-07-02 10:31:00"}, "INCOMPLETE_COVERAGE", "WINDOW_EXCEEDS_LIMIT"),
    ({"Trade duration in seconds": "152"}, "COMPUTED", None), ({"Trade duration in seconds": "153"}, "COMPUTED", None),
    ({"Trade duration in seconds": "154"}, "TIME_BASIS_INCONSISTENT", "DURATION_MISMATCH"), ({"Trade duration in seconds": "x"}, "INVALID_TRADE_DATA", "INVALID_DURATION"),
]


def test_precedence(spark):
    more = [{**changes, "row_ord": i + 2, "Ticket": f"t{i}"} for i, (changes, _, _) in enumerate(CASES)]
    found = one(spark, more=more)[1:]
    assert [(r["status"], r["reason"]) for r in found] == [(s, why) for _, s, why in CASES]
    assert all((r["mfe"] is None) == (r["status"] != "COMPUTED") for r in found)


def test_gaps_in_bars(spark):
    gap = bars(spark, [b for b in BARS if ":31:" not in b[1]]).drop("reason")
    assert one(spark, where=gap)[0]["reason"] == "INTERIOR_GAP"
    edge = bars(spark, [b for b in BARS if ":32:" not in b[1]]).drop("reason")
    assert one(spark, where=edge)[0]["reason"] == "BOUNDARY_BAR_MISSING"


def test_key_gate(spark):
    found = one(spark, more=[{"Ticket": "1.0", "row_ord": 2}])
    assert {(r["status"], r["reason"]) for r in found} == {("JOIN_KEY_UNAVAILABLE", "DUPLICATE_TICKET")}
    assert one(spark, {"Ticket": " "})[0]["reason"] == "TICKET_BLANK"


def test_long_windows_use_whole_buckets(spark):
    start = dt.datetime(2026, 1, 1, 22, 30)
    rows = [("S", start + dt.timedelta(minutes=i), 100.0 + i % 700, 50.0 - i % 33) for i in range(3000)]
    where = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double")
    trades = spark.createDataFrame([(1, "S", "buy", 100.0, 105.0, start, rows[-1][1]), (2, "S", "sell", 60.0, 50.0, rows[90][1], rows[1529][1])], "k int, symbol string, side string, entry double, exit double, open_utc timestamp, close_utc timestamp")
    found = {r["k"]: r for r in excursion.window_join(trades, where, ["k"]).collect()}
    for k, part in ((1, rows), (2, rows[90:1530])):
        assert found[k]["status"] == "COMPUTED" and found[k]["bars_used"] == len(part)
        assert (found[k]["interval_high"], found[k]["interval_low"]) == (max(p[2] for p in part), min(p[3] for p in part))


def test_zones(spark):
    walls = [("2026-07-15 12:00:00", "VALID", dt.datetime(2026, 7, 15, 11)), ("2026-10-25 01:30:00", "AMBIGUOUS", None), ("2026-03-29 01:30:00", "NONEXISTENT", None)]
    df = spark.createDataFrame([(w,) for w, _, _ in walls], "w string").select(to_utc(F.col("w").cast("timestamp"), F.lit("IANA"), F.lit(None).cast("int"), F.lit("Europe/London")).alias("f"))
    found = df.select(F.col("f.verdict"), F.col("f.utc").cast("timestamp_ntz")).collect()
    assert [(r[0], r[1]) for r in found] == [(v, u) for _, v, u in walls]


def test_basis_declarations():
    assert create_time_basis("FIXED_OFFSET", 330)["offset_minutes"] == 330
    for bad in (("FIXED_OFFSET", 7, None), ("FIXED_OFFSET", 855, None), ("IANA", None, "Nowhere/Town"), ("UTC", 0, None), ("X", None, None)):
        with pytest.raises(ValueError):
            create_time_basis(*bad)


REASONS = [
    (1, "2026-06-25T10:30:00+02:00", "NON_UTC_TIMESTAMP"), (1, "junk", "INVALID_TIMESTAMP"), (1, "2026-06-25T10:30:05Z", "TIMESTAMP_NOT_MINUTE_ALIGNED"),
    (2, " ", "EMPTY_SYMBOL"), (2, "x" * 65, "SYMBOL_TOO_LONG"), (4, "abc", "INVALID_OHLC"), (5, "0", "NON_POSITIVE_OHLC"), (4, "99", "IMPOSSIBLE_OHLC"),
]


def test_bar_reasons(spark):
    rows = []
    for i, (at, value, _) in enumerate(REASONS):
        first = list(BARS[0])
        first[at] = value
        rows += [(f"s{i}", *b[1:]) for b in (first, *BARS[1:])]
    checked = bars(spark, rows)
    assert {r["bar_set_id"]: r["verdict"] for r in B.verdicts(checked).collect()} == {f"s{i}": why for i, (_, _, why) in enumerate(REASONS)}
    assert B.clean_bars(checked).count() == 0


def test_bar_verdicts(spark):
    sets = {"OK": BARS, "DUPLICATE_BAR": [*BARS, BARS[0]], "M1_RESOLUTION_UNCONFIRMED": BARS[::2], "TOO_FEW_ROWS": BARS[:1]}
    checked = bars(spark, [(name, *b[1:]) for name, rows in sets.items() for b in rows])
    assert all(r["bar_set_id"] == r["verdict"] for r in B.verdicts(checked).collect())


def test_attach_and_fingerprint(spark):
    df = spark.createDataFrame([tuple(TRADE.values())], ", ".join(f"`{k}` {'long' if k == 'row_ord' else 'string'}" for k in TRADE))
    found = excursion.evidence(df, basis(spark), bars(spark).drop("reason"))
    joined = excursion.attach(df, found).first()
    assert joined["excursion_mfe"] == 12.0 and joined["excursion_high_from_boundary_bar"]
    same = excursion.fingerprint(df.withColumn("Profit", F.lit("7"))).first()["journal_fingerprint"]
    assert same == excursion.fingerprint(df).first()["journal_fingerprint"] != excursion.fingerprint(df.withColumn("Exit", F.lit("7"))).first()["journal_fingerprint"]
    assert excursion.counts(found).first()["status_counts"] == {"COMPUTED": 1}


def test_display_text(spark):
    volumes = {"1.50": "1.5", "0.004": "<0.01", "-0.004": ">-0.01", "0.005": "0.01", "0": "0", None: "", "10": "10", "x": ""}
    df = spark.createDataFrame([(k,) for k in volumes], "v string")
    assert [r[0] for r in df.select(review.volume_text(F.col("v"))).collect()] == list(volumes.values())
    moves = [(5.0, "pips", "+5 pips"), (-0.1, "price pts", "-0.1 price pts"), (0.0, "pips", "0 pips"), (None, "pips", "")]
    df = spark.createDataFrame([m[:2] for m in moves], "v double, l string")
    assert [r[0] for r in df.select(review.movement_text(F.col("v"), F.col("l"))).collect()] == [m[2] for m in moves]


def test_sort_keeps_nulls_last(spark):
    rows = [("j", 1, "3", "5"), ("j", 2, "2", None), ("j", 3, "1", "5"), ("j", 4, "4", "nan"), ("j", 5, "5", "-1")]
    df = spark.createDataFrame(rows, "journal_id string, row_ord long, Ticket string, Profit string")
    up = [r["row_ord"] for r in review.page(df, "profit").orderBy("place").collect()]
    down = [r["row_ord"] for r in review.page(df, "profit", descending=True).orderBy("place").collect()]
    assert up == [5, 3, 1, 2, 4] and down == [3, 1, 5, 2, 4]


def test_manual_trades(spark):
    t = dt.datetime(2026, 1, 1)
    d = Decimal
    rows = [
        ("LONG", "CLOSED", d(2), d(100), d(110), d(90), d(120), d(1), t, t + dt.timedelta(minutes=90)), ("SHORT", "CLOSED", d(2), d(100), d(90), d(110), d(80), d(1), t, t),
        ("LONG", "OPEN", d(2), d(100), d(110), d(105), d(120), d(1), t, None),
    ]
    schema = "side string, status string, quantity decimal(20,8), entry_price decimal(20,8), exit_price decimal(20,8), stop_loss decimal(20,8), take_profit decimal(20,8), fees decimal(12,2), open_time timestamp, close_time timestamp"
    found = manual.measures(spark.createDataFrame(rows, schema)).collect()
    assert [r["rr"] for r in found] == [2.0, 2.0, None]
    assert [r["realized_pnl"] and float(r["realized_pnl"]) for r in found] == [19.0, 19.0, None]
    assert found[0]["duration_minutes"] == 90 and found[0]["rr_band"] == "Good"
