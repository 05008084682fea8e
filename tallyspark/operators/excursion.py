"""Favourable and adverse excursion of trades within the bars of their holding window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import cleaning as C
from tallyspark.functions.digests import table_digest
from tallyspark.functions.timebasis import to_utc
from tallyspark.session import settled

# Limits and tolerances.
MAX_WINDOW_MINUTES = 10_080
DURATION_TOLERANCE_SECONDS = 1
EPSILON = 1e-9
CONTRACT_VERSION = "excursion-v1"

FLAGS = (
    "high_from_boundary_bar", "low_from_boundary_bar", "entry_outside_first_bar_range", "exit_outside_last_bar_range",
    "realised_outside_interval",
)
MEASURES = ("interval_high", "interval_low", "mfe", "mae")


def key_gate(journals: DataFrame, ticket: Column, journal: str = "journal_id", order_by: str = "row_ord", present: Column | None = None) -> DataFrame:
    """Per journal: OK, TICKET_COLUMN_MISSING, or the fault of its first row whose ticket is null, blank, invalid or repeated.

    ``present`` says whether the row's journal has a ticket column. Rows without a key are no twins and share no task.
    """
    present = F.lit(True) if present is None else present
    rows = journals.select(journal, order_by, ticket.cast("string").alias("raw"), present.alias("present")).withColumn("key", C.ticket(F.col("raw")))
    alone = F.when(F.col("key").isNull(), F.col(order_by))
    again = F.row_number().over(Window.partitionBy(journal, "key", alone).orderBy(order_by)) > 1
    reason = (
        F.when(F.col("raw").isNull(), "TICKET_NULL").when(F.trim("raw") == "", "TICKET_BLANK")
        .when(F.col("key").isNull(), "TICKET_INVALID").when(again, "DUPLICATE_TICKET")
    )
    found = rows.withColumn("reason", reason)
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col(order_by)))
    gate = F.when(~F.bool_or("present"), "TICKET_COLUMN_MISSING").otherwise(F.coalesce(first, F.lit("OK")))
    return found.groupBy(journal).agg(gate.alias("gate"))


def checked_trades(journals: DataFrame, bases: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Rows with ticket, parsed fields, UTC window and the first failed check.

    ``bases`` has (journal_id, kind, offset_minutes, zone), a row per journal. Columns
    are those of each journal's own header, dates are read by each column's form.
    Checks come in a fixed order: columns, open, close, symbol, side, entry, exit,
    duration, zones, order of the times, duration against the times. Each cell is read
    once, into a column of its own, before anything is judged.
    """
    names = {
        "open": C.OPEN_COLUMNS, "close": C.CLOSE_COLUMNS, "symbol": C.SYMBOL_COLUMNS, "side": C.SIDE_COLUMNS,
        "entry": C.ENTRY_COLUMNS, "exit": C.EXIT_COLUMNS, "duration": C.DURATION_COLUMNS, "ticket": C.TICKET_COLUMNS,
    }
    needed = ("open", "close", "symbol", "side", "entry", "exit")
    missing = F.coalesce(*(F.when(~C.own_any(journals, names[k]), f"MISSING_{k.upper()}") for k in needed), F.lit(None).cast("string"))
    cells = journals.select(
        journal, "row_ord", missing.alias("missing"), *(C.by_header(journals, v).alias(k) for k, v in names.items()),
        *(C.form_by_header(journals, names[k]).alias(f"{k}_form") for k in ("open", "close")),
    )
    rows = cells.join(bases.select(journal, "kind", "offset_minutes", "zone"), journal, "left")
    told = lambda k: F.coalesce(C.number(F.col(k)), F.lit(None).cast("double"))
    read = rows.select(
        journal, "row_ord", "missing", "ticket", "open", "close", "symbol", "side", "entry", "exit", "duration", "kind", "offset_minutes", "zone",
        *(C.local_time(F.col(k), F.col(f"{k}_form")).alias(f"{k}_local") for k in ("open", "close")),
        *(told(k).alias(f"{k}_number") for k in ("entry", "exit", "duration")),
    )
    positive = lambda k: F.when(F.col(f"{k}_number") > 0, F.col(f"{k}_number"))
    bad_price = lambda k: F.when(F.col(f"{k}_number") <= 0, f"NON_POSITIVE_{k.upper()}").when(F.col(f"{k}_number").isNull(), f"INVALID_{k.upper()}")
    blank = F.col("duration").isNull() | (F.trim("duration") == "") | F.lower(F.trim("duration")).isin("nan", "none")
    parsed = read.select(
        journal, "row_ord", "missing", C.ticket(F.col("ticket")).alias("ticket"),
        *(C.time_class(F.col(k), F.col(f"{k}_local")).alias(f"{k}_class") for k in ("open", "close")), "open_local", "close_local",
        C.symbol(F.col("symbol")).alias("symbol"), C.side(F.col("side")).alias("side"),
        *(positive(k).alias(k) for k in ("entry", "exit")), *(bad_price(k).alias(f"{k}_reason") for k in ("entry", "exit")),
        F.when(blank, "skip").when(F.col("duration_number") >= 0, "ok").otherwise("invalid").alias("duration_class"), F.col("duration_number").alias("duration"),
        "kind", "offset_minutes", "zone",
    )
    basis = [F.col("kind"), F.col("offset_minutes"), F.col("zone")]
    parsed = parsed.withColumns({"o": to_utc(F.col("open_local"), *basis), "c": to_utc(F.col("close_local"), *basis)})
    seconds = F.timestamp_diff("SECOND", F.col("o.utc"), F.col("c.utc"))
    bad = lambda k: (
        F.when(F.col(f"{k}_class") == "aware", "AWARE_TIMESTAMP").when(F.col(f"{k}_class") != "ok", f"INVALID_{k.upper()}")
    )
    reason = F.coalesce(
        "missing",
        bad("open"), bad("close"),
        F.when(F.col("symbol").isNull(), "BLANK_SYMBOL"), F.when(F.col("side").isNull(), "INVALID_SIDE"),
        F.when(F.col("entry").isNull(), F.col("entry_reason")), F.when(F.col("exit").isNull(), F.col("exit_reason")),
        F.when(F.col("duration_class") == "invalid", "INVALID_DURATION"),
        *(F.when(F.col(f"{x}.verdict") != "VALID", F.concat(F.col(f"{x}.verdict"), F.lit("_LOCAL_TIME"))) for x in ("o", "c")),
        F.when(F.col("c.utc") < F.col("o.utc"), "CLOSE_BEFORE_OPEN"),
        F.when(F.abs(seconds - F.col("duration")) > DURATION_TOLERANCE_SECONDS, "DURATION_MISMATCH"),
    )
    status = (
        F.when(F.col("kind").isNull(), "TIME_BASIS_UNDECLARED")
        .when(F.col("reason") == "DURATION_MISMATCH", "TIME_BASIS_INCONSISTENT")
        .when(F.col("reason").startswith("AMBIGUOUS"), "AMBIGUOUS_LOCAL_TIME").when(F.col("reason").startswith("NONEXISTENT"), "NONEXISTENT_LOCAL_TIME")
        .when(F.col("reason").isNotNull(), "INVALID_TRADE_DATA")
    )
    return parsed.withColumn("reason", reason).select(
        journal, "row_ord", "ticket", "symbol", "side", "entry", "exit",
        F.col("o.utc").alias("open_utc"), F.col("c.utc").alias("close_utc"), "reason", status.alias("status"),
    )


def window_join(
    trades: DataFrame, bars: DataFrame, keys: list[str], step_seconds: int = 60, levels: Sequence[int] = (1, 16, 256, 4096)
) -> DataFrame:
    """Evidence of trades (keys, symbol, side, entry, exit, open_utc, close_utc) over bars (symbol, ts, high, low).

    The interval join is an equi-join on (symbol, level, bucket). Bars are
    summarised at several levels, of 1, 16, 256 and 4096 bars a bucket; a window is
    dealt to the largest buckets that lie wholly inside it, from its ends inwards,
    so it meets at most 30 rows a level below the top, and as many of the top as
    its limit allows. Maxima, minima and counts compose, so the result is that of
    all its bars. The two boundary bars are looked up by themselves.
    """
    step = step_seconds
    floor = lambda t: F.unix_timestamp(t) - F.pmod(F.unix_timestamp(t), F.lit(step))
    limit = MAX_WINDOW_MINUTES * 60
    placed = trades.withColumns({"w0": floor("open_utc"), "w1": floor("close_utc")})
    placed = placed.withColumn("bars_expected", ((F.col("w1") - F.col("w0")) / step).cast("long") + 1)
    flat = bars.select("symbol", floor("ts").alias("t"), "high", "low")
    ranges = flat.groupBy("symbol").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    placed = placed.join(ranges, "symbol", "left")
    reason = (
        F.when(F.col("first_t").isNull(), "NO_MARKET_DATA").when(F.col("w1") - F.col("w0") > limit, "WINDOW_EXCEEDS_LIMIT")
        .when((F.col("w0") < F.col("first_t")) | (F.col("w1") > F.col("last_t")), "OUTSIDE_FILE_RANGE")
    )
    placed = placed.withColumn("reason", reason)
    live = placed.filter("reason IS NULL").select(*keys, "symbol", "w0", "w1")
    # Buckets [first, stop) of each level, cut to what no higher level covers: what is left of it lies at the window's two ends.
    inside = {}
    for n in levels:
        size = n * step
        inside[n] = (F.ceil(F.col("w0") / size), F.floor((F.col("w1") + step) / size))
    pieces = []
    for i, n in enumerate(levels):
        first, stop = inside[n]
        span = lambda a, z: F.when(z > a, F.sequence(a, z - 1)).otherwise(F.array().cast("array<bigint>"))
        if i + 1 < len(levels):
            ratio = levels[i + 1] // n
            up_first, up_stop = (x * ratio for x in inside[levels[i + 1]])
            some = up_stop > up_first
            listed = F.when(some, F.concat(span(first, up_first), span(up_stop, stop))).otherwise(span(first, stop))
        else:
            listed = span(first, stop)
        pieces.append(F.arrays_zip(F.array_repeat(F.lit(n), F.size(listed)).alias("level"), listed.alias("b")))
    spread = live.select(*keys, "symbol", F.explode(F.flatten(F.array(*pieces))).alias("at")).select(*keys, "symbol", "at.*")
    by_level = flat.withColumn("at", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("t") / (n * step)).alias("b")) for n in levels))))
    summary = by_level.groupBy("symbol", "at.level", "at.b").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))
    within = spread.join(summary, ["symbol", "level", "b"]).select(
        *keys, "high", "low", "n", *(F.lit(None).cast("double").alias(c) for c in ("h0", "l0", "h1", "l1"))
    )
    at = lambda side, c: F.when(F.col("t") == F.col(side), F.col(c))
    ends = live.withColumn("t", F.explode(F.array_distinct(F.array("w0", "w1")))).join(flat, ["symbol", "t"]).select(
        *keys, F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"), F.lit(0).cast("long").alias("n"),
        at("w0", "high").alias("h0"), at("w0", "low").alias("l0"), at("w1", "high").alias("h1"), at("w1", "low").alias("l1"),
    )
    found = within.unionByName(ends).groupBy(*keys).agg(
        F.max("high").alias("interval_high"), F.min("low").alias("interval_low"), F.sum("n").alias("bars_used"),
        *(F.max(c).alias(c) for c in ("h0", "l0", "h1", "l1")),
    )
    joined = placed.join(found, keys, "left").withColumn("bars_used", F.coalesce("bars_used", F.lit(0)))
    reason = F.coalesce(
        "reason",
        F.when(F.col("h0").isNull() | F.col("h1").isNull(), "BOUNDARY_BAR_MISSING"),
        F.when(F.col("bars_used") < F.col("bars_expected"), "INTERIOR_GAP"),
    )
    high, low, entry = F.col("interval_high"), F.col("interval_low"), F.col("entry")
    buy = F.col("side") == "buy"
    mfe = F.greatest(F.lit(0.0), F.when(buy, high - entry).otherwise(entry - low))
    mae = F.least(F.lit(0.0), F.when(buy, low - entry).otherwise(entry - high))
    realised = F.when(buy, F.col("exit") - entry).otherwise(entry - F.col("exit"))
    near = lambda a, b: F.abs(a - F.col(b)) <= EPSILON
    out = lambda v, lo, hi: (v < F.col(lo) - EPSILON) | (v > F.col(hi) + EPSILON)
    flags = {
        "high_from_boundary_bar": near(high, "h0") | near(high, "h1"),
        "low_from_boundary_bar": near(low, "l0") | near(low, "l1"),
        "entry_outside_first_bar_range": out(entry, "l0", "h0"),
        "exit_outside_last_bar_range": out(F.col("exit"), "l1", "h1"),
        "realised_outside_interval": (realised < mae - EPSILON) | (realised > mfe + EPSILON),
    }
    broken = (high + EPSILON < low) | (mfe < -EPSILON) | (mae > EPSILON)
    judged = joined.withColumn("reason", F.coalesce(reason, F.when(broken, "INVARIANT_FAILED")))
    r = F.col("reason")
    status = F.when(r.isNull(), "COMPUTED").when(r == "NO_MARKET_DATA", r).when(r == "INVARIANT_FAILED", "INVARIANT_VIOLATION").otherwise("INCOMPLETE_COVERAGE")
    done = r.isNull()
    counted = done | r.isin("BOUNDARY_BAR_MISSING", "INTERIOR_GAP", "INVARIANT_FAILED")
    return judged.select(
        *keys, status.alias("status"), "reason",
        *(F.when(done, v).alias(k) for k, v in zip(MEASURES, (high, low, mfe, mae), strict=True)),
        F.when(counted, F.col("bars_used")).alias("bars_used"), F.when(r.isNull() | (r != "NO_MARKET_DATA"), F.col("bars_expected")).alias("bars_expected"),
        *(F.coalesce(F.when(done, v), F.lit(False)).alias(k) for k, v in flags.items()),
    )


def evidence(journals: DataFrame, bases: DataFrame, bars: DataFrame, journal: str = "journal_id", step_seconds: int = 60) -> DataFrame:
    """One evidence row per trade over bars of ``step_seconds``; a journal without usable tickets has the gate's fault on every row."""
    keys = [journal, "row_ord", "ticket"]
    trades = checked_trades(journals, bases, journal)
    gate = key_gate(journals, C.by_header(journals, C.TICKET_COLUMNS), journal, present=C.own_any(journals, C.TICKET_COLUMNS))
    # Written once: a filter on the status below would otherwise be rewritten in terms of every parsing step.
    trades = settled(trades.join(gate, journal)).withColumns(
        {
            "status": F.when(F.col("gate") != "OK", "JOIN_KEY_UNAVAILABLE").otherwise(F.col("status")),
            "reason": F.when(F.col("gate") != "OK", F.col("gate")).otherwise(F.col("reason")),
        }
    )
    valid = window_join(trades.filter("status IS NULL").drop("reason", "status", "gate"), bars, keys, step_seconds)
    none = {k: F.lit(None).cast("double") for k in MEASURES} | {k: F.lit(None).cast("long") for k in ("bars_used", "bars_expected")}
    failed = trades.filter("status IS NOT NULL").select(*keys, "status", "reason", *(v.alias(k) for k, v in none.items()), *(F.lit(False).alias(f) for f in FLAGS))
    return valid.unionByName(failed)


def counts(found: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Per journal: status and reason counts as maps, and the trades that met bars."""
    maps = []
    for column in ("status", "reason"):
        n = found.filter(F.col(column).isNotNull()).groupBy(journal, column).agg(F.count(F.lit(1)).alias("n"))
        maps.append(n.groupBy(journal).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts")))
    matched = found.groupBy(journal).agg(F.count_if(F.col("status").isin("COMPUTED", "INCOMPLETE_COVERAGE", "INVARIANT_VIOLATION")).alias("matched"))
    return matched.join(maps[0], journal, "left").join(maps[1], journal, "left")


def fingerprint(journals: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Order-independent digest of ticket, times, symbol, side, prices and duration, in the columns of each journal's own header; profit and notes do not count."""
    used = (C.TICKET_COLUMNS, C.OPEN_COLUMNS, C.CLOSE_COLUMNS, C.SYMBOL_COLUMNS, C.SIDE_COLUMNS, C.ENTRY_COLUMNS, C.EXIT_COLUMNS, C.DURATION_COLUMNS)
    ticket, *texts = (C.by_header(journals, names) for names in used)
    cells = [C.ticket(ticket), *map(C.text, texts[:4]), *(F.coalesce(C.number(c).cast("string"), C.text(c)) for c in texts[4:])]
    named = [F.coalesce(C.name_by_header(journals, names), F.lit("")) for names in used]
    return table_digest(journals, [journal], [c.cast("string") for c in (*cells, *named)], "journal_fingerprint")


def attach(journals: DataFrame, found: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Evidence beside each row by canonical ticket; no match gives null measures and false flags."""
    right = found.drop("row_ord").withColumnRenamed("ticket", "_ticket").withColumnsRenamed({c: f"excursion_{c}" for c in ("status", "reason", *MEASURES, "bars_used", "bars_expected", *FLAGS)})
    left = journals.withColumn("_ticket", C.ticket(C.by_header(journals, C.TICKET_COLUMNS)))
    joined = left.join(right, [journal, "_ticket"], "left").drop("_ticket")
    return joined.withColumns({f"excursion_{f}": F.coalesce(f"excursion_{f}", F.lit(False)) for f in FLAGS})


def bound(found: DataFrame, fingerprints: DataFrame, market_sha256: str, bases: DataFrame, journal: str = "journal_id") -> DataFrame:
    """The evidence table with what it is bound to."""
    return found.join(fingerprints.select(journal, "journal_fingerprint"), journal).join(bases, journal).withColumns(
        {"market_sha256": F.lit(market_sha256), "contract_version": F.lit(CONTRACT_VERSION)}
    )


def still_valid(stored: DataFrame, fingerprints: DataFrame, journal: str = "journal_id") -> tuple[DataFrame, DataFrame]:
    """(valid rows, stale rows) of stored evidence under today's fingerprints and contract."""
    now = fingerprints.select(journal, "journal_fingerprint").withColumn("contract_version", F.lit(CONTRACT_VERSION))
    on = [journal, "journal_fingerprint", "contract_version"]
    return stored.join(now, on, "left_semi"), stored.join(now, on, "left_anti")
