"""Evidence packets: typed fields of retrieved documents, per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.retrieval import compatible
from tallyspark.session import settled

TRADE, KPI, DATASET = "TRADE_EVIDENCE", "KPI_EVIDENCE", "DATASET_CONTEXT"
REQUEST_VERSION, TASK_TYPE = "grounded-ai-request-v1", "EVIDENCE_SUMMARY"
MAX_ITEMS, MAX_QUESTION_CHARS, MAX_TEXT_CHARS = 10, 500, 80
# Evidence states that each type of document may have.
STATUSES = {
    TRADE: (
        "COMPUTED", "NO_MARKET_DATA", "NO_M1_EVIDENCE", "INVALID_TRADE_DATA", "TIMEZONE_AMBIGUOUS", "TIME_BASIS_INCONSISTENT", "INCOMPLETE_COVERAGE",
        "INVARIANT_VIOLATION",
    ),
    KPI: ("AUTHORITATIVE",), DATASET: ("NO_M1_EVIDENCE", "BOUND"),
}
# The fields a packet may hold: key, label, type, unit, document type.
FIELDS = [
    ("ticket", "Ticket", "IDENTIFIER", "", TRADE), ("symbol", "Symbol", "IDENTIFIER", "", TRADE), ("side", "Type", "ENUM", "", TRADE),
    ("open_time", "Open Time", "TIMESTAMP", "", TRADE), ("close_time", "Close Time", "TIMESTAMP", "", TRADE),
    ("entry", "Entry", "DECIMAL", "", TRADE), ("exit", "Exit", "DECIMAL", "", TRADE), ("profit", "Profit", "DECIMAL", "", TRADE),
    ("commission", "Commission", "DECIMAL", "", TRADE), ("swap", "Swap", "DECIMAL", "", TRADE),
    ("bar_evidence_status", "Bar Evidence Status", "ENUM", "", TRADE),
    ("approx_window_high", "Approx. Window High", "DECIMAL", "", TRADE), ("approx_window_low", "Approx. Window Low", "DECIMAL", "", TRADE),
    ("approx_mfe", "Approx. MFE", "DECIMAL", "price pts", TRADE), ("approx_mae", "Approx. MAE", "DECIMAL", "price pts", TRADE),
    ("total_trades", "Total Trades", "INTEGER", "", KPI), ("winning_trades", "Winning Trades", "INTEGER", "", KPI),
    ("losing_trades", "Losing Trades", "INTEGER", "", KPI), ("breakeven_trades", "Break-even Trades", "INTEGER", "", KPI),
    ("win_rate_pct", "Win Rate (%)", "DECIMAL", "%", KPI), ("total_profit", "Total Profit", "DECIMAL", "", KPI),
    ("average_profit", "Average Profit", "DECIMAL", "", KPI), ("gross_profit", "Gross Profit", "DECIMAL", "", KPI),
    ("gross_loss", "Gross Loss", "DECIMAL", "", KPI), ("average_win", "Average Win", "DECIMAL", "", KPI),
    ("average_loss", "Average Loss", "DECIMAL", "", KPI), ("profit_factor", "Profit Factor", "TEXT", "", KPI),
    ("expectancy", "Expectancy", "DECIMAL", "", KPI), ("best_trade", "Best Trade", "DECIMAL", "", KPI),
    ("worst_trade", "Worst Trade", "DECIMAL", "", KPI), ("max_drawdown", "Max Drawdown", "DECIMAL", "", KPI),
    ("sharpe", "Sharpe", "DECIMAL", "", KPI), ("volatility", "Volatility", "DECIMAL", "", KPI),
    ("journal_row_count", "Journal row count", "INTEGER", "", DATASET), ("declared_time_basis", "Declared time basis", "TEXT", "", DATASET),
]
# Content labels that never leave a journal.
PRIVATE_LABELS = ("tag", "tags", "notes", "comment", "comments", "strategy", "reason", "source filename", "market-data source")
EXCURSION_FIELDS = ("approx_window_high", "approx_window_low", "approx_mfe", "approx_mae")
LIMITATIONS = ("APPROXIMATE_M1_EVIDENCE", "EVIDENCE_UNAVAILABLE", "CROSS_SYMBOL_NOT_COMPARABLE", "PARTIAL_EVIDENCE")
# Forms of field values.
IDENTIFIER = r"^[A-Za-z0-9._-]{1,32}$"
INTEGER = r"^-?(?:0|[1-9][0-9]{0,15})$"
DECIMAL = r"^-?(?:0|[1-9][0-9]{0,15})(?:\.[0-9]{1,18})?$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
BROKER_TIME = r"^[0-9]{1,2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


def field_dictionary(spark: SparkSession) -> DataFrame:
    """The 35 authorised fields: small and fixed, so joins may broadcast it."""
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("field_key", "label", "value_type", "unit", "document_type"), f, strict=True))) for f in FIELDS))
    return spark.range(1).select(F.inline(listed))


def valid_value(value: Column, value_type: Column) -> Column:
    time = (value.rlike(ISO_TIME) & F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()) | (
        value.rlike(BROKER_TIME) & F.try_to_timestamp(value, F.lit("d MMM yyyy HH:mm:ss")).isNotNull()
    )
    return (
        F.when(value_type == "IDENTIFIER", value.rlike(IDENTIFIER)).when(value_type == "INTEGER", value.rlike(INTEGER))
        .when(value_type == "DECIMAL", value.rlike(DECIMAL)).when(value_type == "TIMESTAMP", time)
        .otherwise((value != "") & (F.char_length(value) <= MAX_TEXT_CHARS))
    )


def clean_question(question: Column) -> Column:
    """Compatibility forms folded, control characters gone, trimmed; null if empty or too long."""
    plain = F.trim(F.regexp_replace(compatible(question), r"\p{C}", ""))
    return F.when(F.char_length(plain).between(1, MAX_QUESTION_CHARS), plain)


def content_lines(results: DataFrame) -> DataFrame:
    """(request_id, rank, label, value): content split at the first ': '; private labels dropped, the last value wins."""
    rows = results.select("request_id", "rank", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    parts = F.split("line", ": ", 2)
    rows = rows.filter(F.size(parts) == 2).select("request_id", "rank", "pos", parts[0].alias("label"), F.trim(parts[1]).alias("value"))
    rows = rows.filter(~F.lower(F.trim("label")).isin(*PRIVATE_LABELS))
    return rows.groupBy("request_id", "rank", "label").agg(F.max_by("value", "pos").alias("value"))


def packet_fields(results: DataFrame) -> DataFrame:
    """Typed fields per (request_id, alias): field_key, label, value, value_type, unit, claimable, fault.

    ``results``: request_id, rank, document_type, evidence_status, content, symbol (of its provenance).
    """
    known = field_dictionary(results.sparkSession)
    items = results.select("request_id", "rank", "document_type", "evidence_status", "symbol")
    lines = content_lines(results).join(items, ["request_id", "rank"])
    joined = lines.join(F.broadcast(known), ["document_type", "label"], "left")
    excursion = F.col("field_key").isin(*EXCURSION_FIELDS)
    plain = F.when(excursion, F.regexp_replace("value", r" price pts$", "")).otherwise(F.col("value"))
    unknown = F.col("field_key").isNull()
    unused = F.coalesce(excursion, F.lit(False)) & (F.col("evidence_status") != "COMPUTED")
    fault = F.when(unused, None).when(unknown & (F.col("document_type") == KPI), "EVIDENCE_FIELD_INVALID").when(~unknown & ~F.coalesce(valid_value(plain, F.col("value_type")), F.lit(False)), "EVIDENCE_FIELD_INVALID")
    fault = F.coalesce(fault, F.when((F.col("field_key") == "symbol") & F.col("symbol").isNotNull() & (F.col("symbol") != F.col("value")), "REQUEST_MISMATCH"))
    told = joined.withColumns({"value": plain, "fault": fault}).filter((~unknown & ~unused) | F.col("fault").isNotNull())
    columns = ["request_id", "rank", "field_key", "label", "value", "value_type", "unit", "fault"]
    states = items.filter(F.col("document_type") == TRADE).select("request_id", "rank", F.lit("bar_evidence_status").alias("field_key"), F.lit("Bar Evidence Status").alias("label"), F.col("evidence_status").alias("value"), F.lit("ENUM").alias("value_type"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("fault"))
    named = told.filter("label = 'Symbol'").select("request_id", "rank")
    symbols = items.filter((F.col("document_type") == TRADE) & F.col("symbol").isNotNull()).join(named, ["request_id", "rank"], "left_anti").select("request_id", "rank", F.lit("symbol").alias("field_key"), F.lit("Symbol").alias("label"), F.col("symbol").alias("value"), F.lit("IDENTIFIER").alias("value_type"), F.lit("").alias("unit"), F.when(~F.col("symbol").rlike(IDENTIFIER), "EVIDENCE_FIELD_INVALID").alias("fault"))
    every = told.select(*columns).unionByName(states).unionByName(symbols)
    return every.withColumns({"alias": F.concat(F.lit("E"), F.col("rank").cast("string")), "claimable": F.col("value_type").isin("DECIMAL", "INTEGER")})


def packets(results: DataFrame, states: DataFrame, questions: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Per request: fault (null if sound), limitation codes, question, sha256 of the canonical request, what is secret.

    ``states``: request_id, state, candidate_count; ``questions``: request_id, question; ``fields``: of ``packet_fields``, where known.
    """
    fields = settled(packet_fields(results)) if fields is None else fields
    per = fields.groupBy("request_id").agg(
        F.min("fault").alias("field_fault"),
        F.bool_or(F.col("field_key").isin("approx_mfe", "approx_mae")).alias("approx"),
        F.sort_array(F.collect_list(F.struct("rank", "field_key", "value", "unit"))).alias("fields"),  # at most 10 items
    )
    measured = fields.filter(F.col("field_key").isin("approx_mfe", "approx_mae")).select("request_id", "rank").distinct()
    symbols = fields.filter("field_key = 'symbol'").join(measured, ["request_id", "rank"], "left_semi").groupBy("request_id").agg(F.count_distinct("value").alias("n_symbols"))
    shape = results.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"), F.count_distinct("journal_fingerprint").alias("prints"),
        F.bool_or(F.col("evidence_status") == "NO_MARKET_DATA").alias("unavailable"),
        F.min("journal_fingerprint").alias("journal_fingerprint"), F.array_sort(F.collect_set("document_id")).alias("document_ids"),  # at most 10
    )
    full = fields.filter(F.col("field_key").isin(*EXCURSION_FIELDS)).groupBy("request_id", "rank").agg(F.count_distinct("field_key").alias("k"))
    lacking = results.filter((F.col("document_type") == TRADE) & (F.col("evidence_status") == "COMPUTED")).join(full.filter(F.col("k") == 4), ["request_id", "rank"], "left_anti").select("request_id").distinct().withColumn("lacking", F.lit(True))
    c = F.col
    joined = questions.select("request_id", clean_question(c("question")).alias("question"))
    for part in (states, shape, per, symbols, lacking):
        joined = joined.join(part, "request_id", "left")
    fault = (
        F.when(~c("state").eqNullSafe(F.lit("OK")), "REQUEST_STATE_NOT_OK").when(F.coalesce("n", F.lit(0)) == 0, "REQUEST_EMPTY_EVIDENCE")
        .when(c("question").isNull() | (c("n") > MAX_ITEMS) | (c("last") != c("n")) | (c("ranks") != c("n")) | (c("prints") != 1), "REQUEST_MISMATCH")
        .when(c("lacking"), "EVIDENCE_FIELD_INVALID").otherwise(c("field_fault"))
    )
    limits = F.array_compact(
        F.array(
            F.when(c("approx"), LIMITATIONS[0]), F.when(c("unavailable"), LIMITATIONS[1]),
            F.when(c("n_symbols") > 1, LIMITATIONS[2]), F.when(c("candidate_count") > c("n"), LIMITATIONS[3]),
        )
    )
    request = F.to_json(F.struct(c("fields"), c("limitation_codes"), c("question"), F.lit(REQUEST_VERSION).alias("schema_version"), F.lit(TASK_TYPE).alias("task_type")))
    return joined.withColumns({"fault": fault, "limitation_codes": limits}).select("request_id", "question", "fault", "limitation_codes", F.sha2(request, 256).alias("request_sha256"), c("n").alias("n_items"), "journal_fingerprint", "document_ids", F.lit(REQUEST_VERSION).alias("schema_version"), F.lit(TASK_TYPE).alias("task_type"))


def integrity(fields: DataFrame, headers: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, verdict, sound) of each packet: OK, or the first rule that it breaks.

    ``items``: request_id, rank, document_type, evidence_status. The rules, in order: versions and
    task; at least one item and at most ``MAX_ITEMS``; aliases E1..En; per item a known type, a
    state that the type may have, some fields, none twice, each one authorised for the type and
    of its form, only numbers claimable; all four excursion fields where a trade is computed
    and none where it is not; the stated bar evidence is the item's; the limitation codes are those
    that the evidence asks for. PARTIAL_EVIDENCE rests on what was not taken, so it is
    free here. One row per item and request is shuffled.
    """
    known = field_dictionary(fields.sparkSession).select("field_key", F.col("value_type").alias("known_type"), F.col("document_type").alias("of_type"))
    c = F.col
    typed = fields.join(items.select("request_id", "rank", "document_type"), ["request_id", "rank"]).join(F.broadcast(known), "field_key", "left")
    # A status is an enumeration whose values the item's own state decides.
    formed = F.when(c("field_key") == "bar_evidence_status", F.lit(True)).otherwise(F.coalesce(valid_value(c("value"), c("value_type")), F.lit(False)))
    bad = ~F.coalesce((c("of_type") == c("document_type")) & (c("known_type") == c("value_type")), F.lit(False)) | ~formed | c("fault").isNotNull()
    bad |= c("claimable") & ~c("value_type").isin("DECIMAL", "INTEGER")
    excursion = c("field_key").isin(*EXCURSION_FIELDS)
    per_item = typed.groupBy("request_id", "rank").agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_distinct("field_key").alias("n_keys"), F.bool_or(bad).alias("bad"), F.min("alias").alias("a0"), F.max("alias").alias("a1"),
        F.count_distinct(F.when(excursion, c("field_key"))).alias("k"), F.max(F.when(c("field_key") == "bar_evidence_status", c("value"))).alias("told"),
        F.bool_or(c("field_key").isin("approx_mfe", "approx_mae")).alias("approx"), F.max(F.when(c("field_key") == "symbol", c("value"))).alias("symbol"),
    )
    item = items.select("request_id", "rank", "document_type", "evidence_status").join(per_item, ["request_id", "rank"], "left")
    trade, computed = c("document_type") == TRADE, c("evidence_status") == "COMPUTED"
    allowed = F.coalesce(*(F.when(c("document_type") == kind, c("evidence_status").isin(*states)) for kind, states in STATUSES.items()), F.lit(False))
    unfit = ~F.coalesce(allowed, F.lit(False)) | c("n_fields").isNull() | (c("n_fields") != c("n_keys")) | c("bad")
    unfit |= trade & F.when(computed, c("k") < len(EXCURSION_FIELDS)).otherwise(c("k") > 0)
    aliased = F.coalesce((c("a0") == c("a1")) & (c("a0") == F.concat(F.lit("E"), c("rank").cast("string"))), c("n_fields").isNull())
    approx = trade & computed & F.coalesce("approx", F.lit(False))
    found = item.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("last"), F.min("rank").alias("first"), F.bool_and(aliased).alias("aliased"),
        F.bool_or(F.coalesce(unfit, F.lit(True))).alias("unfit"), F.bool_or(trade & (c("told") != c("evidence_status"))).alias("untrue"), F.bool_or(approx).alias("approx"),
        F.bool_or(trade & (c("evidence_status") == "NO_MARKET_DATA")).alias("unavailable"), F.count_distinct(F.when(approx, c("symbol"))).alias("n_symbols"),
    )
    needs = F.array(*(F.struct(F.coalesce(on, F.lit(False)).alias("on"), F.lit(code).alias("code")) for on, code in ((c("approx"), LIMITATIONS[0]), (c("unavailable"), LIMITATIONS[1]), (c("n_symbols") > 1, LIMITATIONS[2]))))
    joined = headers.select("request_id", "limitation_codes", "schema_version", "task_type").join(found, "request_id", "left").withColumn("needs", needs)
    stated = lambda need: F.array_contains(F.coalesce("limitation_codes", F.array().cast("array<string>")), need["code"])
    unknown = F.exists("limitation_codes", lambda code: ~code.isin(*LIMITATIONS)) | (F.size("limitation_codes") != F.size(F.array_distinct("limitation_codes")))
    verdict = (
        F.when(~c("schema_version").eqNullSafe(F.lit(REQUEST_VERSION)) | ~c("task_type").eqNullSafe(F.lit(TASK_TYPE)), "SCHEMA_VERSION_MISMATCH")
        .when(c("items").isNull(), "REQUEST_EMPTY_EVIDENCE").when(c("items") > MAX_ITEMS, "SCHEMA_LIMIT_EXCEEDED")
        .when(~c("aliased") | (c("first") != 1) | (c("last") != c("items")) | (c("ranks") != c("items")), "REQUEST_MISMATCH")
        .when(c("unfit"), "EVIDENCE_FIELD_INVALID").when(c("untrue"), "STATUS_CONTRADICTION")
        .when(F.coalesce(unknown, F.lit(False)), "LIMITATION_UNKNOWN_CODE").when(F.exists("needs", lambda n: n["on"] & ~stated(n)), "LIMITATION_REQUIRED_MISSING")
        .when(F.exists("needs", lambda n: ~n["on"] & stated(n)), "STATUS_CONTRADICTION").otherwise("OK")
    )
    return joined.select("request_id", verdict.alias("verdict"), (verdict == "OK").alias("sound"))


def prompt(fields: DataFrame, headers: DataFrame) -> DataFrame:
    """(request_id, prompt): the question, then each item's fields in order."""
    line = F.concat(F.lit("- "), "label", F.lit(" ("), "field_key", F.lit("): "), "value", F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise(""))
    items = fields.filter("fault IS NULL").groupBy("request_id", "rank", "alias").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("field_key", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    whole = items.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), "alias", F.lit("]\n"), "body").alias("item")))), lambda x: x["item"]), "\n\n").alias("evidence"))
    return headers.join(whole, "request_id").select(
        "request_id",
        F.concat_ws("\n\n", F.concat(F.lit("Question: "), "question"), "evidence", F.concat(F.lit("Limitations: "), F.array_join("limitation_codes", ", "))).alias("prompt"),
    )
