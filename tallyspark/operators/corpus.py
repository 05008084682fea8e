"""Evidence documents of trades, measures and data sets, with integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import cleaning as C
from tallyspark.operators import review as R

TRADE, KPI, DATASET = "TRADE_EVIDENCE", "KPI_EVIDENCE", "DATASET_CONTEXT"
# Identity keys that provenance must not hold at any depth.
OWNER_KEYS = ("owner_id", "user_id")
CORPUS_VERSION = "evidence-corpus-v1"
CROSS_SYMBOL = "Price points are not comparable across symbols."

COLUMNS = [
    "journal_id", "document_id", "document_type", "journal_fingerprint", "source_record_key", "content", "content_sha256",
    "evidence_status", "symbol", "provenance", "corpus_version",
]


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))


def _plain(value: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return R.evidence_text(value)
    if kind.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return C.text(value)


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"content_sha256": F.sha2("content", 256), "corpus_version": F.lit(CORPUS_VERSION)}).select(*COLUMNS)


def trade_documents(journals: DataFrame, source: Column | None = None) -> DataFrame:
    """A document per trade. ``journals`` carries journal_fingerprint and, if bound, evidence columns.

    Fields are those of each journal's own header. Empty fields leave no line; notes, tags
    and strategies never enter.
    """
    df = R.enrich(journals)
    listed = [
        ("Symbol", C.SYMBOL_COLUMNS), ("Type", C.SIDE_COLUMNS), ("Open Time", C.OPEN_COLUMNS), ("Close Time", C.CLOSE_COLUMNS),
        ("Entry", C.ENTRY_COLUMNS), ("Exit", C.EXIT_COLUMNS), ("Profit", ("Profit",)), ("Commission", ("Commission", "Commissions")), ("Swap", ("Swap",)),
    ]
    key = C.ticket(C.by_header(df, C.TICKET_COLUMNS))
    bound = "excursion_status" in df.columns
    status = F.coalesce("excursion_status", F.lit("NO_MARKET_DATA")) if bound else F.lit("NO_M1_EVIDENCE")
    df = df.withColumns({"_key": key, "_status": status, "_label": R.status_label(status)}).filter(F.col("_key").isNotNull())
    key, status, label_text = F.col("_key"), F.col("_status"), F.col("_label")
    lines = [_line("Ticket", key), *(_line(k, C.by_header(df, names, _plain)) for k, names in listed)]
    lines.append(_line("Realised movement", R.movement_text(F.col("movement_value"), F.col("movement_label"))))
    lines.append(F.when(F.col("movement_disagreement"), R.calculated_note(F.col("movement_calculated"))))
    lines.append(_line("Bar Evidence", label_text))
    for label, name, unit in (("Approx. Window High", "interval_high", ""), ("Approx. Window Low", "interval_low", ""), ("Approx. MFE", "mfe", " price pts"), ("Approx. MAE", "mae", " price pts")):
        shown = F.concat(R.evidence_text(F.col(f"excursion_{name}")), F.lit(unit)) if bound else F.lit("")
        lines.append(F.concat(F.lit(f"{label}: "), F.when(status == "COMPUTED", shown).otherwise(F.concat(F.lit("Unavailable ("), label_text, F.lit(")")))))
    symbol = C.symbol(C.by_header(df, C.SYMBOL_COLUMNS))
    provenance = F.to_json(F.struct("journal_fingerprint", F.lit(TRADE).alias("document_type"), key.alias("source_record_key"), (source if source is not None else F.lit(None).cast("string")).alias("source"), status.alias("bar_evidence_status"), symbol.alias("symbol")))
    return _finished(
        df.select(
            "journal_id", F.concat(F.lit(f"{TRADE}:ticket:"), key).alias("document_id"), F.lit(TRADE).alias("document_type"),
            "journal_fingerprint", key.alias("source_record_key"), F.concat_ws("\n", *lines).alias("content"),
            status.alias("evidence_status"), symbol.alias("symbol"), provenance.alias("provenance"),
        )
    )


def kpi_documents(rendered: DataFrame, fingerprints: DataFrame) -> DataFrame:
    rows = rendered.join(fingerprints.select("journal_id", "journal_fingerprint"), "journal_id")
    provenance = F.to_json(F.struct("journal_fingerprint", F.lit(KPI).alias("document_type"), F.col("metric").alias("source_record_key")))
    return _finished(
        rows.select(
            "journal_id", F.concat(F.lit(f"{KPI}:kpi:"), "metric").alias("document_id"), F.lit(KPI).alias("document_type"), "journal_fingerprint",
            F.col("metric").alias("source_record_key"), F.concat_ws(": ", "metric", "value").alias("content"),
            F.lit("AUTHORITATIVE").alias("evidence_status"), F.lit(None).cast("string").alias("symbol"), provenance.alias("provenance"),
        )
    )


def dataset_documents(journals: DataFrame, fingerprints: DataFrame, bases: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """One document per journal: row count, file, availability of bars, declared basis, a standing warning."""
    rows = journals.groupBy("journal_id").agg(F.count(F.lit(1)).alias("n")).join(fingerprints.select("journal_id", "journal_fingerprint"), "journal_id")
    bound = bases is not None
    if bound:
        rows = rows.join(bases.select("journal_id", "kind", "offset_minutes", "zone"), "journal_id", "left")
        basis = F.when(F.col("kind") == "FIXED_OFFSET", F.format_string("FIXED_OFFSET (%+d minutes)", F.col("offset_minutes").cast("int"))).when(F.col("kind") == "IANA", F.format_string("IANA (%s)", F.col("zone"))).otherwise(F.col("kind"))
    else:
        basis = F.lit(None).cast("string")
    name = C.basename(F.lit(source)) if source else F.lit(None).cast("string")
    lines = [
        _line("Journal row count", F.col("n").cast("string")), _line("Source filename", name),
        _line("Journal evidence availability", F.lit("Bound" if bound else "No M1 evidence")), _line("Declared time basis", basis), F.lit(CROSS_SYMBOL),
    ]
    provenance = F.to_json(F.struct("journal_fingerprint", F.lit(DATASET).alias("document_type"), name.alias("source")))
    return _finished(
        rows.select(
            "journal_id", F.lit(f"{DATASET}:journal").alias("document_id"), F.lit(DATASET).alias("document_type"), "journal_fingerprint",
            F.lit("journal").alias("source_record_key"), F.concat_ws("\n", *lines).alias("content"),
            F.lit("BOUND" if bound else "NO_M1_EVIDENCE").alias("evidence_status"), F.lit(None).cast("string").alias("symbol"), provenance.alias("provenance"),
        )
    )


def build(trades: DataFrame, kpi: DataFrame, dataset: DataFrame) -> DataFrame:
    return trades.unionByName(kpi).unionByName(dataset)


def integrity(documents: DataFrame) -> DataFrame:
    """Per journal: OK or the first fault of its documents."""
    blank = F.lit(False)
    for c in ("document_id", "document_type", "journal_fingerprint", "source_record_key", "content", "evidence_status"):
        blank |= F.col(c).isNull() | (F.trim(c) == "")
    private = F.col("provenance").rlike('"(' + "|".join(OWNER_KEYS) + ')"\\s*:')
    by_id = documents.groupBy("journal_id", "document_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(blank).alias("blank"), F.bool_or(private).alias("private"),
        F.bool_or(F.col("corpus_version") != CORPUS_VERSION).alias("version"), F.bool_or(~F.col("document_type").isin(TRADE, KPI, DATASET)).alias("type"),
        F.bool_or(F.sha2("content", 256) != F.col("content_sha256")).alias("hash"), F.min("journal_fingerprint").alias("f0"), F.max("journal_fingerprint").alias("f1"),
        F.count_if(F.col("document_type") == DATASET).alias("datasets"),
    )
    found = by_id.groupBy("journal_id").agg(
        F.sum("n").alias("n_documents"), F.max("n").alias("n"), *(F.bool_or(c).alias(c) for c in ("blank", "private", "version", "type", "hash")),
        F.min("f0").alias("f0"), F.max("f1").alias("f1"), F.sum("datasets").alias("datasets"),
    )
    verdict = (
        F.when(F.col("blank"), "BLANK_FIELD").when(F.col("version"), "VERSION_MISMATCH").when(F.col("type"), "UNKNOWN_TYPE")
        .when(F.col("hash"), "HASH_MISMATCH").when(F.col("private"), "PRIVATE_PROVENANCE").when(F.col("n") > 1, "DUPLICATE_ID")
        .when(F.col("f0") != F.col("f1"), "MIXED_FINGERPRINTS").when(F.col("datasets") != 1, "DATASET_COUNT").otherwise("OK")
    )
    return found.select("journal_id", "n_documents", verdict.alias("verdict"))


def parity(journals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Tickets on one side only, and computed evidence that lacks a measure."""
    tickets = journals.select("journal_id", C.ticket(C.by_header(journals, C.TICKET_COLUMNS)).alias("ticket")).filter("ticket IS NOT NULL").distinct()
    has = evidence.select("journal_id", "ticket").distinct()
    only = lambda a, b, why: a.join(b, ["journal_id", "ticket"], "left_anti").withColumn("fault", F.lit(why))
    lacking = evidence.filter((F.col("status") == "COMPUTED") & F.coalesce(*(F.when(F.col(m).isNull(), F.lit(True)) for m in ("interval_high", "interval_low", "mfe", "mae"))).isNotNull())
    return only(tickets, has, "EVIDENCE_MISSING").unionByName(only(has, tickets, "TICKET_UNKNOWN")).unionByName(lacking.select("journal_id", "ticket", F.lit("MEASURE_MISSING").alias("fault")))


def binding(stored: DataFrame, fingerprints: DataFrame, contract_version: str) -> DataFrame:
    """Per journal with stored evidence: OK, INVALID_BOUND_EVIDENCE or FINGERPRINT_MISMATCH."""
    rows = stored.groupBy("journal_id").agg(F.min("journal_fingerprint").alias("f0"), F.max("journal_fingerprint").alias("f1"), F.bool_and(F.col("contract_version") == contract_version).alias("contract"), F.bool_and(F.col("kind").isNotNull()).alias("basis"))
    joined = rows.join(fingerprints.select("journal_id", "journal_fingerprint"), "journal_id", "left")
    verdict = F.when(~F.col("contract") | ~F.col("basis"), "INVALID_BOUND_EVIDENCE").when(F.coalesce((F.col("f0") == F.col("f1")) & (F.col("f0") == F.col("journal_fingerprint")), F.lit(False)), "OK").otherwise("FINGERPRINT_MISMATCH")
    return joined.select("journal_id", verdict.alias("verdict"))
