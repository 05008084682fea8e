"""Case folding, manual trades, downloads and table checks that no query meets."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import cleaning as C
from tallyspark.operators import scope, strict_queries
from tallyspark.sources import journals


def test_case_folds_as_python_does(spark):
    """For every character up to U+1FFFF that Python's own tables know: equal after folding if and only if equal after casefold."""
    cherokee = lambda c: 0x13A0 <= c <= 0x13FF or 0xAB70 <= c <= 0xABBF  # noqa: E731  (folded to small letters here, to capitals there)
    newer = lambda c: c in (0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC) or 0x10D50 <= c <= 0x10D65
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF and c != 0xE000 and not cherokee(c) and not newer(c)]
    rows = spark.createDataFrame([(chr(c),) for c in points], "t string").select("t", C.folded(F.col("t")).alias("f")).collect()
    assert [r["t"] for r in rows if r["f"] != r["t"].casefold()] == []
    words = ["Straße", "STRASSE", "straẞe", "ΣΊΣΥΦΟΣ", "σίσυφος", "İstanbul", "i̇stanbul", "ısı", "IŞIK", "ﬁn", "FIN"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(C.folded(F.col("t"))).collect()
    assert [r[0] for r in rows] == [w.casefold() for w in words]


def test_folding_in_filters(spark):
    df = spark.createDataFrame([("a", "Straße"), ("b", "STRASSE"), ("c", "strase"), ("d", None)], "journal_id string, Symbol string")
    kept = lambda params: {r["journal_id"] for r in scope.apply_scope(df, params).collect()}
    assert kept({"symbol": "strasse"}) == kept({"symbol": "RAßE"}) == kept({"q": "STRAẞE"}) == {"a", "b"}
    variants = strict_queries.symbol_variants(df, []).collect()
    assert [(r["folded"], r["spellings"]) for r in variants] == [("strasse", 2)]


def test_manual_trades_keep_their_kinds(spark, tmp_path):
    row = ("TIN", "LONG", "CLOSED", *(Decimal(x) for x in ("1.5", "10", "11", "9", "12")), Decimal("0.25"), dt.datetime(2031, 1, 1), dt.datetime(2031, 1, 2), None, "note")
    spark.createDataFrame([row], journals.MANUAL_SCHEMA).write.parquet(f"{tmp_path}/t")
    found = journals.read_manual_trades(spark, f"{tmp_path}/t")
    assert found.schema == journals.MANUAL_SCHEMA and tuple(found.first()) == row


def test_a_download_holds_every_row_and_no_own_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Symbol,Profit,Notes\nTIN,5,\"two\nlines\"\nZINC,,x\n")
    rows, _ = journals.read_journals(spark, str(tmp_path / "a.csv"))
    journals.download(rows, f"{tmp_path}/out")
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/out")
    assert set(found.columns) == {"journal_id", "row_ord", "Symbol", "Profit", "Notes"} and found.count() == 2


def test_trade_like_tables(spark):
    like = lambda *names: C.is_trade_like(spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)))
    assert like("Profit") and like("Symbol", "Type", "x") and not like("Symbol", "Side") and not like("profit")
