"""Evidence corpus, retrieval, packets and answer validation on a small journal."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import corpus, excursion, packet, retrieval, retrieval_eval, validation, validation_eval
from tallyspark.session import settled

TRADES = [
    ("j", 1, "1", "2026-06-25 10:30:15", "2026-06-25 10:32:47", "US100", "buy", 100.0, 105.0, 5.0, 1.5, "kiwifruit plan"),
    ("j", 2, "2", "2026-06-25 11:30:15", "2026-06-25 11:32:47", "EURUSD", "sell", 1.2, 1.1, -54.7, 1.5, ""),
]
SCHEMA = "journal_id string, row_ord long, Ticket string, `Open Time` string, `Close Time` string, Symbol string, Type string, Entry double, Exit double, Profit double, Commission double, Notes string"


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.createDataFrame(TRADES, SCHEMA)
    prints = settled(excursion.fingerprint(df))
    trades = corpus.trade_documents(df.join(prints.select("journal_id", "journal_fingerprint"), "journal_id"))
    kpi = corpus.kpi_documents(spark.createDataFrame([("j", 0, "Win Rate (%)", "50.00")], "journal_id string, position int, metric string, value string"), prints)
    return settled(corpus.build(trades, kpi, corpus.dataset_documents(df, prints, source="C:\\x\\journal.csv")))


def test_documents(documents):
    found = {r["document_id"]: r for r in documents.collect()}
    assert set(found) == {"TRADE_EVIDENCE:ticket:1", "TRADE_EVIDENCE:ticket:2", "KPI_EVIDENCE:kpi:Win Rate (%)", "DATASET_CONTEXT:journal"}
    lines = found["TRADE_EVIDENCE:ticket:1"]["content"].split("\n")
    assert lines[:3] == ["Ticket: 1", "Symbol: US100", "Type: buy"] and "Profit: 5" in lines and "Realised movement: +5 price pts" in lines
    assert "kiwifruit" not in found["TRADE_EVIDENCE:ticket:1"]["content"]
    assert "Source filename: journal.csv" in found["DATASET_CONTEXT:journal"]["content"]
    assert corpus.integrity(documents).first()["verdict"] == "OK"
    broken = documents.withColumn("content", F.concat("content", F.lit("!")))
    assert corpus.integrity(broken).first()["verdict"] == "HASH_MISMATCH"
    assert corpus.integrity(documents.unionByName(documents)).first()["verdict"] == "DUPLICATE_ID"


ASKED = [
    ("profit", "j", "-54.7", None, None, None, None), ("both", "j", "commission", None, None, None, 10), ("exact", "j", None, "1.0", None, None, None),
    ("gone", "j", None, "99", None, None, None), ("blank", "j", " ", None, None, None, None), ("typed", "j", "win", None, None, "KPI_EVIDENCE", None),
    ("symbol", "j", "ticket", None, "us100", None, None),
]


@pytest.fixture(scope="module")
def answers(spark, documents):
    queries = spark.createDataFrame(ASKED, "query_id string, journal_id string, text string, ticket string, symbol string, document_type string, top_k int")
    results, states = retrieval.retrieve(documents, queries)
    return settled(results), settled(states)


def test_retrieval(answers):
    results, states = answers
    got = {}
    for r in results.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["document_id"].split(":")[-1])
    assert got == {"profit": ["2"], "both": ["2", "1"], "exact": ["1"], "typed": ["Win Rate (%)"], "symbol": ["1"]}
    state = {r["query_id"]: (r["state"], r["candidate_count"]) for r in states.collect()}
    assert state["gone"] == ("NO_RELEVANT_EVIDENCE", 0) and state["exact"] == ("OK", 1) and state["blank"] == ("EMPTY_QUERY", 4) and state["typed"] == ("OK", 1) and state["symbol"] == ("OK", 1)
    assert {r["score"] for r in results.filter("query_id = 'exact'").collect()} == {None}


def test_scores_are_cosines(spark):
    docs = spark.createDataFrame([("s", "a", "x x y"), ("s", "b", "y z")], "s string, d string, content string")
    asked = spark.createDataFrame([("s", "q", "x"), ("s", "q", "w")], "s string, q string, term string").groupBy("s", "q", "term").agg(F.count(F.lit(1)).alias("tf"))
    ties = docs.select("s", "d", F.col("d").alias("tie"))
    found = {r["d"]: r["score"] for r in retrieval.top_k(retrieval.term_counts(docs, ["s", "d"]), asked, ties, ["s"], document="d", query="q").collect()}
    rare, common = math.log(3 / 2) + 1, 1.0
    assert found == {"a": pytest.approx(2 * rare / math.hypot(2 * rare, common), abs=1e-9)}


def test_retrieval_metrics(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    results = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 4)], "case_id string, document_id string, rank int")
    relevant = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "x")], "case_id string, document_id string")
    found = {r["case_id"]: r.asDict() for r in retrieval_eval.case_metrics(cases, results, relevant).collect()}
    assert found["a"] == {"case_id": "a", "first_rank": 2, "hit_1": 0.0, "hit_3": 1.0, "reciprocal_rank": 0.5, "precision_5": 0.4}
    assert found["b"]["first_rank"] is None and found["b"]["reciprocal_rank"] == 0.0


GOOD = {"schema_version": "grounded-ai-response-v1", "answer": "Profit is 5 [E1].", "claims": [{"evidence": "E1", "field": "profit", "value": "5"}], "citations": ["E1"], "limitation_codes": []}
# Changed answers and the codes that each must give.
CANDIDATES = [
    (GOOD, []), ("not json", ["SCHEMA_INVALID_JSON"]), ({**GOOD, "schema_version": "v0"}, ["SCHEMA_VERSION_MISMATCH"]), ({**GOOD, "extra": 1}, ["SCHEMA_UNKNOWN_FIELD"]),
    ({k: v for k, v in GOOD.items() if k != "limitation_codes"}, ["SCHEMA_MISSING_FIELD"]), ({**GOOD, "answer": "Profit is 6 [E1]."}, ["NUMBER_UNGROUNDED"]),
    ({**GOOD, "answer": "Profit is 5% [E1]."}, ["NUMBER_UNGROUNDED"]), ({**GOOD, "answer": "Profit is 5."}, ["CITATION_INLINE_MISMATCH"]),
    ({**GOOD, "citations": ["E1", "E1"]}, ["CITATION_DUPLICATE"]), ({**GOOD, "claims": [{"evidence": "E1", "field": "profit", "value": "7"}], "answer": "It ended [E1]."}, ["CLAIM_VALUE_MISMATCH"]),
    ({**GOOD, "claims": [{"evidence": "E1", "field": "symbol", "value": "US100"}], "answer": "It ended [E1]."}, ["CLAIM_FIELD_NOT_CLAIMABLE"]),
    ({**GOOD, "claims": [{"evidence": "E1", "field": "swap", "value": "1"}], "answer": "It ended [E1]."}, ["CLAIM_FIELD_UNAVAILABLE"]),
    ({**GOOD, "limitation_codes": ["NO_SUCH"]}, ["LIMITATION_UNKNOWN_CODE"]), ({**GOOD, "limitation_codes": ["PARTIAL_EVIDENCE"]}, ["STATUS_CONTRADICTION"]),
    ({**GOOD, "answer": "Profit is 5 [E1]. You should buy."}, ["PROHIBITED_RECOMMENDATION"]), ({**GOOD, "answer": "Profit is 5 [E1]; it will rise."}, ["PROHIBITED_PREDICTION"]),
    ({**GOOD, "answer": "Ticket 1 made 5 [E1]."}, []), ({**GOOD, "answer": "Ticket 9 made 5 [E1]."}, ["IDENTIFIER_UNGROUNDED", "NUMBER_UNGROUNDED"]),
    ({**GOOD, "answer": "The owner_id had 5 [E1]."}, ["LEAKAGE_DETECTED"]), ({**GOOD, "answer": " "}, ["ANSWER_EMPTY", "CITATION_INLINE_MISMATCH"]),
]


def test_validation(spark, answers):
    results, states = answers
    exact = results.filter("query_id = 'exact'").withColumnRenamed("query_id", "request_id").withColumn("symbol", F.lit("US100"))
    fields = settled(packet.packet_fields(exact))
    assert {r["field_key"]: r["value"] for r in fields.collect()}["commission"] == "1.5" and fields.filter("fault IS NOT NULL").count() == 0
    asked = spark.createDataFrame([("exact", "What was  it?")], "request_id string, question string")
    one = states.withColumnRenamed("query_id", "request_id").withColumn("candidate_count", F.lit(1))
    headers = settled(packet.packets(exact, one, asked))
    assert headers.first()["fault"] is None and headers.first()["limitation_codes"] == []
    assert packet.integrity(fields, headers, exact).first()["verdict"] == "OK"
    listed = sorted((r["rank"], r["field_key"], r["value"], r["unit"]) for r in fields.collect())
    request = {
        "fields": [dict(zip(("rank", "field_key", "value", "unit"), x, strict=True)) for x in listed], "limitation_codes": [], "question": "What was  it?",
        "schema_version": packet.REQUEST_VERSION, "task_type": packet.TASK_TYPE,
    }
    assert headers.first()["request_sha256"] == hashlib.sha256(json.dumps(request, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert packet.prompt(fields, headers).first()["prompt"].startswith("Question: What was  it?")
    rows = [(f"c{i:02d}", "exact", c if isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(CANDIDATES)]
    candidates = spark.createDataFrame(rows, "case_id string, request_id string, candidate_json string")
    found = {r["case_id"]: r for r in validation.validate(candidates, fields, headers.withColumn("journal_fingerprint", F.lit("secret-print"))).collect()}
    assert {k: r["rejection_codes"] for k, r in found.items()} == {f"c{i:02d}": codes for i, (_, codes) in enumerate(CANDIDATES)}
    assert found["c00"]["status"] == "PASSED_DETERMINISTIC_CHECKS" and all(r["review_required"] for r in found.values())


def test_validation_quality(spark):
    schema = "case_id string, categories array<string>, expected_outcome string, required_codes array<string>, forbidden_codes array<string>, documented_status string, status string, rejection_codes array<string>"
    rows = [("a", ["x"], "PASS", [], [], None, "P", []), ("b", ["x", "y"], "REJECT", ["L"], [], None, "R", ["L", "M"]), ("c", ["y"], "REJECT", ["L"], ["M"], None, "R", ["L", "M"]), ("d", [], "PASS", [], [], None, "R", ["L"])]
    both = spark.createDataFrame(rows, schema)
    found = settled(validation_eval.matches(both.drop("status", "rejection_codes"), both.select("case_id", "status", "rejection_codes")))
    assert validation_eval.summary(found).first().asDict() == {"total": 4, "matched": 2, "unexpected": 2, "false_accepts": 0, "false_rejects": 1}
    assert {r["category"]: (r["cases"], r["matched"]) for r in validation_eval.category_counts(found).collect()} == {"x": (2, 2), "y": (2, 1)}
    assert {r["code"]: r["covered"] for r in validation_eval.code_coverage(found, ["L", "Z"]).collect()} == {"L": True, "Z": False}
    pairs = spark.createDataFrame([("b", "a"), ("a", "b")], "attack_id string, control_id string")
    assert [r["holds"] for r in validation_eval.pair_check(pairs, found).orderBy("attack_id").collect()] == [False, True]
