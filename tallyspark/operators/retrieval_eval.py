"""Quality of retrieval against a relevance table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION_AT = 5


def case_metrics(cases: DataFrame, results: DataFrame, relevance: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per case: first relevant rank, hit@1, hit@3, reciprocal rank, precision@5 (always over 5).

    ``cases`` has case_id; ``results`` (case_id, document_id, rank); ``relevance`` (case_id, document_id).
    All three have the ``scope`` columns besides, none of them null; a case counts once in each scope.
    """
    keys = [*scope, "case_id"]
    hits = results.join(relevance.select(*keys, "document_id").distinct(), [*keys, "document_id"])
    found = hits.groupBy(*keys).agg(F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= PRECISION_AT).alias("relevant_5"))
    rank = F.col("first_rank")
    return cases.select(*keys).join(found, keys, "left").select(
        *keys, "first_rank",
        F.when(rank <= 1, 1.0).otherwise(0.0).alias("hit_1"), F.when(rank <= 3, 1.0).otherwise(0.0).alias("hit_3"),
        F.coalesce(1.0 / rank, F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("relevant_5", F.lit(0)) / F.lit(float(PRECISION_AT))).alias("precision_5"),
    )


def contract_failures(cases: DataFrame, results: DataFrame, states: DataFrame) -> DataFrame:
    """(case_id, failures): what a response breaks, in order of the checks.

    ``cases``: case_id, expected_state, ticket, journal_fingerprint; ``results``: case_id, rank,
    method, score, journal_fingerprint; ``states``: case_id, state, top_k, corpus_size, candidate_count.
    """
    exact, tfidf = F.col("method") == "EXACT_TICKET", F.col("method") == "TFIDF_COSINE"
    rows = results.join(cases.select("case_id", F.col("journal_fingerprint").alias("want")), "case_id")
    seen = rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("r0"), F.max("rank").alias("r1"), F.count_distinct("rank").alias("ranks"),
        F.bool_or(F.col("journal_fingerprint") != F.col("want")).alias("foreign"), F.bool_or(exact).alias("any_exact"), F.bool_and(exact).alias("all_exact"),
        F.bool_or(F.col("score").isNotNull()).alias("any_score"), F.bool_and(tfidf).alias("all_tfidf"),
        F.bool_or(F.col("score").isNull() | F.isnan("score") | (F.col("score") <= 0) | (F.col("score") > 1)).alias("bad_score"),
    )
    c = F.col
    joined = cases.join(states, "case_id", "left").join(seen, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok, free = c("state") == "OK", c("ticket").isNull()
    some = c("n") > 0
    tests = [
        ("STATE_MISMATCH", ~c("state").eqNullSafe(c("expected_state"))), ("INVALID_CORPUS_SIZE", c("corpus_size") < 0),
        ("INVALID_CANDIDATE_COUNT", c("candidate_count") < 0), ("RESULT_COUNT_EXCEEDS_CANDIDATES", c("n") > c("candidate_count")),
        ("RESULT_COUNT_EXCEEDS_TOP_K", c("n") > c("top_k")), ("RANK_SEQUENCE_INVALID", some & ((c("r0") != 1) | (c("r1") != c("n")) | (c("ranks") != c("n")))),
        ("FINGERPRINT_MISMATCH", some & c("foreign")), ("EXACT_TICKET_WITHOUT_TICKET", free & some & c("any_exact")),
        ("EXACT_TICKET_METHOD", ~free & ok & some & ~c("all_exact")), ("EXACT_TICKET_SCORE_PRESENT", ~free & ok & some & c("all_exact") & c("any_score")),
        ("TFIDF_METHOD", free & ok & some & ~c("all_tfidf")), ("TFIDF_SCORE_INVALID", free & ok & some & c("all_tfidf") & c("bad_score")),
        ("NON_OK_HAS_RESULTS", ~ok & some), ("CORPUS_INVALID_COUNTS", (c("state") == "CORPUS_INVALID") & ((c("corpus_size") != 0) | (c("candidate_count") != 0))),
    ]
    return joined.select("case_id", F.array_compact(F.array(*(F.when(test, name) for name, test in tests))).alias("failures"))


def case_faults(cases: DataFrame, relevance: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, fault): repeated ids, relevant documents that do not exist, a wrong single flag."""
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id", F.lit("DUPLICATE_CASE_ID").alias("fault"))
    unknown = relevance.join(documents.select("document_id").distinct(), "document_id", "left_anti").select("case_id", F.lit("UNKNOWN_RELEVANT_ID").alias("fault")).distinct()
    n = relevance.groupBy("case_id").agg(F.count_distinct("document_id").alias("n"))
    single = cases.join(n, "case_id", "left").filter(F.col("single_relevant") & (F.coalesce("n", F.lit(0)) != 1)).select("case_id", F.lit("SINGLE_RELEVANT_MISMATCH").alias("fault"))
    return twice.unionByName(unknown).unionByName(single)


def eligible(metrics: DataFrame, failures: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics with whether a case counts in the single- or multi-relevant means."""
    joined = metrics.join(failures, "case_id").join(cases.select("case_id", "expected_state", "single_relevant"), "case_id")
    fit = (F.size("failures") == 0) & (F.col("expected_state") == "OK")
    return joined.withColumns({"passed": F.size("failures") == 0, "counts_single": fit & F.col("single_relevant"), "counts_multi": fit & ~F.col("single_relevant")})


def summary(rows: DataFrame) -> DataFrame:
    """One row: contract pass rate, hit@1, hit@3 and MRR of single cases, precision@5 of multi cases; 0 if empty."""
    single = lambda c: F.coalesce(F.avg(F.when(F.col("counts_single"), F.col(c))), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("n_cases"), F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("contract_pass_rate"),
        single("hit_1").alias("hit_1"), single("hit_3").alias("hit_3"), single("reciprocal_rank").alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("counts_multi"), F.col("precision_5"))), F.lit(0.0)).alias("precision_5"),
    )
