"""Quality of answer validation against expected outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Per case: whether the outcome is as expected; a known limitation without a documented status is, whatever comes.

    ``cases``: case_id, categories, expected_outcome (PASS, REJECT, KNOWN_LIMITATION), required_codes,
    forbidden_codes, documented_status; ``found``: case_id, status, rejection_codes.
    """
    c = F.col
    rows = cases.join(found, "case_id", "left")
    passed = F.size("rejection_codes") == 0
    rejected = (F.size(F.array_except("required_codes", "rejection_codes")) == 0) & ~F.arrays_overlap("forbidden_codes", "rejection_codes") & ~passed
    matched = F.when(c("expected_outcome") == "PASS", passed).when(c("expected_outcome") == "REJECT", rejected).otherwise(F.coalesce(F.nullif(c("documented_status"), F.lit("")), c("status")) == c("status"))
    return rows.withColumns({"passed": F.coalesce(passed, F.lit(False)), "matched": F.coalesce(matched, F.lit(False))})


def summary(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"), F.count_if(~c("matched")).alias("unexpected"),
        F.count_if((c("expected_outcome") == "REJECT") & c("passed")).alias("false_accepts"),
        F.count_if((c("expected_outcome") == "PASS") & ~c("passed")).alias("false_rejects"),
    )


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("categories").alias("category"), "matched").groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.count_if("matched").alias("matched"))


def code_coverage(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Per code: its first owning case, and whether that case would still be rejected without the code."""
    spark = rows.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, codes))).alias("code"))
    owned = rows.filter("expected_outcome = 'REJECT'").select("case_id", F.explode("required_codes").alias("code"), "rejection_codes")
    first = owned.groupBy("code").agg(F.min_by(F.struct("case_id", "rejection_codes"), "case_id").alias("owner"))
    return listed.join(first, "code", "left").select(
        "code", F.col("owner.case_id").alias("case_id"), F.col("owner").isNotNull().alias("covered"),
        F.coalesce(F.array_contains("owner.rejection_codes", F.col("code")), F.lit(False)).alias("sensitive"),
        F.coalesce(F.size(F.array_remove(F.col("owner.rejection_codes"), F.col("code"))) == 0, F.lit(False)).alias("sole_reason"),
    )


def pair_check(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(attack_id, control_id, holds): the attack is rejected and its control passes."""
    side = lambda name: rows.select(F.col("case_id").alias(f"{name}_id"), F.col("passed").alias(f"{name}_passed"))
    joined = pairs.join(side("attack"), "attack_id", "left").join(side("control"), "control_id", "left")
    return joined.select("attack_id", "control_id", F.coalesce(~F.col("attack_passed") & F.col("control_passed"), F.lit(False)).alias("holds"))
