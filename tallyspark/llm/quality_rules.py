"""Quality rules: counts over whole texts, a base rule, and robust multivariate outliers (operator 12).

Four statistics of a text, each on a scale on which sound texts lie evenly, form a
vector: mean word length, symbols a word, repeated lines a word and the share of words in
repeated windows. Per language and source the minimum covariance determinant gives a mean
and a covariance of the ``KEEP`` share of vectors that lie closest together, and a text
is rejected whose Mahalanobis distance from them exceeds ``CUTOFF``.

The estimate starts from the quartiles and from all vectors; concentration steps follow
for both: distances under the last estimate, then the moments of the nearest ``KEEP`` of
a cell. A step is one pass: moments are added up per cell and class of distance, and
classes are taken until they hold enough rows, so neither a sort nor a cell in one task is
needed. Vectors are whole numbers of 1/1024, so sums are exact and no result depends on
the order of rows. The start of the smaller determinant is reweighted once. ``FLOOR``, the
spread of each statistic that is never odd, is added to every covariance: a statistic that
is zero for most texts has no variance of its own.

Everything is DataFrame functions. The texts are read once and never shuffled: words,
windows and lines are arrays of their own row. Windows are compared by 64-bit hashes (two
different ones of a text of n windows meet with a chance of n^2 / 2^65). Estimates, a row
per cell, are joined by Spark's own size check; where that is no broadcast, AQE splits a
hot cell.

Edge cases: null text counts as no words and fails the base rule; a null language or
source is a value of its own; cells of fewer than ``MIN_ROWS`` texts that pass the base
rule share one estimate; equal texts of a cell get equal verdicts; repeated rows count as
often as they stand; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import drop, materialize

WORDS_IN_WINDOW = 5
#: A text of fewer words, or of a larger share (in percent) of words in repeated windows, fails the base rule.
LEAST_WORDS = 10
MOST_REPEATED = 20
SYMBOLS = r"[#*$%&|<>]"
SPACES = " \t\n\x0b\f\r"

#: Vectors are whole multiples of 1 / UNIT, below LARGEST.
UNIT = 1024
LARGEST = 16 * UNIT
#: Every text is averaged with so many words of so many letters: few words say little.
PRIOR_WORDS, PRIOR_LETTERS = 100, 5
#: Standard deviation that each statistic is granted at least.
FLOOR = (0.05, 0.15, 0.35, 0.2)
D = len(FLOOR)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: Rows from which on a language and source have an estimate of their own.
MIN_ROWS = 100
#: Share of a cell that a concentration step keeps, and the steps.
KEEP = 0.75
STEPS = 4
#: Classes of squared distance per factor e.
CLASSES = 8
# Chi-squared with four degrees of freedom: quantile of 0.975, the factors that make the covariance of the nearest
# 0.75 and 0.975 of a normal cell that of the cell, and the quantile of 0.9999.
REWEIGHT = 11.143
RAW_FACTOR, FINAL_FACTOR = 1.486, 1.064
CUTOFF = 23.51

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keys`` and the five counts of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    split = F.filter(F.split(F.btrim(text, F.lit(SPACES)), "[ \t-\r]+"), lambda w: w != "")
    rows = docs.select(*keys, text.alias("_text"), split.alias("_words"), F.filter(F.split(text, "\n"), has_word).alias("_lines"))
    rows = rows.select(
        *keys, F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    last = F.size("_hashes") - WORDS_IN_WINDOW
    places = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))
    window = F.transform(places, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WORDS_IN_WINDOW))))
    rows = rows.select(*keys, *COUNTS[:-1], window.alias("_windows"))
    done = [*keys, *COUNTS[:-1]]
    # Of a text whose windows all differ none is sorted. Equal windows are neighbours among the sorted ones.
    ordered = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.select(*done, ordered.alias("_sorted"))
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["g"] == x["g"], F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    rows = rows.select(*done, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_starts"))
    reach = F.transform("_starts", lambda p, k: F.least(F.lit(WORDS_IN_WINDOW), F.coalesce(F.get("_starts", k + 1) - p, F.lit(WORDS_IN_WINDOW))))
    return rows.select(*done, F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in units of 1 / UNIT."""
    n = F.col("n_words") + PRIOR_WORDS
    parts = [
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LETTERS) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))))),
    ]
    return [F.least(F.round(p * UNIT), F.lit(LARGEST)).cast("long") for p in parts]


def _sums() -> list[Column]:
    pairs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(D)), *pairs]


SUMS = ["n", *(f"s{i}" for i in range(D)), *(f"s{i}{j}" for i, j in PAIRS)]


def _triangle(rows: DataFrame, keys: Sequence[str], mean: Column, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """``keys``, mean, and the Cholesky factor of the covariance (rows of its lower triangle) with its floor."""
    rows = rows.select(*keys, mean.alias("mean"), *(cov[p].alias(f"c{p[0]}{p[1]}") for p in PAIRS))
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        if i == j:  # what is left of the variance is its floor at least
            rows = rows.withColumn(f"l{i}{i}", F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOOR[i] ** 2))
        else:
            rows = rows.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0))
    return rows.select(*keys, "mean", F.array(*(f"l{i}{j}" for i, j in PAIRS)).alias("factor"), size.alias("log_det"))


def estimate(sums: DataFrame, keys: Sequence[str], factor: float = 1.0) -> DataFrame:
    """Mean and covariance (times ``factor``, with its floor) from the sums of a set of vectors."""
    mean = [F.col(f"s{i}") / F.col("n") / UNIT for i in range(D)]
    cov = {(i, j): factor * (F.col(f"s{i}{j}") / F.col("n") / UNIT**2 - mean[i] * mean[j]) for i, j in PAIRS}
    return _triangle(sums, keys, F.array(*mean), cov)


def distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... under ``mean`` and ``factor``."""
    at = {p: F.col("factor")[k] for k, p in enumerate(PAIRS)}
    y: list[Column] = []
    for i in range(D):
        rest = F.col(f"x{i}") / UNIT - F.col("mean")[i] - sum((at[i, k] * y[k] for k in range(i)), F.lit(0.0))
        y.append(rest / at[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _starts(vectors: DataFrame) -> DataFrame:
    """(cell, start, mean, factor, log_det): from the quartiles, and from all vectors of the cell."""
    quartiles = [F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(D)]
    told = materialize(vectors.groupBy("cell").agg(*_sums(), *quartiles), "rules-start")
    spread = {(i, j): ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / UNIT / 1.349) ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}
    robust = _triangle(told, ["cell"], F.array(*(F.col(f"q{i}")[1] / UNIT for i in range(D))), spread)
    return robust.withColumn("start", F.lit(0)).unionByName(estimate(told, ["cell"]).withColumn("start", F.lit(1)))


def concentrated(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: estimates of the nearest ``KEEP`` of each cell, whole classes of distance at a time."""
    seen = vectors.join(estimates, "cell").withColumn("band", F.floor(CLASSES * F.log1p(distance())))
    bands = seen.groupBy("cell", "start", "band").agg(*_sums())
    whole = Window.partitionBy("cell", "start")
    upto = whole.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    added = bands.select("cell", "start", F.ceil(KEEP * F.sum("n").over(whole)).alias("wanted"), F.col("n").alias("last"), *(F.sum(c).over(upto).alias(c) for c in SUMS))
    return estimate(added.filter("n >= wanted AND n - last < wanted"), ["cell", "start"])


def covariances(vectors: DataFrame) -> DataFrame:
    """(cell, mean, factor) by minimum covariance determinant, reweighted once."""
    estimates = materialize(_starts(vectors), "rules-0")
    for step in range(STEPS):
        before, estimates = estimates, materialize(concentrated(vectors, estimates), f"rules-{step + 1}")
        drop(before)
    best = estimates.groupBy("cell").agg(F.min_by(F.struct("mean", "factor"), F.struct("log_det", "start")).alias("best"))
    raw = best.select("cell", "best.*")
    # Scaled, the raw covariance is that of the whole cell if it is normal.
    near = vectors.join(raw, "cell").filter(distance() <= REWEIGHT * RAW_FACTOR)
    return materialize(estimate(near.groupBy("cell").agg(*_sums()), ["cell"], FINAL_FACTOR).drop("log_det"), "rules")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per document its counts, whether the base rule fails, its squared distance and whether it is kept."""
    place = F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s")), {"ignoreNullFields": "false"})
    rows = docs.select(F.col(id_col).alias("doc_id"), place.alias("place"), F.col(text_col).alias("text"))
    told = materialize(counted(rows, ["doc_id", "place"]).withColumn("base_failed", base_failed()), "rules-counts")
    sizes = told.filter("NOT base_failed").groupBy("place").agg(F.count(F.lit(1)).alias("n_place")).filter(F.col("n_place") >= MIN_ROWS)
    celled = told.join(materialize(sizes, "rules-places"), "place", "left").withColumn("cell", F.when(F.col("n_place").isNotNull(), F.col("place")).otherwise(""))
    celled = materialize(celled.select("doc_id", *COUNTS, "base_failed", "cell", *(x.alias(f"x{i}") for i, x in enumerate(vector()))), "rules-vectors")
    drop(told)
    found = covariances(celled.filter("NOT base_failed").select("cell", *(f"x{i}" for i in range(D))))
    judged = celled.join(found, "cell", "left").withColumn("distance", distance())
    near = F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance")
