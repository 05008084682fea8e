"""Toxicity scores by gradient-boosted trees over dense features (operator 6).

A lexicon of words that toxic training documents favour is learnt first. Every
text then becomes a short vector: lexicon densities, lexicon hits near
second-person words, capitals, punctuation and obfuscation rates. Boosted trees
learn from a bounded labelled sample, and isotonic regression on a part of the
sample that the trees did not see turns their output into a probability.

Edge cases: null and empty texts have an all-zero vector and get its score;
when the training rows hold fewer than two classes every score is the share of
label 1 (0 without rows); each input row gives one row; rows with a null id are
scored and never train; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import words as W
from tallyspark.llm.labels import labelled_sample, remainder
from tallyspark.llm.language_id import lowered
from tallyspark.llm.scratch import materialize

TRAIN_DOCS = 20_000
LEXICON_WORDS = 500
#: A lexicon word is in so many toxic documents at least, and so much likelier there.
LEXICON_DOCS, LEXICON_LIFT = 5, 4.0
#: Words between a hit and a second-person word that count as near.
NEAR = 5
TREES, DEPTH = 20, 3

# Second-person words of English, French, German and Spanish.
SECOND_PERSON = """
you your yours yourself yourselves u ur
tu te toi ton ta tes vous votre vos
du dich dir dein deine ihr euch euer
tú ti usted ustedes vosotros vuestro tus
""".split()
# Marks and digits that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = [
    "lexicon_share", "lexicon_count", "disguised_share", "disguised_count", "near_share", "near_count", "second_share",
    "capital_share", "capital_words", "mark_share", "shout_share", "mixed_words", "single_letters", "log_words",
]

_PLAIN = np.where(W.IS_LETTER, np.arange(256), 32).astype(np.uint8)
_UNMASK = _PLAIN.copy()
for _mark, _letter in STANDS_FOR.items():
    _UNMASK[ord(_mark)] = ord(_letter)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def word_keys(listed: list[str]) -> np.ndarray:
    data = np.frombuffer((" ".join(listed) + " ").encode(), np.uint8)
    space = data == 32
    return np.sort(W.word_hashes(data, space, W.word_starts(space)))


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def letter_words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of letters after ``table`` is applied."""
    data = table[data]
    space = data == 32
    begins = W.word_starts(space)
    return begins, W.word_hashes(data, space, begins)


def vectors(raw: list[bytes], low: list[bytes], lexicon: np.ndarray) -> np.ndarray:
    """One feature row per text; ``low`` are the same texts lower-cased."""
    out = np.zeros((len(raw), len(FEATURES)))
    second = word_keys(SECOND_PERSON)
    for at, n, data, starts in W.blocks(low):
        begins, keys = letter_words(data, _PLAIN)
        rows = W.row_of(begins, starts)
        count = np.bincount(rows, minlength=n)
        per = 1.0 / np.maximum(count, 1)
        hit, you = member(keys, lexicon), member(keys, second)
        hits = np.bincount(rows[hit], minlength=n)
        masked_at, masked_keys = letter_words(data, _UNMASK)
        masked = np.bincount(W.row_of(masked_at, starts)[member(masked_keys, lexicon)], minlength=n)
        disguised = np.maximum(masked - hits, 0)
        you_at, hit_at = np.flatnonzero(you), np.flatnonzero(hit)
        near = np.zeros(len(hit_at), bool)
        if len(you_at):
            for side in (np.searchsorted(you_at, hit_at) - 1, np.searchsorted(you_at, hit_at)):
                k = np.clip(side, 0, len(you_at) - 1)
                near |= (np.abs(you_at[k] - hit_at) <= NEAR) & (rows[you_at[k]] == rows[hit_at])
        nears = np.bincount(rows[hit_at[near]], minlength=n)
        space = W.IS_SPACE[data]
        word_at = W.word_starts(space)
        letter, digit = W.IS_LETTER[data], _DIGIT[data]
        inner = np.zeros(len(data), bool)  # a mark or digit between two letters of a word
        inner[1:-1] = ~letter[1:-1] & ~space[1:-1] & letter[:-2] & letter[2:] & (data[1:-1] != 39) & (data[1:-1] != 45)
        mixed = np.bincount(W.row_of(np.flatnonzero(inner), starts), minlength=n)
        alone = letter.copy()
        alone[1:] &= ~letter[:-1]
        alone[:-1] &= ~letter[1:]
        singles = np.bincount(W.row_of(np.flatnonzero(alone), starts), minlength=n)
        marks = np.bincount(W.row_of(np.flatnonzero(~letter & ~digit & ~space), starts), minlength=n)
        shouts = np.bincount(W.row_of(np.flatnonzero(data == 33), starts), minlength=n)
        chars = np.maximum(np.bincount(W.row_of(np.flatnonzero(~space), starts), minlength=n), 1)
        spaced = 1.0 / np.maximum(np.bincount(W.row_of(word_at, starts), minlength=n), 1)
        block = out[at : at + n]
        block[:, 0], block[:, 1] = hits * per, hits
        block[:, 2], block[:, 3] = disguised * per, disguised
        block[:, 4], block[:, 5] = nears * per, nears
        block[:, 6] = np.bincount(rows[you], minlength=n) * per
        block[:, 9], block[:, 10] = marks / chars, shouts / chars
        block[:, 11], block[:, 12] = mixed * spaced, singles * spaced
        block[:, 13] = np.log1p(count)
    for at, n, data, starts in W.blocks(raw):
        big = (data >= 65) & (data <= 90)
        small = (data >= 97) & (data <= 122)
        bigs = np.bincount(W.row_of(np.flatnonzero(big), starts), minlength=n)
        smalls = np.bincount(W.row_of(np.flatnonzero(small), starts), minlength=n)
        out[at : at + n, 7] = bigs / np.maximum(bigs + smalls, 1)
        pair = big[1:] & big[:-1]
        out[at : at + n, 8] = np.bincount(W.row_of(np.flatnonzero(pair), starts), minlength=n) / np.maximum(bigs, 1)
    return out


def learn_lexicon(sample: DataFrame) -> np.ndarray:
    """Keys of at most ``LEXICON_WORDS`` words that toxic documents favour."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.int64)
            for at, n, data, starts in W.blocks(lowered(batch.column(0))):
                begins, keys = letter_words(data, _PLAIN)
                rows = W.row_of(begins, starts)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[new].view(np.int64)), pa.array(label[at : at + n][rows[new]])], ["word", "label"]
                )

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not toxic or toxic == n:
        return np.zeros(0, np.uint64)
    found = (
        sample.select("text", "label").mapInArrow(distinct, "word long, label long")
        .groupBy("word").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("docs"))
    )
    lift = (F.col("hits") + 0.5) / toxic / ((F.col("docs") - F.col("hits") + 0.5) / (n - toxic))
    strong = found.filter((F.col("hits") >= LEXICON_DOCS) & (lift >= LEXICON_LIFT)).withColumn("lift", lift)
    rows = strong.orderBy(F.desc("hits"), F.desc("lift"), "word").limit(LEXICON_WORDS).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def features(docs: DataFrame, lexicon: np.ndarray, keep: list[str], inside: str | None = None) -> DataFrame:
    """The columns ``keep`` as they are, and each text's feature array; the text is ``docs.text``, or the field ``inside`` of the first kept column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = W.text_field(batch.column(0), inside) if inside else batch.column(len(keep))
            found = vectors(W.utf8(text), lowered(text), lexicon)
            flat = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), flat], [*keep, "features"])

    W.small_batches(docs.sparkSession)
    rows = docs.select(*keep) if inside else docs.select(*keep, "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], T.StructField("features", T.ArrayType(T.DoubleType()))]))


class Model:
    """Lexicon, trees and calibration; ``constant`` replaces them where there is nothing to learn."""

    def __init__(self, sample: DataFrame):
        self.constant, self.lexicon, self.trees, self.calibration = 0.0, np.zeros(0, np.uint64), None, None
        sample = materialize(sample, "toxicity-sample")
        self.lexicon = learn_lexicon(sample)
        rows = materialize(features(sample, self.lexicon, ["doc_id", "label"]), "toxicity-features").coalesce(8)
        rows = rows.select("label", array_to_vector("features").alias("features"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part"))
        seen = rows.groupBy((F.col("part") == 0).alias("calibrates"), "label").count().collect()
        n = sum(r["count"] for r in seen)
        self.constant = sum(r["count"] for r in seen if r["label"]) / max(n, 1)
        if len({r["label"] for r in seen if not r["calibrates"]}) < 2:
            return
        fit = rows.filter("part != 0")
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=17).fit(fit)
        checked = rows.filter("part = 0") if any(r["calibrates"] for r in seen) else fit
        raw = self.trees.transform(checked).select("label", vector_to_array("probability")[1].alias("raw"))
        # Equal outputs are one weighted row: they are many where trees are few, and would be fitted in one task.
        level = raw.groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(level)

    def score(self, docs: DataFrame, keep: list[str], inside: str | None = None) -> DataFrame:
        """The columns ``keep`` of ``docs`` and the score of each row; the text as in ``features``."""
        if self.trees is None:
            return docs.select(*keep, F.lit(float(self.constant)).alias("score"))
        rows = features(docs, self.lexicon, keep, inside).select(*keep, array_to_vector("features").alias("features"))
        raw = self.trees.transform(rows).select(*keep, vector_to_array("probability")[1].alias("raw"))
        return self.calibration.transform(raw).select(*keep, "score")


def toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, bound: int = TRAIN_DOCS,
    label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Train on labelled rows outside the held-out remainder and score every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = Model(labelled_sample(rows, labels, label, remainder("doc_id", modulus) != held_out, bound))
    return model.score(rows, ["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score below 0.5; every labelled row may train."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = Model(labelled_sample(rows.select("doc_id", "text"), labels, "toxic", F.lit(True), bound))
    return model.score(rows, ["row"], text_col).filter("score < 0.5").select("row.*")
