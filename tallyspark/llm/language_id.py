"""Language identification with language-bitmask n-gram filters (operator 5).

One Bloom filter serves all languages: each of its places holds a bitmask with a
bit per language, so the AND over an n-gram's places is the set of languages that
contain it. A text's n-grams are looked up, each language's hits are counted, the
count is corrected for the language's false-positive rate, and the highest count
decides.

n-grams are runs of four bytes of the lower-cased text, with all ASCII that is no
letter taken as a blank and blanks after its end; those with no letter are left out.

A filter holds ``PASS_LANGUAGES`` languages; where there are more, texts pass one filter after the
other and keep the best language of all, so none is left out and a task never holds more than one.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a text
with letters but no known n-gram gets the first language by name with score 0;
without training rows every text is ``und``; ties go to the first language by
name; each input row gives one row; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.labels import remainder
from tallyspark.llm.scratch import materialize

#: Training documents per language, about.
TRAIN_DOCS = 3_000
#: Places of the filter, and places per n-gram.
PLACES, HASHES = 1 << 21, 3
#: A language keeps the n-grams that this share of its training documents hold.
SHARE = 0.02
#: Languages that one bitmask word holds; more languages take more words.
WORD_BITS = 64

#: Languages of one filter: 16 MB for each 64 of them.
PASS_LANGUAGES = 256


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; numerals such as ² and ½ are none."""
    return bool(text) and any(map(str.isalpha, text))


def grams(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each n-gram, n-gram) for block after block."""
    for at, n, data, starts in W.blocks(texts):
        row = np.repeat(np.arange(n), np.diff(np.append(starts, len(data))))
        more = np.zeros(3, np.int64)  # so that the last bytes begin n-grams as those of other texts do
        letter, row = np.append(W.IS_LETTER[data], more > 0), np.append(row, more - 1)
        clean = np.where(letter, np.append(data, more).astype(np.uint32), np.uint32(32))
        gram, some = clean[:-3] << np.uint32(24), letter[:-3].copy()
        for k, shift in ((1, 16), (2, 8), (3, 0)):
            own = row[k : len(row) - 3 + k] == row[:-3]  # what follows a text counts as blank
            gram |= np.where(own, clean[k : len(clean) - 3 + k], np.uint32(32)) << np.uint32(shift)
            some |= letter[k : len(letter) - 3 + k] & own
        begins = np.flatnonzero(some)
        yield at, n, row[begins], gram[begins]


def places(gram: np.ndarray, n_places: int, k: int) -> np.ndarray:
    """The k-th place of each n-gram."""
    mixed = W.mix(gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59B + 1))
    return (mixed & np.uint64(n_places - 1)).astype(np.int64)


def lowered(column: pa.Array) -> list[bytes]:
    return W.utf8(pc.utf8_lower(column.cast(pa.large_string())).cast(pa.large_binary()))


def language_counts(docs: DataFrame, keep: Column) -> dict[str, int]:
    """The languages of the documents to learn from, by name, with their documents: a row per language reaches the driver."""
    usable = keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    counted = docs.filter(usable).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict(sorted((r["lang"], r["n"]) for r in counted))


def learn(docs: DataFrame, keep: Column, counts: dict[str, int], train_docs: int = TRAIN_DOCS, share: float = SHARE) -> tuple[list[str], np.ndarray]:
    """(languages, filter of shape (mask words, places)) from ``docs`` (doc_id, text, lang), for the languages in ``counts``.

    About ``train_docs`` documents of each language are taken, by hash of their ids.
    What reaches the driver is at most (n-grams per document / share) n-grams for
    each language.
    """
    usable = keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    languages = sorted(counts)
    planes = max(1, -(-len(languages) // WORD_BITS))
    table = np.zeros((planes, PLACES), np.uint64)
    if not languages:
        return languages, table
    million = 1_000_000
    limits = F.create_map(*[F.lit(x) for k in languages for x in (k, min(million, million * train_docs // counts[k] + 1))])
    taken = docs.filter(usable & F.col("lang").isin(languages) & (F.pmod(F.xxhash64("doc_id"), F.lit(million)) < limits[F.col("lang")]))
    number = {k: i for i, k in enumerate(languages)}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([number[k] for k in batch.column(1).to_pylist()], np.int64)
            for at, n, rows, gram in grams(lowered(batch.column(0))):
                key = np.unique(rows.astype(np.int64) << np.int64(32) | gram.astype(np.int64))
                rows, gram = key >> np.int64(32), key & np.int64(0xFFFFFFFF)
                pair, docs_in = np.unique(lang[at : at + n][rows] << np.int64(32) | gram, return_counts=True)
                names = ["lang", "gram", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(pair >> np.int64(32)), pa.array(pair & np.int64(0xFFFFFFFF)), pa.array(docs_in)], names)

    found = (
        taken.select("text", "lang").mapInArrow(distinct, "lang long, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    least = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (i, share * min(train_docs, counts[k]))])
    kept = found.filter(F.col("n") >= least[F.col("lang").cast("int")]).toArrow()
    lang, gram = kept["lang"].to_numpy(), kept["gram"].to_numpy()
    for i in range(len(languages)):
        bit = np.uint64(1 << (i % WORD_BITS))
        for k in range(HASHES):
            table[i // WORD_BITS, places(gram[lang == i], PLACES, k)] |= bit
    return languages, table


def false_positive_rates(table: np.ndarray, n_languages: int) -> np.ndarray:
    """Chance that an absent n-gram seems to be in the language."""
    fill = [np.mean(table[i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1)) for i in range(n_languages)]
    return np.array(fill) ** HASHES


def smallest(table: np.ndarray, n_languages: int) -> np.ndarray:
    """The filter in the narrowest type that holds its bits."""
    return table.astype(next((t for b, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if n_languages <= b), np.uint64))


def decide(texts: list[bytes], table: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, its corrected hits, those of all languages) of each lower-cased text."""
    best, most, every = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    for at, n, rows, gram in grams(texts):
        hits, total = np.zeros((len(fp), n)), np.bincount(rows, minlength=n)
        spots = [places(gram, table.shape[1], k) for k in range(HASHES)]
        for plane in range(table.shape[0]):
            mask = table[plane][spots[0]]
            for spot in spots[1:]:
                mask &= table[plane][spot]
            known = np.flatnonzero(mask)
            mask, where = mask[known], rows[known]
            for bit in range(min(WORD_BITS, len(fp) - plane * WORD_BITS)):
                hits[plane * WORD_BITS + bit] = np.bincount(where[mask >> mask.dtype.type(bit) & mask.dtype.type(1) > 0], minlength=n)
        fixed = np.maximum(hits - total * fp[:, None], 0) / (1 - np.minimum(fp, 0.999))[:, None]
        best[at : at + n] = fixed.argmax(0)
        most[at : at + n], every[at : at + n] = fixed.max(0), fixed.sum(0)
    return best, most, every


JUDGED = "doc_id long, text string, name string, most double, every double"
VERDICT = "doc_id long, lang_pred string, score double"


def judged(rows: DataFrame, model: tuple[list[str], np.ndarray], last: bool) -> DataFrame:
    """``rows`` (JUDGED) with the best language of those so far and of ``model``, of equals the earlier; after the last model the VERDICT."""
    languages, table = model
    held = rows.sparkSession.sparkContext.broadcast(smallest(table, len(languages)))  # PLACES mask words
    fp = false_positive_rates(table, len(languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, most, every = decide(lowered(batch.column(1)), held.value, fp)
            before, every = batch.column(3).to_numpy(), every + batch.column(4).to_numpy()
            names = [languages[b] if m > m0 else old for b, m, m0, old in zip(best, most, before, batch.column(2).to_pylist(), strict=True)]
            most = np.maximum(most, before)
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(most), pa.array(every)], ["doc_id", "text", "name", "most", "every"])
                continue
            lettered = np.array([has_letter(t) for t in batch.column(1).to_pylist()], bool)
            shown = [name if has else "und" for name, has in zip(names, lettered, strict=True)]
            score = np.clip(most / np.maximum(every, 1e-9), 0, 1) * lettered
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, VERDICT if last else JUDGED)


def language_id(
    docs: DataFrame, modulus: int = 3, held_out: int = 1, train_docs: int = TRAIN_DOCS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Learn from rows outside the held-out remainder and predict every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    keep = remainder("doc_id", modulus) != held_out
    counts = language_counts(rows, keep)
    names = list(counts)
    passes = [names[at : at + PASS_LANGUAGES] for at in range(0, len(names), PASS_LANGUAGES)]
    seen = rows.select("doc_id", "text", F.lit(None).cast("string").alias("name"), F.lit(-1.0).alias("most"), F.lit(0.0).alias("every"))
    for k, some in enumerate(passes):
        last = k + 1 == len(passes)
        seen = judged(seen, learn(rows, keep, {name: counts[name] for name in some}, train_docs), last)
        seen = seen if last else materialize(seen, "languages-seen")
    if not passes:
        seen = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return seen.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "lang_pred", "score")
