"""Classifiers: planted signals are learnt, held-out rows included; odd rows do not crash."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, quality, toxicity
from tallyspark.llm.labels import labelled_sample

LONG = "word " * 30_000
ODD = [(-1, None), (-2, ""), (-3, "   \n"), (-4, "12345 !!"), (-5, LONG), (-6, "a b"), (-6, "a b"), (None, "no id here")]
TOXIC = ["slime", "rotter", "wretch"]


def prose(i, words):
    return " ".join(words[(i * 7 + k * k) % len(words)] for k in range(40))


EN = ["the", "that", "with", "thing", "other", "ering", "stand", "hand", "ation", "would"]
DE = ["der", "schon", "nicht", "gegen", "keit", "ungen", "über", "zwischen", "pflicht", "heiten"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(240):
        text = prose(i, DE if i % 3 == 0 else EN)
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 5 == 0:
            text += f" you {TOXIC[i % 3]} and {TOXIC[(i + 1) % 3]}"
        rows.append((i, text, "de" if i % 3 == 0 else "en", int(i % 4 != 0), int(i % 5 == 0)))
    all_rows = [(i, t, lang, q, x) for i, t, lang, q, x in rows] + [(i, t, None, None, None) for i, t in ODD]
    df = spark.createDataFrame(all_rows, "doc_id long, text string, lang string, quality int, toxic int")
    return df.withColumns({"score": df["doc_id"], "row": df["text"], "features": df["lang"]})  # names that could clash


def held_out(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def test_quality(spark, docs):
    found = quality.classify(docs, docs.select("doc_id", "quality")).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    good = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 0]
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in good)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in good) >= 0.95 * len(good)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}


def test_quality_stage_keeps_columns(spark, docs):
    kept = quality.without_poor(docs, docs.select("doc_id", "quality"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] % 4 for r in kept.filter("doc_id >= 0").collect()} == {1, 2, 3}


def test_language(spark, docs):
    found = language_id.language_id(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (-1, -2, -3, -4))
    assert by_id[-5]["lang_pred"] in ("de", "en")
    good = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 0]
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 3 == 0 else "en") for r in good)


def test_numerals_are_no_letters(spark, docs):
    odd = spark.createDataFrame([(9001, "½ ² ① 12", None), (9002, "² é", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert found[9001] == "und" and found[9002] in ("de", "en")


def test_copies_of_an_id_train_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = labelled_sample(docs, marks, "quality", F.lit(True), 10).collect()
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in rows) == [(1, "a", 0), (1, "a", 1), (2, None, 1)]


def test_empty_tables(spark, docs):
    marks = docs.select("doc_id", "quality", "toxic")
    assert quality.classify(docs.limit(0), marks).count() == 0 and toxicity.toxicity(docs.limit(0), marks).count() == 0


def brute_quality(texts, w, bits):
    """Scores gram by gram, from the features' own hashes of one text at a time."""
    out = []
    for t in texts:
        z = w[0]
        for _, _, data, starts in quality.W.blocks([t]):
            for _, index in quality.block_features(data, starts, bits):
                z += quality.SCALE * sum(w[i] for i in index.tolist()) / max(len(index), 1)
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_quality_scores_are_sparse_dot_products():
    r = np.random.default_rng(2)
    w = r.normal(size=(1 << 10) + 1)
    texts = [b"", b"one", b"Some words, some WORDS 12 times", b"x " * 500, "\u00fcber".encode()]
    assert quality.score_blocks(texts, w, 10).tolist() == pytest.approx(brute_quality(texts, w, 10))


def test_language_filters_against_sets():
    """Hits counted over the filter equal hits counted over plain sets, where no n-gram is a false positive."""
    texts = [b"the other thing stands", b"gegen die zwischen keit", b"unrelated xqz", b""]
    known = [{g for *_, gs in language_id.grams([t]) for g in gs.tolist()} for t in texts[:2]]
    table = np.zeros((1, language_id.PLACES), np.uint64)
    for i, of in enumerate(known):
        for k in range(language_id.HASHES):
            table[0, language_id.places(np.array(sorted(of), np.uint32), language_id.PLACES, k)] |= np.uint64(1 << i)
    best, most, every = language_id.decide(texts, language_id.smallest(table, 2), language_id.false_positive_rates(table, 2))
    for t, b, m, e in zip(texts, best.tolist(), most.tolist(), every.tolist(), strict=True):
        hits = [sum(g in of for *_, gs in language_id.grams([t]) for g in gs.tolist()) for of in known]
        assert hits[b] == max(hits) and (m, e) == pytest.approx((max(hits), sum(hits)), abs=1e-2)


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"one two", b"x", b"", b"3 4", b"ends in a word", "\u00e9t\u00e9".encode(), b"q"]
    together = {i: [] for i in range(len(texts))}
    for at, _, rows, found in language_id.grams(texts):
        for r, g in zip(rows.tolist(), found.tolist(), strict=True):
            together[at + r].append(g)
    for i, t in enumerate(texts):
        clean = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t) + b"   "
        want = [int.from_bytes(clean[j : j + 4], "big") for j in range(len(t)) if clean[j : j + 4].strip()]
        assert together[i] == want == [g for *_, gs in language_id.grams([t]) for g in gs.tolist()]


def brute_toxicity(text, lexicon):
    words = re.findall("[a-z]+", text.lower())
    hits = [i for i, x in enumerate(words) if x in lexicon]
    yours = [i for i, x in enumerate(words) if x in toxicity.SECOND_PERSON]
    capitals = sum(c.isupper() for c in text)
    return {
        "lexicon_count": len(hits), "lexicon_share": len(hits) / max(len(words), 1), "near_count": sum(any(abs(i - j) <= toxicity.NEAR for j in yours) for i in hits),
        "second_share": len(yours) / max(len(words), 1), "capital_share": capitals / max(sum(c.isalpha() for c in text), 1), "log_words": math.log1p(len(words)),
    }


def test_toxicity_features_against_plain_counts():
    texts = ["You SLIME! you are here", "slime " * 3 + "far away from all of those seven words you", "calm text", "", "YOUR rotter, slime"]
    raw = [t.encode() for t in texts]
    found = toxicity.vectors(raw, [t.lower().encode() for t in texts], toxicity.word_keys(["slime", "rotter"]))
    at = {name: i for i, name in enumerate(toxicity.FEATURES)}
    for t, row in zip(texts, found, strict=True):
        want = brute_toxicity(t, {"slime", "rotter"})
        assert {k: row[at[k]] for k in want} == pytest.approx(want)


def test_language_without_training(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(df).first()["lang_pred"] == "und"
    assert language_id.language_id(df.limit(0)).count() == 0


def test_more_languages_than_a_mask_word(spark):
    rows = [(i * 3 + r, f"q{chr(97 + i % 26)}{chr(97 + i // 26)}zx " * 5, f"l{i:03d}") for i in range(70) for r in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(df, modulus=1, held_out=5).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_languages_in_several_passes(spark, monkeypatch):
    """300 languages, one of them the commonest by far, over filters of 64 and of all; equal languages go to the first by name."""
    sound = lambda i: f"q{chr(97 + i % 26)}{chr(97 + i // 26)}zx "
    rows = [(i * 3 + r, sound(i) * 5, f"l{i:03d}") for i in range(300) for r in range(3)] + [(2000 + i, sound(0) * 4, "l000") for i in range(50)]
    rows += [(3000 + i, "twin words stay " * 3, name) for i, name in enumerate(["l400", "l299b", "l400", "l299b"])] + [(4000, "12 ½", None), (4001, "ш", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {}
    for size in (64, 512):
        monkeypatch.setattr(language_id, "PASS_LANGUAGES", size)
        found[size] = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(df, modulus=1, held_out=5).collect()}
    assert found[64].keys() == found[512].keys()
    assert all(name == found[512][i][0] and score == pytest.approx(found[512][i][1]) for i, (name, score) in found[64].items())
    assert all(found[64][i][0] == (lang if i < 3000 else "l299b") for i, _, lang in rows if i < 4000)
    assert found[64][4000] == ("und", 0) and found[64][4001] == ("l000", 0)


def test_toxicity(spark, docs):
    found = toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    good = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 0]
    assert all(r["held_out"] == held_out(r["doc_id"], 5, 0) for r in good)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in good) >= 0.97 * len(good)


def test_toxicity_with_one_class(spark, docs):
    labels = docs.filter("toxic = 0").select("doc_id", "toxic")
    assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {0.0}


def test_disguised_words_count(spark):
    raw = [b"you sl1me", b"slime", b"clean text here", b""]
    found = toxicity.vectors(raw, raw, toxicity.word_keys(["slime"]))
    at = {name: i for i, name in enumerate(toxicity.FEATURES)}
    assert [r[at["disguised_count"]] for r in found] == [1, 0, 0, 0]
    assert [r[at["lexicon_count"]] for r in found] == [0, 1, 0, 0]
    assert not found[3].any()
