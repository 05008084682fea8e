"""Encoding, packing, counts, joins, fingerprints, licenses and search against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import bpe, fingerprints, jaccard_tree, kd_search, license_scan, packing, token_counts
from tallyspark.llm.components import components

VOCAB = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(VOCAB)


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([3, 6, 40, 120]))) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        for k in range(r.randint(1, 4)):
            edited = list(w)
            edited[r.randrange(len(edited))] = f"edit{k}"
            near.append(" ".join(edited))
    passage = " ".join(f"shared{i}" for i in range(30))
    held = [f"{t} {passage}" for t in base[30:55]]
    odd = [None, "", " \n", "one", "two words", "Two Words", "x" * 5000, "a\x1cb 'RE’s 日本 <|endoftext|>y", LONG]
    return base + near + base[:10] + held + odd


LONG = " ".join(f"long{i % 900}" for i in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts())] + [(0, texts()[0]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({"cls": F.lit("c"), "n": F.lit(1), "length": F.lit(2), "pid": F.lit(3), "row": F.lit(4)})


def test_encoding(spark, docs, whole):
    found = bpe.encode_decode(docs, VOCAB).collect()
    digests = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.encode_digests(docs, VOCAB).collect()}
    assert len(found) == docs.count()
    expect = Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        expect[(r["doc_id"], tuple(ids), whole.decode(ids, skip_special_tokens=False))] += 1
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), whole.decode(ids, skip_special_tokens=False))]
        assert (r["doc_id"], *sums, len(ids)) in digests
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in found) == expect


def test_tree_concatenation(whole, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 3)
    coder, r = bpe.PieceEncoder(VOCAB), random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "th", "e", "ing", "é", "日", "!"]) for _ in range(r.randint(1, 120)))
        assert coder.ids(text) == whole.encode(text, add_special_tokens=False).ids


def test_halves_join_anywhere(whole, monkeypatch):
    coder, r = bpe.PieceEncoder(VOCAB), random.Random(7)
    parts = ["a", "the ", "ing", " ", "  ", "\n", "é", "ß", "İ", "日本", "!", "'s", "'", "’", "12", "½", "e\u0301", "\xa0", "\x85", "<|endoftext|>", "<|", "--", "ﬁ"]
    for leaf in (2, 9, 40):
        monkeypatch.setattr(bpe, "LEAF_TEXT", leaf)
        monkeypatch.setattr(bpe, "SEAM_CHARS", 3)
        for _ in range(250):
            text = "".join(r.choice(parts) for _ in range(r.randint(1, 120)))
            assert coder.tree_pieces(text) == coder.pieces(text)
            assert coder.ids(text) == whole.encode(text, add_special_tokens=False).ids


def test_long_texts_by_parts(spark, whole, monkeypatch):
    """A text of a million words, one without blanks and texts whose parts end anywhere, encoded by many tasks, against the library."""
    monkeypatch.setattr(bpe, "PART_TEXT", 1000)
    r = random.Random(9)
    words = ["a", "the", "ing's", "é", "日本語", "12½", "--", "<|endoftext|>", "\n", "don't", "x" * 30]
    rows = [(i, "".join(r.choice(words) + r.choice(["", " "]) for _ in range(900))) for i in range(12)] + [(50, "ab" * 3000), (51, "long " * 3000), (51, "long " * 3000), (None, "日" * 2500)]
    million = " ".join(f"{w}{i % 977}" for i, w in enumerate(["some", "words", "of", "it"] * 250_000))
    for most, texts in ((1000, rows), (1 << 16, [(60, million)])):
        monkeypatch.setattr(bpe, "PART_TEXT", most)
        found = Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in bpe.encode_digests(spark.createDataFrame(texts, "doc_id long, text string"), VOCAB).collect())
        want = Counter()
        for i, text in texts:
            ids = whole.encode(text, add_special_tokens=False).ids
            want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += 1
        assert found == want
    assert bpe.halves(0, 10, 3) == [(0, 2), (2, 5), (5, 7), (7, 10)]


def test_digests_of_an_empty_table(spark, docs):
    assert bpe.encode_digests(docs.limit(0), VOCAB).count() == 0


def test_packing(spark, docs, whole):
    pieces = packing.pack(docs, VOCAB).toPandas()
    want = Counter((r["doc_id"], len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    ids = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    assert pieces["length"].sum() == sum(n * k for (_, n), k in want.items())
    for p in pieces.itertuples():
        own = ids[None if p.doc_id != p.doc_id else p.doc_id]
        assert zlib.crc32(own[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(own)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        size = int(g["length"].sum())
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and (size == 4096 or size & (size - 1) == 0)
    assert packing.pack(docs.limit(0), VOCAB).count() == 0


def test_token_counts(spark, docs, whole):
    lengths = np.array([len(whole.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()])
    found = token_counts.token_counts(docs, VOCAB).collect()
    assert {r["context_limit"] for r in found if r["kind"] == "length"} == set(lengths.tolist())
    assert {r["context_limit"] for r in found if r["kind"] == "limit"} == set(token_counts.LIMITS)
    for q, limit in ((r["quantile"], r["context_limit"]) for r in found if r["kind"] == "quantile"):
        assert (lengths <= limit).mean() >= q > (lengths < limit).mean() or limit == lengths.min()
    for r in found:
        limit = r["context_limit"]
        assert r["n_docs"] == (lengths == limit).sum() and r["docs_at_least"] == (lengths >= limit).sum()
        assert r["truncated_tokens"] == np.minimum(lengths, limit).sum() and r["tokens_at_least"] == lengths[lengths >= limit].sum()
        assert r["docs_within"] == pytest.approx((lengths <= limit).mean())
    assert token_counts.token_counts(docs.limit(0), VOCAB).count() == 0


def brute_components(rows, least=80):
    up = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(up))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= least * len(s | t):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: len(s) for i, s in sets}, {i: find(i) for i, _ in sets}, links


def test_jaccard_join(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    sizes, label, links = brute_components(rows)
    found = jaccard_tree.jaccard_join(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], label[r["doc_id"]])
            both = 2 if r["doc_id"] == 0 else 1  # id 0 is a repeated row: its links are counted for each of its rows
            assert r["n_links"] == links[r["doc_id"]] // both
    kept = jaccard_tree.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in label if label[i] == i} | {None}
    assert jaccard_tree.jaccard_join(docs.limit(0)).count() == 0


def test_one_large_cluster_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "BLOCK_SHINGLES", 900)
    r = random.Random(9)
    stem = [f"stem{i}" for i in range(60)]
    rows = []
    for i in range(220):  # one family of near copies whose sizes spread over several bands, in many blocks
        words = stem[: 60 - i % 12] + [f"tail{k}" for k in range(i % 30)]
        words[r.randrange(len(words))] = f"own{i}"
        rows.append((i, " ".join(words)))
    sizes, label, links = brute_components(rows)
    found = jaccard_tree.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in found} == {i: (sizes[i], label[i], links[i]) for i, _ in rows}
    sets = [(i, 1, n, [0] * n) for i, n in ((k, 50 + k % 20) for k in range(400))]
    labels = spark.createDataFrame([(i, 7) for i, *_ in sets], "id long, label long")
    plan = jaccard_tree.cluster_links(spark.createDataFrame(sets, "cls long, copies long, n_shingles long, tokens array<long>"), labels)
    assert "hashpartitioning(label" in (text := plan._jdf.queryExecution().executedPlan().toString()) and "second" in text.split("FlatMapGroupsInPandas")[1].split("hashpartitioning(")[1].split(")")[0]


def test_classes_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "MANY_COPIES", 5)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(40)] + [(100 + i, "") for i in range(30)] + [(200, text + " more"), (300, "alone in here with five words")]
    found = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_tree.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (0, 40) for i in range(40)} | {100 + i: (100 + i, 0) for i in range(30)} | {200: (0, 40), 300: (300, 0)}


def test_trees_lose_no_link():
    r = np.random.default_rng(3)
    centres = [r.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(8)]
    sets = []
    for c in centres:
        for _ in range(25):
            own = c.copy()
            n = r.integers(0, 14)
            own[r.choice(60, n, replace=False)] = r.integers(0, 1 << 62, n).astype(np.uint64)
            sets.append(np.unique(own))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    assert want and {tuple(sorted(p)) for p in jaccard_tree.links(sets, sets, True).tolist()} == want
    old, jaccard_tree.MAX_BITS = jaccard_tree.MAX_BITS, 64
    try:
        assert {tuple(sorted(p)) for p in jaccard_tree.links(sets, sets, True).tolist()} == want
        half = {(i, j - 100) for i, j in want if i < 100 <= j}
        assert {tuple(p) for p in jaccard_tree.links(sets[:100], sets[100:], False).tolist()} == half
    finally:
        jaccard_tree.MAX_BITS = old


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    found = {r["id"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    order = sorted(rows)
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert set(found) == set(order)
    bag = lambda t: Counter(WORD.findall(t.lower()))
    errors = []
    for i, d in enumerate(order):
        text, following = rows[d], rows[order[(i + 1) % len(order)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert found[d]["n_chars"] == len(text) and found[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = bag(text), bag(edited)
        if a and b:
            keys = set(a) | set(b)
            errors.append(found[d]["near_edited"] - sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12
    by_text = {}
    for d in order:
        by_text.setdefault(rows[d], set()).add(found[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprints(docs.filter("doc_id = 3")).first()
    assert alone["near_next"] == 1.0


def test_license_scan(spark):
    mit = "Released under the MIT License."
    rows = [(1, "x " * 300 + mit + " y" * 50), (2, "nothing here"), (3, None), (3, ""), (None, mit), (4, mit), (4, mit), (5, "Licensed under the Apache License, Version 3.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    found = license_scan.scan(df).collect()
    assert Counter((r["doc_id"], r["license"]) for r in found if r["containment"] == 1) == {(1, "mit"): 1, (None, "mit"): 1, (4, "mit"): 2}
    assert {r["first_word"] for r in found if r["doc_id"] == 1} == {300} and {r["first_word"] for r in found if r["doc_id"] == 4} == {0}
    assert all(r["containment"] >= 0.8 for r in found)
    assert license_scan.scan(df.limit(0)).count() == 0 and license_scan.scan(df, []).count() == 0


def test_license_recall_against_every_window(spark):
    """Notices of five to 230 words, whole or with words changed, against exact containment in each window."""
    r = random.Random(4)
    notices = [(f"l{k}", " ".join(f"n{k}x{r.randrange(300)}" for _ in range(n))) for k, n in enumerate([5, 7, 9, 12, 20, 33, 60, 120, 230])]
    rows = []
    for i in range(270):
        words = notices[i % len(notices)][1].split()
        for _ in range(len(words) * (i % 3) // 60):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join([f"f{r.randrange(50)}" for _ in range(r.randrange(90))] + words + ["tail"] * r.randrange(9))))
    grams = lambda t: [tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)]
    want = set()
    for i, text in rows:
        seq = grams(text)
        for name, notice in notices:
            own = set(grams(notice))
            c = 1 << (len(grams(notice)) - 1).bit_length()
            if any(len(own & set(seq[at : at + 2 * c])) >= 0.8 * len(own) for at in range(0, len(seq), c)):
                want.add((i, name))
    found = {(x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices).collect()}
    assert found <= want and len(found) >= 0.99 * len(want) > 150


def test_whole_licenses(spark):
    """A whole license is found as itself, though it holds the words of a shorter notice or of a sibling."""
    text = {}
    for name, t in license_scan.TEMPLATES:
        text[name] = max(text.get(name, ""), t, key=len)
    ids = {i: name for i, name in enumerate(["mit", "isc", "bsd-2-clause", "zlib", "unlicense"])}
    long = "word " * 20_000
    rows = [(i, f"{long if i == 0 else ''}Copyright holder. {text[name]} The end.") for i, name in ids.items()]
    found = {}
    for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(x["doc_id"], set()).add(x["license"])
    assert {i: {"bsd", "bsd-2-clause"} if name == "bsd-2-clause" else {name} for i, name in ids.items()} == found


def test_license_bodies(spark, monkeypatch):
    """Whole long licenses, some of their words changed, are told apart; a paragraph of one is not it; passes find what one pass finds."""
    r = random.Random(8)
    bodies = {name: text.split() for name, text in license_scan.known_templates()[len(license_scan.TEMPLATES) :]}
    assert {"gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0", "apache-2.0", "cc0-1.0"} == set(bodies)
    rows = []
    for i, words in enumerate(bodies.values()):
        changed = [w if r.random() > 0.01 else "altered" for w in words]
        rows += [(i, " ".join(["intro"] * 77 + changed + ["outro"] * 9)), (100 + i, " ".join(words[: len(words) // 5]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [(name, " ".join(words)) for name, words in bodies.items()]
    told = {}
    for size in (40, 500):
        monkeypatch.setattr(license_scan, "PASS_TEMPLATES", size)
        told[size] = {(x["doc_id"], x["license"], x["n_windows"], x["first_word"]) for x in license_scan.scan(df, wanted).collect()}
    assert told[40] == told[500]
    assert {(i, name) for i, name, *_ in told[40]} == {(i, name) for i, name in enumerate(bodies)}


def test_many_templates(spark):
    """Three hundred notices, more than a pass holds; of two with equal words the one that is held is told, both if both are."""
    notices = [(f"l{k:03d}", " ".join(f"n{k}w{j}" for j in range(12))) for k in range(300)] + [("same-a", "one notice of two names here"), ("same-b", "one notice of two names here")]
    rows = [(k, f"before {text} after") for k, (_, text) in enumerate(notices[:-1])]
    found = {(x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices).collect()}
    assert found == {(k, f"l{k:03d}") for k in range(300)} | {(300, "same-a"), (300, "same-b")}


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(900, 8)).round(2)
    vectors[5] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2100, [1.0, None] * 4), (2200, [float("nan")] * 8), (2300, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    monkey, kd_search.SHARD_ROWS = kd_search.SHARD_ROWS, 200
    try:
        found = {}
        for x in kd_search.top_k(df).collect():
            found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    finally:
        kd_search.SHARD_ROWS = monkey
    ints = np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64)
    assert set(found) == set(range(0, 900, 100))
    for q, got in found.items():
        scores = ints @ ints[q]
        want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != q))[:10]
        assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert kd_search.top_k(df.limit(0)).count() == 0


def test_top_k_hot_vectors_repeats_and_large_values(spark, monkeypatch):
    """A vector that a third of all rows hold, an id of many rows, two lengths, and products past 2^53."""
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 64)
    monkeypatch.setattr(kd_search, "BLOCK_ROWS", 2)
    r = np.random.default_rng(2)
    for size in (1.0, 1e5):
        rows = [(i, (r.normal(size=4) * size).tolist()) for i in range(500)] + [(i, [size, -size, 0.0, size]) for i in range(500, 750)]
        rows += [(777, [size, size, size, size])] * 30 + [(i, [size + i, -size]) for i in range(800, 1000, 25)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = {}
        for x in kd_search.top_k(df).collect():
            found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
        whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
        asked = {i: v for i, v in whole if i % 100 == 0}
        for q, v in asked.items():
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:10]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
        assert set(found) == set(asked)
