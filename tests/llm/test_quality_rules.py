"""Quality rules against plain counts and a plain minimum covariance determinant."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def plain_vector(n, chars, symbols, lines, repeated):
    m = n + 100
    parts = (math.log((chars + 500) / m), math.log1p(10 * symbols / m), math.log1p(100 * lines / m), math.asin(math.sqrt(min(1, repeated / max(n, 1)))))
    return [min(math.floor(p * 1024 + 0.5), 16 * 1024) for p in parts]


def plain_estimate(x, factor=1.0):
    v = x / 1024
    return v.mean(0), factor * np.cov(v.T, bias=True).reshape(4, 4) + np.diag(np.square(Q.FLOOR))


def distances(x, mean, cov):
    off = x / 1024 - mean
    return np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)


def plain_mcd(x):
    quartiles = [np.percentile(x[:, i], [25, 50, 75]) for i in range(4)]
    spread = [((q[2] - q[0]) / 1024 / 1.349) ** 2 + f**2 for q, f in zip(quartiles, Q.FLOOR, strict=True)]
    found = [(np.array([q[1] / 1024 for q in quartiles]), np.diag(spread)), plain_estimate(x)]
    for _ in range(Q.STEPS):
        for k, at in enumerate(found):
            bands = np.floor(Q.CLASSES * np.log1p(distances(x, *at)))
            edge = np.sort(bands)[math.ceil(Q.KEEP * len(x)) - 1]
            found[k] = plain_estimate(x[bands <= edge])
    mean, cov = min(found, key=lambda e: np.linalg.det(e[1]))
    return plain_estimate(x[distances(x, mean, cov) <= Q.REWEIGHT * Q.RAW_FACTOR], Q.FINAL_FACTOR)


def corpus():
    r = random.Random(3)
    vocabulary = [f"{'abcdefgh'[i % 8] * (1 + i % 9)}{i}" for i in range(900)]
    rows = []
    for i in range(420):
        words = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 200]))]
        if i % 9 == 0:
            words = [w + r.choice(["***", "###", "&&&", ""]) for w in words]
        if i % 11 == 0:
            words[5:5] = words[20:29]
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\t", "\r\n"]) for w in words)
        if i % 13 == 0:
            text += "\nagain and again\n" * r.choice([1, 2, 40])
        rows.append((i, text, r.choice(["en", "en", "en", "de"]), r.choice(["hot", "hot", "hot", None])))
    odd = [None, "", " \n\t", "one", "a b c d e a b c d e", "a b c d e " * 30, "\x1c\x85é 日本 " * 9, "x " * 4, "same words here " * 6000, "ab " * 9 + "\n" + "ab " * 9 + "\n"]
    rows += [(1000 + i, t, None, "odd") for i, t in enumerate(odd)] + [(None, "no id at all here", None, None)] + rows[:5]
    return rows


def test_counts_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS cell", "2 AS mean", "3 AS n", "4 AS _words").repartition(5)
    found = Q.quality_rules(docs).collect()
    told = [(i, plain_counts(t), (lang, source)) for i, t, lang, source in rows]
    assert Counter((r["doc_id"], *(r[c] for c in Q.COUNTS)) for r in found) == Counter((i, *c) for i, c, _ in told)
    failed = {c: c[0] < 10 or 100 * c[4] > 20 * c[0] for _, c, _ in told}
    sizes = Counter(p for _, c, p in told if not failed[c])
    cells = {}
    for _, c, p in told:
        if not failed[c]:
            cells.setdefault(p if sizes[p] >= Q.MIN_ROWS else None, []).append(plain_vector(*c))
    assert len(cells) == 2
    fits = {p: plain_mcd(np.array(x, float)) for p, x in cells.items()}
    want, close = Counter(), 0
    for i, c, p in told:
        d = distances(np.array([plain_vector(*c)], float), *fits[p if sizes[p] >= Q.MIN_ROWS else None])[0]
        close += abs(d - Q.CUTOFF) < 1e-6
        want[(i, failed[c], not failed[c] and d <= Q.CUTOFF, round(float(d), 6))] += 1
    assert not close
    assert Counter((r["doc_id"], r["base_failed"], r["kept"], round(r["distance"], 6)) for r in found) == want
    verdicts = {r["doc_id"]: r["kept"] for r in found}
    assert not any(verdicts[i] for i in range(0, 420, 9) if failed[plain_counts(rows[i][1])] is False and rows[i][1].count("*") + rows[i][1].count("#") > 60)
    assert all(verdicts[i] for i in range(420) if i % 9 and i % 11 and i % 13)


@pytest.mark.parametrize("texts", [[], ["word " * 20], [None, ""], ["all of these words are found in every text of the table"] * 3])
def test_small_tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = Q.quality_rules(docs).collect()
    assert [r["kept"] for r in found] == [t == "all of these words are found in every text of the table" for t in texts]
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))


def test_outliers_do_not_hide_each_other(spark):
    """A quarter of a cell, all alike, neither shifts its centre nor widens it."""
    r = random.Random(4)
    sound = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([3, 4, 5, 6, 7]))) for _ in range(120))
    rows = [(i, sound() if i % 4 else " ".join(f"{w}$$$" for w in sound().split()), "en", "s") for i in range(200)]
    found = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in found) and len(found) == 200
