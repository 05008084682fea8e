"""The Merkle manifest against a plain one."""

import hashlib
import random
import zlib

import pytest

from tallyspark.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """(root, per leaf the siblings left and right of each level)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, range(len(places)), strict=True):
            at = places[i]
            first = at - at % 16
            path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
            places[i] = at // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    leaf = lambda r: sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in FIELDS))
    sources = {}
    for r in rows:
        other = dict(r)
        if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            other["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(other)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(sources[s])]) for s in order]
    out = []
    if order:
        root, upper = climb([t[0] for t in trees])
        for source, (subroot, paths), above in zip(order, trees, upper, strict=True):
            for (known, doc_id, mine, other), path in zip(sorted(sources[source]), paths, strict=True):
                folded = other
                for left, right in path + above:
                    folded = sha(left + folded + right)
                proof = sha("".join(a + b for a, b in path + above))
                out.append((doc_id if known else None, mine, subroot, root, proof, folded, folded == root))
    return out


def same(docs):
    found = merkle.manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    return want


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_odd_rows(spark):
    r = random.Random(1)
    texts = [None, "", "Ab", "x y", "ÄB é", "日本 A", "Long text " * 4000]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "a", "é", "z", "Z"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice(texts)) for _ in range(300)]
    rows += rows[:40]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = same(docs.selectExpr("*", "1 AS k", "2 AS at", "3 AS n", "'x' AS h", "4 AS steps", "5 AS own"))
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_few_rows(spark, n):
    same(spark.createDataFrame([(i, "s", None, i, f"T{i}") for i in range(n)], SCHEMA))


def test_beyond_a_block(spark):
    """A source of more than one block beside many small ones, and more sources than a run."""
    hot = "if(id < 9000, 'hot', concat('s', id % 40))"
    same(spark.range(9500).selectExpr("id * 7 AS doc_id", f"{hot} AS source", "'en' AS lang", "id AS n_chars", "concat('Text ', id) AS text"))
