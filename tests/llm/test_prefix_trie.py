"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()
    for turns in own.values():
        turns.sort(key=lambda t: (*t[:2], digest(t)))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(t[2:] for t in own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves[node] or 1
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    hashed = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashed(ends[n])) for n, m in members.items()]


def corpus():
    r = random.Random(6)
    rows = []
    for c in [*range(0, 260), 300, 305, 417, 1200, 1201, 123456789012]:
        n = r.choice([1, 2, 3, 5, 8, 30 if c % 50 == 7 else 4])
        rows += [(c, t, ["user", "assistant"][t % 2], r.choice(["yes", "no", "Ünï", f"only {c} {t}"]) * r.choice([1, 1, 2])) for t in range(n)]
    rows += [(c, t, "user", f"copied {t}") for c in range(2000, 2100) if c != 2000 for t in range(8)]
    rows += [(500, None, None, None), (500, 1, None, ""), (500, 1, "user", "tie"), (500, 1, "user", "another"), (500, 1, "user", "tie"), (None, 1, "user", "x"), (501, 3, "", "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [200_000, 150, 7])
def test_trie(spark, monkeypatch, turns):
    """One task, some dozens, and so many that chains take several rounds."""
    monkeypatch.setattr(prefix_trie, "TURNS_PER_TASK", turns)
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 3)
    rows = corpus()
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS low", "3 AS n", "'x' AS host").repartition(6))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(5, None, None, None)], [(107, 0, "user", "gone")], [(100, t, "u", "x" * t) for t in range(1500)]])
def test_few_rows(spark, rows):
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(plain(rows))
