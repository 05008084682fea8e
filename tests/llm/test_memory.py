"""What a worker takes at a time is bounded, and how it is cut changes no result."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import jaccard_tree, language_id, quality, toxicity
from tallyspark.llm import words as W

LEXICON = toxicity.word_keys(["rotter", "wretch"])
WEIGHTS = np.random.default_rng(3).normal(size=(1 << 18) + 1)


def texts(n, words):
    rng = random.Random(7)
    some = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)] + ["rotter", "YOU", "wr3tch", "l\u00e9ger"]
    return [" ".join(rng.choices(some, k=rng.randint(0, words))) for _ in range(n)] + ["", "x" * 300_000]


def lowered(rows):
    return language_id.lowered(pa.array([r.decode() for r in rows]))


WORK = {
    "train": lambda rows: [np.concatenate(x) for x in quality.sparse_rows(rows, 18)],
    "quality": lambda rows: quality.score_blocks(rows, WEIGHTS, 18),
    "toxicity": lambda rows: toxicity.vectors(rows, lowered(rows), LEXICON),
    "shingles": lambda rows: list(jaccard_tree.shingle_sets(rows)),
}


@pytest.mark.parametrize("name", WORK)
def test_blocks_change_no_result(name, monkeypatch):
    rows = [t.encode() for t in texts(300, 400)]
    found = []
    for size in (1, 5000, W.BLOCK_BYTES, 1 << 20):
        monkeypatch.setattr(W, "BLOCK_BYTES", size)
        found.append(WORK[name](rows))
    for other in found[1:]:
        assert len(other) == len(rows) and all(np.array_equal(a, b) for a, b in zip(found[0], other, strict=True))


@pytest.mark.parametrize("name", WORK)
def test_a_block_takes_little(name, monkeypatch):
    """Beside what the texts and the results themselves hold."""
    rows = [t.encode() for t in texts(2000, 500)[:-1]]
    assert sum(map(len, rows)) > 3e6
    monkeypatch.setattr(W, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    tracemalloc.start()
    if name == "train":
        for _ in quality.sparse_rows(rows, 18):
            pass
    elif name == "shingles":
        for _ in jaccard_tree.shingle_sets(rows):
            pass
    else:
        WORK[name](rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6


def test_batches_of_long_texts_end_early(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        W.small_batches(spark)
        found = spark.range(0, 120, 1, 1).selectExpr("id", "repeat('long text ', 40000) AS text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 120 and max(r["size"] for r in found) <= W.BATCH_BYTES + 500_000
        huge = spark.range(0, 3, 1, 1).selectExpr("repeat('long text ', 700000) AS text").mapInArrow(sizes, "n long, size long").collect()
        assert [r["n"] for r in huge] == [1, 1, 1]
        spark.conf.set(keys[1], "1m")
        W.small_batches(spark)
        assert spark.conf.get(keys[1]) == "1m"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
