"""Digest trees: their roots, and the rows that differ between two of them."""

from collections import Counter

from pyspark.sql import functions as F

from tallyspark.functions import digests


def test_changed_rows(spark, tmp_path):
    rows = [(f"j{i % 3}", i, None if i % 7 == 0 else f"v{i % 40}") for i in range(300)] + [("j0", 0, None)]
    other = [r for r in rows if r[1] % 50 != 9] + [("j1", 7777, "new"), ("j2", 11, "v11"), ("j9", 1, "only here")]
    columns = [F.col("i"), F.col("v")]
    frames = [spark.createDataFrame(x, "journal_id string, i int, v string").repartition(3) for x in (rows, other)]
    for k, df in enumerate(frames):
        digests.digest_tree(df, ["journal_id"], columns).write.partitionBy("digits").parquet(f"{tmp_path}/{k}")
    trees = [spark.read.parquet(f"{tmp_path}/{k}") for k in range(2)]
    for df, tree in zip(frames, trees, strict=True):
        roots = {(r["journal_id"], r["digest"], r["n"]) for r in tree.filter("digits = 0").collect()}
        assert roots == {tuple(r) for r in digests.table_digest(df, ["journal_id"], columns).collect()}
    of = {r["d"]: (r["journal_id"], r["i"], r["v"]) for df in frames for r in df.withColumn("d", digests.row_digest(columns)).collect()}
    found = {(r["journal_id"], *of[r["row_digest"]][1:], r["n_before"], r["n_after"]) for r in digests.changed_rows(*trees, ["journal_id"]).collect()}
    a, b = Counter(rows), Counter(other)
    assert found == {(*r, a[r], b[r]) for r in a.keys() | b.keys() if a[r] != b[r]}
    assert digests.changed_rows(trees[0], trees[0], ["journal_id"]).count() == 0
