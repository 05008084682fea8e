"""Kept summaries and versioned tables after late rows, changed journals and writes that fail."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import prefix_scan, segments
from tallyspark.sources import versions

ORDER = ["t", "n"]


def trades(spark, seed, count, start=0):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "a", "b"]), start + i, dt.datetime(2031, 1, r.randint(1, 6), r.randint(0, 23)) if r.random() > 0.05 else None, r.choice([None, *map(float, range(-9, 10))])) for i in range(count)]
    return spark.createDataFrame(rows, "journal_id string, n int, t timestamp_ntz, Profit double").repartition(3)


def plain(rows):
    out = {}
    for r in sorted((r for r in rows if r["t"]), key=lambda r: (r["t"], r["n"])):
        level, peak, fall, n = out.get(r["journal_id"], (0.0, 0.0, 0.0, 0))
        level += r["Profit"] or 0
        peak = max(peak, level)
        out[r["journal_id"]] = (level, peak, max(fall, peak - level), n + 1)
    return {k: (n, level, fall) for k, (level, _, fall, n) in out.items()}


def drawn(days):
    return {r["journal_id"]: (r["rows"], pytest.approx(r["total"]), pytest.approx(r["max_drawdown"])) for r in segments.drawdowns(days).collect()}


def test_late_rows_change_only_their_days(spark):
    whole = trades(spark, 1, 300)
    stored = segments.day_summaries(whole, "Profit", ORDER, "t", partitions=9)
    assert plain(whole.collect()) == drawn(stored)
    for k in range(3):
        late = trades(spark, 10 + k, 4 + 20 * k, 1000 * (k + 1))
        if k == 2:
            late = late.withColumn("journal_id", F.lit("new"))
        before = {(r["journal_id"], r["day"]): tuple(r) for r in stored.collect()}
        whole = whole.unionByName(late).cache()
        stored = segments.refreshed(stored, late, whole, "Profit", ORDER, "t").cache()
        assert plain(whole.collect()) == drawn(stored)
        touched = {(r["journal_id"], r["t"].date()) for r in late.collect() if r["t"]}
        after = {(r["journal_id"], r["day"]): tuple(r) for r in stored.collect()}
        assert all(after[key] == value for key, value in before.items() if key not in touched)
    scanned = prefix_scan.max_drawdown(whole.filter("t IS NOT NULL"), "Profit", ORDER, ["journal_id"]).collect()
    assert {r["journal_id"]: r["max_drawdown"] for r in scanned} == {k: v[2] for k, v in drawn(stored).items()}
    assert drawn(segments.day_summaries(whole.limit(0), "Profit", ORDER, "t")) == {}


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(f"j{i % 20}", i, float(i)) for i in range(100)], "journal_id string, row_ord long, Profit double")
    shown = lambda df: sorted((r["journal_id"], r["row_ord"], r["Profit"]) for r in df.collect())
    assert versions.manifest(spark, path) == (0, {})
    with pytest.raises(ValueError, match="no rows"):
        versions.load(spark, path)
    assert versions.write(rows, path) == 1
    first = versions.load(spark, path)
    pinned, kept = shown(first), files_of(path)
    assert pinned == shown(rows)

    changed = spark.createDataFrame([("j3", 0, -1.0, "new"), ("j99", 0, 5.0, None)], "journal_id string, row_ord long, Profit double, Notes string")
    assert versions.write(changed, path) == 2
    want = sorted([x for x in pinned if x[0] != "j3"] + [("j3", 0, -1.0), ("j99", 0, 5.0)])
    assert shown(versions.load(spark, path)) == want and shown(first) == shown(versions.load(spark, path, 1)) == pinned
    assert kept.items() <= files_of(path).items()  # nothing that stood has been written again
    _, before = versions.manifest(spark, path, 1)
    _, after = versions.manifest(spark, path, 2)
    assert sum(before.get(b) != f for b, f in after.items()) <= 2

    broken = changed.withColumn("Profit", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        versions.write(broken, path)
    assert versions.manifest(spark, path)[0] == 2 and shown(versions.load(spark, path)) == want

    gone = rows.select("journal_id").distinct()
    assert versions.write(rows.limit(0), path, journals=gone) == 3
    assert shown(versions.load(spark, path)) == [("j99", 0, 5.0)]
    versions.write(rows.limit(0), path, journals=spark.createDataFrame([("j99",)], "journal_id string"))
    with pytest.raises(ValueError, match="no rows"):
        versions.load(spark, path)
    with pytest.raises(ValueError, match="no version"):
        versions.load(spark, path, 77)
