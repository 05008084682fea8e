"""Monthly totals of arriving files: late files, batches that fail midway, batches that run twice."""

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import versions
from tallyspark.streaming import incremental

COLUMNS = ["Open Time", "Profit"]


def land(folder, name, rows):
    (folder / name).write_text("Open Time,Profit\n" + "".join(f"{t},{p}\n" for t, p in rows))


def totals(spark, path):
    return {(r["journal_id"].rsplit("/", 1)[1], r["month"]): (r["profit"], r["n_rows"]) for r in versions.load(spark, path).collect()}


def test_batches_are_added_once(spark, tmp_path, monkeypatch):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    run = lambda: incremental.keep_current(incremental.arriving_rows(spark, str(folder), COLUMNS), path, checkpoint).awaitTermination()
    land(folder, "a.csv", [("2031-01-02 10:00:00", 5), ("2031-01-31 23:59:59", -2), ("2031-02-01 00:00:00", 1), ("soon", 9)])
    run()
    want = {("a.csv", "2031-01"): (3, 2), ("a.csv", "2031-02"): (1, 1)}
    assert totals(spark, path) == want
    opened = versions.load(spark, path)

    land(folder, "b.csv", [("2031-01-02 10:00:00", "x"), ("2031-01-03 10:00:00", 4)])
    real = versions.write

    def breaks(df, *args, **named):
        df.write.parquet(str(tmp_path / "half"))  # some data stand, the version does not
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "write", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    assert totals(spark, path) == want
    monkeypatch.setattr(versions, "write", real)
    run()
    want |= {("b.csv", "2031-01"): (4, 2)}
    assert totals(spark, path) == want
    assert opened.count() == 2  # a reader keeps its version

    last = versions.last_tag(spark, path)
    again = spark.createDataFrame([("file:/in/a.csv", "2031-01-05 10:00:00", 100.0)], "journal_id string, t string, Profit double").withColumn("Open Time", F.col("t").cast("timestamp_ntz"))
    incremental.merge(again, last, path)  # as after a stop between the version and the stream's own mark
    assert totals(spark, path) == want
    name = versions.load(spark, path).filter(F.col("journal_id").endswith("a.csv")).first()["journal_id"]
    incremental.merge(again.withColumn("journal_id", F.lit(name)), last + 1, path)
    assert totals(spark, path) == want | {("a.csv", "2031-01"): (103, 3)}
    run()
    assert totals(spark, path)["a.csv", "2031-01"] == (103, 3)
