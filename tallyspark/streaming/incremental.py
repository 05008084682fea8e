"""Incremental upkeep of journal measures as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions.cleaning import number, recorded_time
from tallyspark.session import settled
from tallyspark.sources import versions


def arriving_rows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Rows of journal files of one header as they land in ``folder``, dates and profits parsed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(folder)
    return rows.withColumns({"journal_id": F.col("_metadata.file_path"), "Profit": number(F.col("Profit")), "Open Time": recorded_time(F.col("Open Time"))})


def monthly_profit(rows: DataFrame) -> DataFrame:
    """(journal_id, month, profit, n_rows); null dates take no part."""
    month = F.date_format("Open Time", "yyyy-MM").alias("month")
    dated = rows.filter(F.col("Open Time").isNotNull())
    return dated.groupBy("journal_id", month).agg(F.sum(F.coalesce("Profit", F.lit(0.0))).alias("profit"), F.count(F.lit(1)).alias("n_rows"))


def merge(batch: DataFrame, batch_id: int, path: str) -> None:
    """Add a batch's rows to the totals at ``path``, once: a batch whose version stands is not added again.

    Only the journals of the batch are read and written again. The version, with the batch's
    number, appears whole or not at all, so a batch that fails midway is added by its next run.
    """
    spark = batch.sparkSession
    if versions.last_tag(spark, path) >= batch_id:
        return
    sums = settled(monthly_profit(batch))
    if sums.isEmpty():
        return
    if versions.manifest(spark, path)[1]:
        known = versions.load(spark, path).join(sums.select("journal_id").distinct(), "journal_id", "left_semi")
        sums = known.select(sums.columns).unionByName(sums).groupBy("journal_id", "month").agg(F.sum("profit").alias("profit"), F.sum("n_rows").alias("n_rows"))
    versions.write(settled(sums), path, tag=batch_id)


def keep_current(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the monthly totals at ``path`` (``versions.load``) up to date with the stream's rows; a restart goes on from ``checkpoint``.

    The stream keeps no state of its own; readers hold the version that they have opened.
    """
    add = lambda batch, batch_id: merge(batch, batch_id, path)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
