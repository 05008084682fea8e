"""Tables of journals in versions: a write replaces the buckets of the journals that it brings, and readers keep their version.

A version is a manifest, one file that says for each bucket which folder holds its rows. Data
are written first, to a new folder; the manifest comes last and appears whole or not at
all, so a write that fails leaves the version before it as it was. Buckets without
changed journals keep their files. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "journal_bucket"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, str]]:
    """(version, bucket -> folder) of a version or the last one; (0, {}) before the first. A row per bucket."""
    try:
        told = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:  # no version has been written
        return 0, {}
    wanted = version if version is not None else told.agg(F.max("version")).first()[0]
    found = {r["bucket"]: r["folder"] for r in told.filter(F.col("version") == wanted).collect()}
    if version and not found:
        raise ValueError(f"there is no version {version}")
    return wanted or 0, found


def last_tag(spark: SparkSession, path: str) -> int:
    """The highest tag that a version was written with, -1 without any: what a restarted writer has done already."""
    try:
        told = spark.read.option("mergeSchema", True).parquet(f"{path}/manifest")
    except AnalysisException:
        return -1
    found = told.agg(F.max("tag")).first()[0]
    return -1 if found is None else found


def _rows(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame | None:
    if not folders:
        return None
    names = [f"{path}/data/{folder}/{BUCKET}={bucket}" for bucket, folder in sorted(folders.items())]
    return spark.read.option("mergeSchema", True).parquet(*names)


def write(df: DataFrame, path: str, journals: DataFrame | None = None, buckets: int = BUCKETS, tag: int | None = None) -> int:
    """Replace the journals in ``df``, and those in ``journals`` of which it has no rows, and return the new version.

    The rows of a bucket that changes are written again, in journal order; the others stay where they are. Columns
    that only some rows have are null in the others. ``tag`` is kept with the version.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("journal_id"), F.lit(buckets)).cast("int")
    last, before = manifest(spark, path)
    changed = df.select("journal_id").distinct()
    changed = changed if journals is None else changed.unionByName(journals.select("journal_id")).distinct()
    touched = [r[0] for r in changed.select(bucket.alias("b")).distinct().collect()]
    rows = df.withColumn(BUCKET, bucket)
    kept = _rows(spark, path, {b: f for b, f in before.items() if b in touched})
    if kept is not None:
        kept = kept.join(changed, "journal_id", "left_anti").withColumn(BUCKET, bucket)
        rows = rows.unionByName(kept, allowMissingColumns=True)
    folder = uuid.uuid4().hex
    order = [BUCKET, "journal_id", *(["row_ord"] if "row_ord" in rows.columns else [])]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(BUCKET).parquet(f"{path}/data/{folder}")
    # A bucket whose last journal has gone has no folder.
    present = {r[0] for r in rows.select(BUCKET).distinct().collect()}
    now = {b: f for b, f in before.items() if b not in touched} | {b: folder for b in present}
    entries = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(f).alias("folder")) for b, f in now.items())) if now else F.array(F.struct(F.lit(-1).alias("bucket"), F.lit("").alias("folder")))
    spark.range(1).select(F.inline(entries)).withColumn("tag", F.lit(tag).cast("long")).coalesce(1).write.parquet(f"{path}/manifest/version={last + 1}")
    return last + 1


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the last one now; what is written later does not change them."""
    _, folders = manifest(spark, path, version)
    found = _rows(spark, path, {b: f for b, f in folders.items() if b >= 0})
    if found is None:
        raise ValueError(f"{path} holds no rows")
    return found
