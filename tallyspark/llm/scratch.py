"""Intermediate tables in the folder that all executors share.

A job that must cut its lineage writes a Parquet table below
``spark.checkpoint.dir`` and goes on from that table, so a lost executor costs
no more than the tasks it ran. Tables hold what they are given, nulls and clashing
names included; an empty table is written as such.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session, as in tests, may do without: it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tally-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Table read back -> its folder, for the tables that may still be dropped.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared table and return the reader of that table.

    All tables of an application lie in one folder, which may go once it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tally/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no table still to be read rests on."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
