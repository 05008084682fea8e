"""Connected components of an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import drop, materialize
from tallyspark.llm.skew import heavy_keys, spread_join


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, label, moved) of every id in ``edges`` (a, b): label is the smallest id it reaches.

    Each round takes the smallest label among an id's neighbours and then the
    label of that label, so the distance covered doubles; rounds are written to
    shared tables, and those of the round before are removed. Neighbours' labels are
    reduced before they are shuffled, and an id with very many edges, or a label with
    very many ids, is met in parts. Ids are 0 or more; null ids are no ids; an empty
    table gives an empty one.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, f"{name}-edges")
    hubs = materialize(heavy_keys(both, "b"), f"{name}-hubs")
    first = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = materialize(first.select(F.col("a").alias("id"), F.least("a", "b").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = labels.select(F.col("id").alias("b"), F.col("label").alias("near"))
        around = spread_join(both, near, "b", hubs).groupBy("a").agg(F.min("near").alias("near"))
        better = labels.join(around.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        better = materialize(better, f"{name}-{step}a")
        drop(labels)
        onward = better.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = spread_join(better, onward, "label").select(
            "id", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("moved")
        )
        labels = materialize(labels, f"{name}-{step}b")
        drop(better)
        if labels.filter("moved").isEmpty():
            drop(both, hubs)
            return labels
