"""Joins on keys of which a few may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is met in ``SALTS`` parts.
MANY_ROWS = 1000
SALTS = 16


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of ``MANY_ROWS`` rows or more; each task sends one count per key."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter((F.col("_n") >= MANY_ROWS) & F.col(key).isNotNull()).select(key)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` and the other columns of ``keyed``, whose ``key`` is unique; nulls where it has none.

    Keys are 0 or more. A key of many rows is met in ``SALTS`` parts: ``keyed`` is
    repeated for those keys only. What is met by then, and a null key, goes on under a
    negative key of the row's own, so no key gathers its rows in one task. ``keyed``
    grows with the data and is never broadcast. A value named like a column of
    ``rows`` is not brought along.
    """
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    names, values = rows.columns, [c for c in keyed.columns if c != key and c not in rows.columns]
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    large = keyed.join(heavy, key).select(key, F.struct(*values).alias("_large"), parts.alias("_salt"))
    spread = F.xxhash64(*names)
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    met = salted.join(large, [key, "_salt"], "left").drop("_salt")
    own = -1 - F.pmod(spread, F.lit(1 << 40))
    met = met.withColumn("_key", F.when(F.col("_large").isNull(), F.coalesce(key, own)).otherwise(own))
    small = keyed.select(F.col(key).alias("_key"), F.struct(*values).alias("_small"))
    found = met.join(small.hint("merge"), "_key", "left").withColumn("_value", F.coalesce("_large", "_small"))
    return found.select(*names, *(F.col(f"_value.{c}").alias(c) for c in values))
