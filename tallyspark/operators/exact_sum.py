"""Correctly rounded sums of doubles per key, whatever the order of the rows.

A double is an integer times a power of two. Values are grouped by ranges of 32
exponents; within a range every value, scaled by one power of two, is an integer of
fewer than 88 bits, kept as a high and a low part whose sums are exact decimals. All
of that is a plain aggregation with partial sums. What is left are at most 68 ranges
per key, whose exact total is rounded once.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Context, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Exponents per range, bits of a low part, and the scale at which a range's values are integers.
RANGE, LOW_BITS, TOP = 32, 44, 53


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def range_parts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, range, high, low, odd): exact sums per range of exponents; ``odd`` sums what is not finite."""
    x = F.col(value).cast("double")
    fine = F.abs(x) < float("inf")  # NaN is above all numbers
    rows = df.select(*keys, F.when(fine & (x != 0), x).alias("_x"), F.when(~fine, x).alias("_odd"))
    rows = rows.withColumn("_range", F.floor(F.floor(F.log2(F.abs("_x"))) / RANGE))
    shift = F.lit(TOP) - RANGE * F.col("_range")
    half = F.floor(shift / 2)
    rows = rows.withColumn("_y", F.col("_x") * _power(half) * _power(shift - half))  # two steps: one power may overflow
    rows = rows.withColumn("_high", F.floor(F.col("_y") / float(1 << LOW_BITS)))
    low = (F.col("_y") - F.col("_high").cast("double") * float(1 << LOW_BITS)).cast("long")
    exact = lambda c: F.sum(c.cast("decimal(18,0)"))
    return rows.groupBy(*keys, "_range").agg(exact(F.col("_high")).alias("_high"), exact(low).alias("_low"), F.sum("_odd").alias("_odd"))


@F.pandas_udf(T.DoubleType())
def _rounded(ranges: pd.Series) -> pd.Series:
    def total(parts) -> float:
        exact = sum((Fraction((int(p["high"]) << LOW_BITS) + int(p["low"])) * Fraction(2) ** (RANGE * int(p["range"]) - TOP) for p in parts), Fraction(0))
        try:
            return float(exact)
        except OverflowError:
            return float("inf") if exact > 0 else float("-inf")

    return ranges.map(total)


def exact_sums(df: DataFrame, keys: Sequence[str], value: str, name: str = "exact_sum") -> DataFrame:
    """(keys, exact_sum): the sum of a key's values rounded once; nulls add nothing, infinities and NaN win."""
    keys = list(keys)
    parts = range_parts(df, keys, value)
    entry = F.when(F.col("_high").isNotNull(), F.struct(F.col("_range").alias("range"), F.col("_high").alias("high"), F.col("_low").alias("low")))
    gathered = parts.groupBy(*keys).agg(F.collect_list(entry).alias("_parts"), F.sum("_odd").alias("_odd"))  # at most 68 ranges
    return gathered.select(*keys, F.coalesce("_odd", _rounded("_parts")).alias(name))


@F.pandas_udf(T.StringType())
def two_places(values: pd.Series) -> pd.Series:
    """Two places, half to even, on a number's shortest decimal text."""
    wide = Context(prec=400, rounding=ROUND_HALF_EVEN)
    shown = lambda v: None if v is None or v != v or abs(v) == float("inf") else format(Decimal(repr(float(v))).quantize(Decimal("0.01"), context=wide), "f")
    return values.map(shown)
