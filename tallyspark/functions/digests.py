"""Order-independent digests of whole tables, as a tree of partial digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import settled


def row_digest(columns: Sequence[Column]) -> Column:
    """sha256 of the row's values in the given order, nulls told apart from blanks."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


#: First hex digits of a row's digest that a leaf's rows share, then those that each higher level's do.
PREFIXES = (9, 6, 3, 0)


def table_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[Column], name: str = "sha256") -> DataFrame:
    """Per key: one digest that does not depend on row order.

    Row digests are counted per value first (copies cost one row). A tree of digests
    follows: the entries that share nine first hex digits give one, then those that
    share six, three and none. A node has at most 4096 children, and a leaf a few
    rows even of a key with 10^11 rows, so no task sees a whole key.
    """
    rows = df.select(*keys, row_digest(columns).alias("d")).groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    level = rows.select(*keys, F.col("d").alias("path"), F.concat_ws(":", "d", F.col("n").cast("string")).alias("entry"), "n")
    for digits in PREFIXES:
        node = F.substring("path", 1, digits) if digits else F.lit("")
        level = level.groupBy(*keys, node.alias("path")).agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("entry")), "|"), 256).alias("digest"), F.sum("n").alias("n")
        )
        level = level.select(*keys, "path", "digest", F.concat_ws(":", "path", "digest").alias("entry"), "n")
    return level.select(*keys, F.col("digest").alias(name), F.col("n").alias("n_rows"))


#: Digits of a stored entry that stands for one distinct row.
ROW = 64


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """(digits, keys, path, digest, n): every node of the tree of ``table_digest``, its root (0 digits) down to each distinct row (``ROW`` digits).

    Stored by ``digits``, two trees can be compared without the tables that they stand for.
    """
    rows = df.select(*keys, row_digest(columns).alias("d")).groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    level = settled(rows.select(F.lit(ROW).alias("digits"), *keys, F.col("d").alias("path"), F.concat_ws(":", "d", F.col("n").cast("string")).alias("digest"), "n"))
    tree = level
    entry = F.col("digest")
    for digits in PREFIXES:
        node = F.substring("path", 1, digits) if digits else F.lit("")
        level = level.groupBy(*keys, node.alias("path")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "|"), 256).alias("digest"), F.sum("n").alias("n"))
        level = settled(level.select(F.lit(digits).alias("digits"), *keys, "path", "digest", "n"))
        tree = tree.unionByName(level)
        entry = F.concat_ws(":", "path", "digest")
    return tree


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row_digest, n_before, n_after) of the rows whose number differs between two stored trees; keys are not null.

    The descent compares roots first and goes on below nodes that differ only, so what is
    read of a level is what hangs below a difference.
    """
    above, digits_above = None, 0
    for digits in (*reversed(PREFIXES), ROW):
        sides = []
        for tree, name in ((before, "before"), (after, "after")):
            rows = tree.filter(F.col("digits") == digits).select(*keys, "path", F.col("digest").alias(f"digest_{name}"), F.col("n").alias(f"n_{name}"))
            if above is not None:
                rows = rows.withColumn("_above", F.substring("path", 1, digits_above) if digits_above else F.lit("")).join(above, [*keys, "_above"], "left_semi").drop("_above")
            sides.append(rows)
        differ = sides[0].join(sides[1], [*keys, "path"], "full").filter(~F.col("digest_before").eqNullSafe(F.col("digest_after")))
        found = settled(differ.select(*keys, "path", "n_before", "n_after"))
        above, digits_above = found.select(*keys, F.col("path").alias("_above")), digits
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select(*keys, F.col("path").alias("row_digest"), zero("n_before"), zero("n_after"))
