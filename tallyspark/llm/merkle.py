"""Merkle manifest of a dataset: leaves, roots, inclusion proofs and their check (operator 13).

A row's leaf digests its five fields. Per source the leaves ascend by id, and every
16 consecutive nodes of a level hash to one of the next; what remains per source is
its subroot, and the subroots, ordered by source, give the root in the same way.

Three levels share a shuffle: rows lie by blocks of 4096 places, ordered by place. On
each level the nodes are the rows that are some node's first descendant; lag and lead
columns of fixed offsets (1 to 15 places of that level), masked by the node's slot and
its run's length, supply its siblings, first-child rows hash their parents, and a node's
siblings are carried on to its descendants' rows. Blocks' digests are the leaves of the
next three levels, so a source of any size takes a round per factor of 4096, and no task
sees more than a block of it at once. Proofs are never gathered: a row meets its block's
upper siblings by (source, block).

Places come from one range partitioning by (source, id, leaf, a row's own number) and
prefix sums over a row per partition and source.

Edge cases: null fields are ``-``; a null id comes first and is not tampered with; rows
of one id follow in the order of their leaves, and each equal row is a leaf of its own; a
null source is a source that comes before all others; a lone leaf is its subroot, and a
lone subroot the root, with the digest of nothing as proof; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import drop, materialize

FAN = 16
#: Levels that share a shuffle, and the leaves below their common top.
LEVELS = 3
BLOCK = FAN**LEVELS
#: What tells the fields of a leaf: their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the fields: ``-`` if null, else length in bytes, colon, value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def tampered_text(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (k and others) with ``at``, the place within its k from 0 on, and ``n``, the rows of that k.

    ``order`` must tell all rows apart, as a hot key's rows are dealt to many tasks.
    """
    keys = ["k", *order]
    lines = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()  # the partition above, the row's place in it below
    table = lines.select("*", number.alias("_number"), F.spark_partition_id().alias("_pid"))
    table = materialize(table, name)
    parts = table.groupBy("k", "_pid").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_k = Window.partitionBy("k")
    before = F.sum("_n").over(of_k.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("k", "_pid", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_k).alias("n"))
    found = table.join(parts, ["k", "_pid"]).withColumn("at", F.col("_before") + F.col("_number") - F.col("_first"))
    return found.drop("_pid", "_number", "_first", "_before")


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes`` (k, at, n, h) with ``block``, ``steps`` (siblings left and right, a step per level) and ``top``.

    ``top`` is the block's digest on its first row, null on the others. A level with a
    single node of a k is no step.
    """
    rows = nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
    order = Window.partitionBy("k", "block").orderBy("at")
    steps, node = [], "h"
    for level in range(LEVELS):
        span = FAN**level
        place, count = F.floor(F.col("at") / span), F.ceil(F.col("n") / span)
        slot = place % FAN
        length = F.least(F.lit(FAN), count - (place - slot))
        lags = [F.when(slot >= j, F.lag(node, span * j).over(order)) for j in range(FAN - 1, 0, -1)]
        leads = [F.when(slot + j < length, F.lead(node, span * j).over(order)) for j in range(1, FAN)]
        mine = F.struct(F.concat_ws("", *lags).alias("left"), F.concat_ws("", *leads).alias("right"))
        live = count > 1
        rows = rows.withColumn(f"_s{level}", F.when(live & (F.col("at") % span == 0), mine))
        if level:  # carried on to the rows below the node
            rows = rows.withColumn(f"_s{level}", F.last(f"_s{level}", True).over(order))
        step, first = F.col(f"_s{level}"), F.col("at") % (span * FAN) == 0
        parent = F.when(live, digest(step["left"], F.col(node), step["right"])).otherwise(F.col(node))
        rows = rows.withColumn(f"_h{level + 1}", F.when(first, parent))
        steps, node = [*steps, step], f"_h{level + 1}"
    rows = rows.withColumns({"steps": F.array_compact(F.array(*steps)), "top": F.col(node)})
    return rows.drop(*(f"_s{j}" for j in range(LEVELS)), *(f"_h{j + 1}" for j in range(LEVELS)))


def to_root(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``nodes`` (k, at, n, h) with ``steps`` up to the last digest of their k and on, and what ``above`` tells.

    ``above`` takes a row (k, h) per k, its last digest, and adds ``up``, the steps from there, and other columns.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rows = climb(nodes)
    tops = rows.filter(F.col("top").isNotNull()).select("k", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("h"))
    tops = materialize(tops, f"{name}-tops")
    if largest <= BLOCK:
        upper = above(tops.select("k", "h")).withColumn("block", F.lit(0).cast("long")).drop("h")
    else:
        upper = to_root(tops, above, name).drop("n", "h").withColumnsRenamed({"at": "block", "steps": "up"})
    # Met by block: a hot source's rows go to many tasks, as they do in climb.
    return rows.drop("top").join(upper, ["k", "block"]).withColumn("steps", F.concat("steps", "up")).drop("block", "up")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: leaf, subroot, root, digest of its proof, and the root folded from its tampered or own leaf."""
    fields = {c: F.col(c) for c in FIELDS}
    whole = leaf(list(fields.values()))
    other = leaf([tampered_text(v) if c == "text" else v for c, v in fields.items()])
    changed = F.when(is_tampered(F.col("doc_id")), other)
    k = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # null first, then bytewise
    leaves = materialize(docs.select("doc_id", k.alias("k"), whole.alias("h"), changed.alias("changed"), F.monotonically_increasing_id().alias("own")), "leaves")
    table = materialize(placed(leaves, ["doc_id", "h", "own"], "leaves-in-order").drop("own"), "leaves-placed")
    drop(leaves)

    def sources(tops: DataFrame) -> DataFrame:
        subroots = materialize(placed(tops.select(F.lit("").alias("k"), F.col("k").alias("source"), "h"), ["source"], "sources"), "sources-placed")
        alone = lambda last: last.select("*", F.col("h").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("up"))
        return to_root(subroots, alone, "sources").select(F.col("source").alias("k"), F.col("h").alias("subroot"), F.col("steps").alias("up"), "root", "h")

    found = to_root(table, sources, "leaves")
    siblings = F.flatten(F.transform("steps", lambda s: F.array(s["left"], s["right"])))
    folded = F.aggregate("steps", F.coalesce("changed", "h"), lambda below, s: digest(s["left"], below, s["right"]))
    judged = found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB: crc32 of each id's decimal text, one character after the other, by the usual table of 256 remainders.
CRC_SQL = """
  bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
  remainders AS (SELECT i, c FROM bits WHERE k = 8),
  states(id, text, k, c) AS (SELECT id, CAST(id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL SELECT s.id, s.text, s.k + 1, xor(s.c >> 8, r.c) FROM states s JOIN remainders r ON r.i = xor(s.c & 255, ascii(s.text[s.k + 1])) WHERE s.k < length(s.text)),
  crcs AS (SELECT id, xor(c, 4294967295) AS crc FROM states WHERE k = length(text))"""


def _levels_sql(name: str, first: str, levels: int) -> str:
    """Common tables name0, name1, ...: (k, pos, h, n, l, r), the digests and siblings of each level; ``first`` gives (k, pos, h)."""
    run = f"PARTITION BY k, pos // {FAN} ORDER BY pos ROWS BETWEEN"
    out = []
    for j in range(levels + 1):
        up = f"SELECT k, pos // {FAN} AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h FROM {name}{j - 1} GROUP BY k, pos // {FAN}"
        sides = f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
        out.append(f"{name}{j} AS (SELECT k, pos, h, count(*) OVER (PARTITION BY k) AS n, {sides} FROM ({up if j else first}))")
    return ",\n  ".join(out)


def oracle(levels: int = 6, source_levels: int = 4) -> str:
    """DuckDB SQL of ``manifest``: its levels are written out, enough for 16^6 rows of a source and 16^4 sources."""
    field = lambda c, v: f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"
    whole = f"sha256({' || '.join(field(c, c) for c in FIELDS)})"
    other = f"sha256({' || '.join(field(c, f"translate(text, '{UPPER}', '{LOWER}')" if c == 'text' else c) for c in FIELDS)})"
    joins, parts = [], []
    for name, n, key, pos in (("d", levels, "a.k", "a.pos"), ("s", source_levels, "''", "o.pos")):
        for j in range(n):
            t = f"{name}{j}"
            joins.append(f"JOIN {t} ON {t}.k = {key} AND {t}.pos = {pos} // {FAN**j}")
            parts.append(f"CASE WHEN {t}.n > 1 THEN {t}.l || {t}.r ELSE '' END")
        if name == "d":
            joins.append("JOIN sources o ON o.source = a.k")
    folded = f"(SELECT a.doc_id, a.leaf, o.h AS subroot, root.h AS root, sha256({' || '.join(parts)}) AS proof_sha256, coalesce(a.changed, a.leaf) AS x, " + ", ".join(
        f"{name}{j}.{c} AS {name}{j}_{c}" for name, n in (("d", levels), ("s", source_levels)) for j in range(n) for c in "lrn"
    ) + f" FROM placed a {' '.join(joins)} CROSS JOIN s{source_levels} root)"
    for name, n in (("d", levels), ("s", source_levels)):
        for j in range(n):
            t = f"{name}{j}"
            folded = f"(SELECT * REPLACE (CASE WHEN {t}_n > 1 THEN sha256({t}_l || x || {t}_r) ELSE x END AS x) FROM {folded})"
    return f"""WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),{CRC_SQL},
  leaves AS (SELECT doc_id, coalesce('+' || source, '') AS k, {whole} AS leaf, CASE WHEN crc % 5 = 0 THEN {other} END AS changed FROM documents LEFT JOIN crcs ON id = doc_id),
  placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
  {_levels_sql("d", "SELECT k, pos, leaf AS h FROM placed", levels)},
  sources AS (SELECT k AS source, h, row_number() OVER (ORDER BY k) - 1 AS pos FROM d{levels}),
  {_levels_sql("s", "SELECT '' AS k, pos, h FROM sources", source_levels)}
SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM {folded}"""


ORACLE_SQL = oracle()
