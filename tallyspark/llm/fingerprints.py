"""Document fingerprints by consistent weighted sampling (operator 7).

A text's terms are its lower-cased words, weighted by their counts. For each of
``SAMPLES`` draws every term gets two gamma-distributed numbers and a uniform one
from hashes of the term and the draw; they turn the term's weight into a value,
and the term with the smallest value, together with its quantised weight, is the
draw's sample. Two texts share a draw's sample with a probability that equals the
generalised Jaccard similarity of their weights, so the share of equal samples
estimates it. Everything is DataFrame functions: the texts are shuffled once by
id, and terms, weights and samples are aggregated where the text lies.

Edge cases: null text counts as empty; a text without words has the one term ''
and so equals other such texts only; where an id is repeated the smallest of its
texts stands for it; rows with a null id take no part; the only document is its
own successor; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import materialize

SAMPLES = 32
SPACES = " \t\n\x0b\f\r"
_UNIT = 1 << 21


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the following id in ascending order, the first after the last.

    Ids are range-partitioned; each partition's first id, a row per partition, is
    what its predecessor's last row needs.
    """
    placed = materialize(
        ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("pid", F.spark_partition_id()), "ids"
    )
    firsts = placed.groupBy("pid").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("pid")
    firsts = firsts.select(
        "pid",
        F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"),
    )
    inside = F.lead("doc_id").over(Window.partitionBy("pid").orderBy("doc_id"))
    following = placed.select("doc_id", "pid", inside.alias("next_id")).join(firsts, "pid")
    return materialize(following.select("doc_id", F.coalesce("next_id", "after").alias("next_id")), "successors")


def _uniform(word: Column, part: int) -> Column:
    """One of three 21-bit parts of a hash as a number strictly between 0 and 1."""
    bits = F.shiftrightunsigned(word, 21 * part).bitwiseAND(F.lit(_UNIT - 1))
    return (bits + 0.5) / _UNIT


def _sample(log_weight: Column) -> Column:
    """A draw's key for one term: its value's order above, the sample's identity below; null for a term without weight."""
    level = F.floor(log_weight / F.col("r") + F.col("beta"))
    value = F.col("log_c") - F.col("r") * (level - F.col("beta") + 1)
    rank = F.shiftleft(F.floor((F.greatest(F.least(value, F.lit(1000.0)), F.lit(-1000.0)) + 1024) * (1 << 20)), 32)
    identity = F.xxhash64("term", "draw", level).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(log_weight.isNotNull(), rank.bitwiseOR(identity))


def _words(text: str) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(SPACES)), "[ \t-\r]+")


def sampled(texts: DataFrame, columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """(doc_id, one array of samples per text column), for texts partitioned by doc_id."""
    words = texts.select("doc_id", *(_words(c).alias(f"w{i}") for i, c in enumerate(columns)))
    ends = [sum((F.size(f"w{j}") for j in range(i + 1)), F.lit(0)).alias(f"end{i}") for i in range(len(columns))]
    rows = words.select("doc_id", *ends, F.posexplode(F.concat(*(f"w{i}" for i in range(len(columns))))).alias("pos", "word"))
    side = F.lit(len(columns) - 1)
    for i in reversed(range(len(columns) - 1)):
        side = F.when(F.col("pos") < F.col(f"end{i}"), i).otherwise(side)
    terms = (
        rows.select("doc_id", F.xxhash64("word").alias("term"), side.alias("side"))
        .groupBy("doc_id", "term")
        .agg(*(F.sum((F.col("side") == i).cast("long")).alias(f"n{i}") for i in range(len(columns))))
    )
    logs = (F.when(F.col(f"n{i}") > 0, F.log(F.col(f"n{i}").cast("double"))).alias(f"n{i}") for i in range(len(columns)))
    terms = terms.select("doc_id", "term", *logs)  # once a term, not once a draw
    draws = terms.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    first, second = F.xxhash64("term", "draw", F.lit(1)), F.xxhash64("term", "draw", F.lit(2))
    hashed = draws.withColumns({"h1": first, "h2": second})
    drawn = hashed.withColumns(
        {
            "r": -F.log(_uniform(F.col("h1"), 0) * _uniform(F.col("h1"), 1)),
            "log_c": F.log(-F.log(_uniform(F.col("h2"), 0) * _uniform(F.col("h2"), 1))),
            "beta": _uniform(F.col("h2"), 2),
        }
    )
    best = drawn.groupBy("doc_id", "draw").agg(*(F.min(_sample(F.col(f"n{i}"))).alias(f"m{i}") for i in range(len(columns))))
    packed = F.struct("draw", *(F.col(f"m{i}").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"m{i}") for i in range(len(columns))))
    gathered = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(packed)).alias("draws"))  # SAMPLES per document
    return gathered.select("doc_id", *(F.col(f"draws.m{i}").alias(c) for i, c in enumerate(columns)))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _text(samples: str) -> Column:
    return F.array_join(F.transform(F.col(samples), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and of its edited text, with both likenesses."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    chain = successors(rows.select("doc_id").distinct())
    by_id = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    wanted = by_id.join(chain, "doc_id").select(
        F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), F.floor(F.char_length("text") / 4).cast("int").alias("q")
    )
    heads = by_id.join(wanted, "doc_id").select(
        F.col("for_id").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("left(text, q)").alias("head"), "q"
    )
    texts = by_id.join(heads, "doc_id").select(
        "doc_id", "next_id", "text", F.expr("concat(left(text, char_length(text) - q), head)").alias("edited")
    )
    about = texts.select("doc_id", "next_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    table = materialize(about.join(sampled(texts, ["text", "edited"], samples), "doc_id"), "fingerprints")
    following = table.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    return table.join(following, "next_id").select(
        "doc_id", "n_chars", "edited_sha256",
        _text("text").alias("fingerprint"), _text("edited").alias("edited_fingerprint"),
        likeness("text", "edited").alias("near_edited"), likeness("text", "next_text").alias("near_next"),
    )
