"""Ranking where a scope is cut into chunks and blocks, and what retrieval shuffles."""

import math

from pyspark.sql import functions as F

from tallyspark.operators import retrieval

WORDS = [f"w{i}" for i in range(40)]


def _texts(n):
    """Texts of a few words each, some rare, two of every seven equal to another."""
    return [" ".join(WORDS[(i * k * k + k) % 40] for k in range(1, 4 + (i - i % 7 // 5) % 5)) for i in range(n)]


def _plain(texts, asked):
    """Every query's ten best (document, score), written out."""
    counts = [{w: t.split().count(w) for w in t.split()} for t in texts]
    df = {w: sum(w in c for c in counts) for w in WORDS}
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items() if n}
    vector = lambda c: {w: n * idf[w] for w, n in c.items() if w in idf}
    found = {}
    for q, text in enumerate(asked):
        a = vector({w: text.split().count(w) for w in text.split()})
        norm = math.sqrt(sum(x * x for x in a.values()))
        scores = []
        for d, c in enumerate(counts):
            v = vector(c)
            dot = sum(x * v.get(w, 0) for w, x in a.items())
            if dot:
                scores.append((-round(dot / norm / math.sqrt(sum(x * x for x in v.values())), 9), d))
        found[q] = [d for _, d in sorted(scores)[:10]]
    return found


def test_chunks_and_blocks_give_what_one_task_gives(spark):
    texts, asked = _texts(120), [" ".join(WORDS[i : i + 3]) + " unknown" for i in range(0, 30, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").withColumns({"s": F.lit("x"), "tie": F.col("document_id")})
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").select(F.lit("x").alias("s"), "query_id", retrieval.hashes(F.col("text")).alias("hashes"), F.lit(120).alias("n"))
    for chunks, blocks in ((1, 1), (5, 1), (4, 3)):
        of = lambda n: F.lit(n).cast("long")
        found = retrieval.rank_texts(docs.withColumn("chunks", of(chunks)), retrieval.hashes(F.col("text")), queries.withColumns({"chunks": of(chunks), "blocks": of(blocks)}), ["s"])
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["document_id"])
        assert got == _plain(texts, asked), (chunks, blocks)


def test_small_scopes_share_a_group_and_nothing_else(spark):
    """Nine scopes of some documents each, ranked together, give what each gives alone."""
    texts, asked = _texts(99), ["w1 w2 w3", "w5 w11", "w0"]
    of = lambda *names: [F.lit(1).cast("long").alias(c) for c in names]
    docs = spark.createDataFrame([(str(i % 9), i, t) for i, t in enumerate(texts)], "s string, document_id long, text string").select("*", F.col("document_id").alias("tie"), *of("chunks"))
    queries = spark.createDataFrame([(str(s), q, t) for s in range(9) for q, t in enumerate(asked)], "s string, q long, text string")
    queries = queries.select("s", F.concat_ws("-", "s", "q").alias("query_id"), retrieval.hashes(F.col("text")).alias("hashes"), F.lit(11).alias("n"), *of("chunks", "blocks"))
    got = {}
    for r in retrieval.rank_texts(docs, retrieval.hashes(F.col("text")), queries, ["s"]).orderBy("query_id", "rank").collect():
        assert r["query_id"].startswith(r["s"])
        got.setdefault(r["query_id"], []).append(r["document_id"])
    wanted = {f"{s}-{q}": [d * 9 + s for d in found] for s in range(9) for q, found in _plain(texts[s::9], asked).items() if found}
    assert got == wanted


def test_terms_are_not_shuffled(spark):
    """No step of a ranking over one chunk makes or counts a row per word: what is dealt are texts."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(30))], "document_id long, text string").withColumns({"s": F.lit("x"), "tie": F.col("document_id"), "chunks": F.lit(1).cast("long")})
    asked = spark.createDataFrame([("x", 0, "w1 w2")], "s string, query_id long, text string").select("s", "query_id", retrieval.hashes(F.col("text")).alias("hashes"), F.lit(30).alias("n"), *(F.lit(1).cast("long").alias(c) for c in ("chunks", "blocks")))
    plan = retrieval.rank_texts(docs, retrieval.hashes(F.col("text")), asked, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Aggregate" not in plan
