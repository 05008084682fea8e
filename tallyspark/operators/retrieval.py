"""Evidence retrieval: exact tickets, or TF-IDF cosine over each query's own candidate set."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import cleaning as C
from tallyspark.session import settled, stored

# Token pattern, limits, score step, order of document types.
TOKEN = r"-?\d+(?:\.\d+)?|[a-z0-9]+"
DEFAULT_TOP_K, MAX_TOP_K, MAX_QUERY_CHARS = 5, 10, 500
QUANTUM_DIGITS = 9
TYPE_PRIORITY = {"TRADE_EVIDENCE": 0, "KPI_EVIDENCE": 1, "DATASET_CONTEXT": 2}

#: Documents and characters per chunk, and queries per block, that one task compares, about.
CHUNK_DOCUMENTS, CHUNK_CHARS, BLOCK_QUERIES = 4096, 1 << 25, 512


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Compatibility forms folded. Plain ASCII has none, so it never leaves the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def tokens(text: Column, normalise: bool = True) -> Column:
    """Lower-cased tokens. Compatibility forms are folded first unless the text is known to have none."""
    folded = compatible(text) if normalise else text
    return F.regexp_extract_all(F.lower(folded), F.lit(f"({TOKEN})"), F.lit(1))


def term_counts(documents: DataFrame, keys: list[str], content: str = "content", normalise: bool = True) -> DataFrame:
    """(keys, term, tf). Texts are dealt by their keys, so a text's many words are counted where it then lies, without another shuffle."""
    dealt = documents.select(*keys, F.col(content).alias("_text")).repartition(*keys)
    return dealt.select(*keys, F.explode(tokens(F.col("_text"), normalise)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def hashes(text: Column) -> Column:
    """The text's tokens as 64-bit hashes, repeated as often as they occur."""
    return F.coalesce(F.transform(tokens(text), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))


def parts(n: Column, size: int) -> Column:
    """How many parts of ``size``, about, ``n`` make; 1 at least."""
    return F.coalesce(F.greatest(F.ceil(n / size), F.lit(1)), F.lit(1)).cast("long")


def chunks_of(n: Column, chars: Column) -> Column:
    return F.greatest(parts(n, CHUNK_DOCUMENTS), parts(chars, CHUNK_CHARS))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(all entries, the row of each)."""
    lists = [np.asarray(x) for x in lists]
    return np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _counted(owner: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, word, occurrences) of each word of each owner, in order."""
    pairs, n = np.unique(owner * n_words + word, return_counts=True)
    return pairs // n_words, pairs % n_words, n


def _best(k: int, names: np.ndarray, texts: np.ndarray, asked: np.ndarray, n: int, told: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, query, score): the ``k`` best documents of one scope, in order of their ties, for each of its queries. ``told``: words and their document frequencies, if not the scope's own."""
    code, own = pd.factorize(names)  # rows of one document are one text
    first = np.unique(code, return_index=True)[1]
    terms, row = _flat(texts)
    asked_terms, asked_row = _flat(asked)
    words = np.unique(np.concatenate([terms, asked_terms]))
    doc, word, tf = _counted(code[row], np.searchsorted(words, terms), max(len(words), 1))
    if told and len(words):
        known, freq = told
        df, at = np.zeros(len(words), np.int64), np.minimum(np.searchsorted(words, known), len(words) - 1)
        here = words[at] == known  # not those of other blocks' queries
        df[at[here]] = freq[here]
    else:
        df = np.bincount(word, minlength=len(words))
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    weight = tf * idf[word]
    length = np.sqrt(np.bincount(doc, weight * weight, len(own)))
    q, q_word, q_tf = _counted(asked_row, np.searchsorted(words, asked_terms), max(len(words), 1))
    q_weight = q_tf * idf[q_word]
    q_length = np.sqrt(np.bincount(q, q_weight * q_weight, len(asked)))
    wanted = np.unique(q_word)
    table = np.zeros((len(wanted), len(asked)))
    table[np.searchsorted(wanted, q_word), q] = q_weight / np.where(q_length > 0, q_length, 1)[q]
    at = np.minimum(np.searchsorted(wanted, word), max(len(wanted) - 1, 0))
    kept = wanted[at] == word if len(wanted) else np.zeros(len(word), bool)
    doc, at, weight = doc[kept], at[kept], weight[kept] / length[doc[kept]]
    met, edges = np.unique(doc, return_index=True)
    edges = np.append(edges, len(doc))
    best, best_at = np.zeros((0, len(asked))), np.zeros((0, len(asked)), np.int64)
    for start in range(0, len(met), 1024):
        stop = min(start + 1024, len(met))
        scores = np.zeros((stop - start, len(asked)))
        for i in range(start, stop):
            here = slice(edges[i], edges[i + 1])
            scores[i - start] = weight[here] @ table[at[here]]
        scores = np.round(scores, QUANTUM_DIGITS)
        rows = np.broadcast_to(met[start:stop, None], scores.shape)
        best, best_at = np.concatenate([best, scores]), np.concatenate([best_at, rows])
        order = np.argsort(-best, axis=0, kind="stable")[:k]
        best, best_at = np.take_along_axis(best, order, 0), np.take_along_axis(best_at, order, 0)
    i, j = np.nonzero(best > 0)
    return first[best_at[i, j]], j, best[i, j]


def _compare(k: int, scope: list[str], document: str, query: str):
    """For every query of some scopes' blocks the ``k`` best documents of their chunks, ties to the lower ``tie``."""

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [*scope, query, document, "tie", "score"]
        if docs.empty or asked.empty:
            return pd.DataFrame({c: [] for c in columns})
        docs, told = docs.sort_values("tie", kind="stable").reset_index(drop=True), asked[asked["freq"].notna()]
        asked = asked[asked["freq"].isna()].reset_index(drop=True)
        frames = [docs, asked, told]
        codes = np.split(pd.concat([f[scope] for f in frames]).groupby(scope, sort=False).ngroup().to_numpy(), np.cumsum([len(f) for f in frames])[:-1])
        order = [np.argsort(c, kind="stable") for c in codes]
        at = lambda i, c: order[i][slice(*np.searchsorted(codes[i][order[i]], [c, c + 1]))]
        names, texts, words = docs[document].to_numpy(), docs["hashes"].to_numpy(), asked["hashes"].to_numpy()
        known, freq, n = told["hashes"].to_numpy(), told["freq"].to_numpy(), asked["n"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c in np.unique(codes[1]):
            d, a, t = (at(i, c) for i in range(3))
            if len(d):
                i, j, score = _best(k, names[d], texts[d], words[a], int(n[a[0]]), (_flat(known[t])[0], _flat(freq[t])[0]) if len(t) else None)
                found.append((d[i], a[j], score))
        d, a, score = (np.concatenate(x) for x in zip(*found, strict=True))
        out = {c: asked[c].to_numpy()[a] for c in (*scope, query)} | {document: names[d], "tie": docs["tie"].to_numpy()[d], "score": score}
        return pd.DataFrame(out, columns=columns)

    return run


def _chunk_words(scope: list[str], document: str):
    """The words of a chunk, with the documents that hold each."""

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        code, _ = pd.factorize(docs[document])
        terms, row = _flat(docs["hashes"])
        words, at = np.unique(terms, return_inverse=True)
        n = np.bincount(_counted(code[row], at, len(words))[1], minlength=len(words))
        return pd.DataFrame({c: docs[c].iloc[0] for c in (*scope, "chunk")} | {"term": words, "_n": n}, index=range(len(words)))

    return run


#: Rows in which a chunk's document frequencies go to its task.
WORD_ROWS = 16


def rank_texts(
    docs: DataFrame, words: Column, asked: DataFrame, scope: list[str], k: int = MAX_TOP_K, document: str = "document_id", query: str = "query_id",
) -> DataFrame:
    """(scope, query, document, score, rank <= k): cosine of TF-IDF vectors above 0, in steps of 1e-9.

    ``docs``: scope, document, ``tie`` (its order decides between equal scores), the ``chunks`` of its scope and what ``words``,
    an array of hashed tokens, is made of. ``asked``: scope, query, ``hashes``, the scope's documents ``n`` and its ``chunks`` and
    ``blocks``. Scope keys are not null. idf = ln((1 + N) / (1 + df)) + 1 within a scope; query terms that no document has are left
    out, a document without a term counts in N.

    Texts, not their terms, are shuffled: a group is a chunk of a scope's documents and a block of its queries, of small scopes
    several together (a call per scope costs more than its work); it counts words itself and keeps its k best a query. In a scope of one chunk the task sees every document, so document frequencies are its own.
    Of larger scopes each chunk's words are counted first and summed over the chunks, a row per word and chunk.
    """
    keys = ["bucket", "chunk", "block"]
    total = asked.select(*scope, "n").distinct().agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64(*scope), F.lit(-(-total // CHUNK_DOCUMENTS) or 1)).cast("long")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    chunk = F.pmod(F.xxhash64(document), F.col("chunks")).alias("chunk")
    asked = asked.select(*scope, query, "hashes", F.col("n").cast("long").alias("n"), "chunks", "blocks").withColumn("block", F.pmod(F.xxhash64(query), F.col("blocks")))
    right = asked.withColumn("chunk", upto("chunks")).select(*scope, "chunk", "block", query, "hashes", F.lit(None).cast("array<bigint>").alias("freq"), "n")
    several = asked.filter("chunks > 1").groupBy(*scope, "chunks", "blocks").agg(F.min(query).alias(query), F.min("n").alias("n"))
    if not several.isEmpty():
        kinds = dict(docs.dtypes)
        dealt = docs.filter("chunks > 1").select("*", chunk).repartition(*scope, "chunk").select(*scope, "chunk", document, words.alias("hashes"))
        shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "chunk bigint, term bigint, _n bigint"])
        own = dealt.groupBy(*scope, "chunk").applyInPandas(_chunk_words(scope, document), shape)
        sought = asked.filter("chunks > 1").select(*scope, "chunks", F.explode("hashes").alias("term")).distinct().withColumn("chunk", upto("chunks"))
        every = own.unionByName(sought.select(*scope, "chunk", "term", F.lit(0).cast("long").alias("_n"))).groupBy(*scope, "chunk", "term").agg(F.sum("_n").alias("_n"))
        every = every.withColumn("_df", F.sum("_n").over(Window.partitionBy(*scope, "term"))).withColumn("_slot", F.pmod(F.xxhash64("term"), F.lit(WORD_ROWS)))
        packed = every.groupBy(*scope, "chunk", "_slot").agg(F.collect_list(F.struct("term", "_df")).alias("_words")).join(several.drop("chunks"), scope)
        told = packed.withColumn("block", upto("blocks")).select(*scope, "chunk", "block", query, F.col("_words.term").alias("hashes"), F.col("_words._df").alias("freq"), "n")
        right = right.unionByName(told)
    blocks = asked.select(*scope, "blocks").distinct() if asked.filter("blocks > 1").limit(1).count() else None
    left = docs.select("*", chunk)
    left = left.withColumn("block", F.lit(0).cast("long")) if blocks is None else left.join(blocks, scope).withColumn("block", upto("blocks"))
    left = left.withColumn("bucket", bucket).repartition(*keys).select(*keys, *scope, document, "tie", words.alias("hashes"))
    right = right.withColumn("bucket", bucket)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides may come from one table: tell their columns apart
    kinds = dict(left.dtypes) | dict(right.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*scope, query, document, "tie")), "score double"])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(k, scope, document, query), shape)
    place = F.row_number().over(Window.partitionBy(*scope, query).orderBy(F.desc("score"), "tie"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).drop("tie")


def top_k(
    terms: DataFrame, query_terms: DataFrame, ties: DataFrame, scope: list[str], k: int = MAX_TOP_K,
    document: str = "document_id", query: str = "query_id",
) -> DataFrame:
    """``rank_texts`` of counted terms.

    ``terms`` has (scope, document, term, tf), ``query_terms`` (scope, query, term, tf), ``ties`` every document of a scope with its ``tie``.
    """
    repeated = F.flatten(F.collect_list(F.array_repeat(F.xxhash64("term"), F.col("tf").cast("int")))).alias("hashes")
    sizes = ties.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    asked = query_terms.groupBy(*scope, query).agg(repeated)
    per = sizes.join(asked.groupBy(*scope).agg(F.count(F.lit(1)).alias("m")), scope)
    per = settled(per.select(*scope, "n", parts(F.col("n"), CHUNK_DOCUMENTS).alias("chunks"), parts(F.col("m"), BLOCK_QUERIES).alias("blocks")))
    docs = ties.join(terms.groupBy(*scope, document).agg(repeated), [*scope, document], "left").join(per.drop("n", "blocks"), scope)
    words = F.coalesce("hashes", F.array().cast("array<bigint>"))
    return rank_texts(docs, words, settled(asked.join(per, scope)), scope, k, document, query)


def rank_key() -> Column:
    """Text whose order is: type, numeric record key before text, id."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_PRIORITY.items() for x in pair])
    key = F.coalesce(C.ticket(F.col("source_record_key")), F.col("source_record_key"))
    whole = F.when(key.rlike(r"^[+-]?\d+$"), key.try_cast("decimal(38,0)"))
    raised = (whole + F.lit("9" * 37).cast("decimal(38,0)")).cast("string")  # below 0 too, digits in order
    number = F.when(whole.isNotNull() & (F.abs(whole) < F.lit("1" + "0" * 37).cast("decimal(38,0)")), F.lpad(raised, 39, "0"))
    return F.concat(
        F.lpad(F.coalesce(F.try_element_at(known, F.col("document_type")), F.lit(99)).cast("string"), 2, "0"),
        F.when(number.isNotNull(), F.concat(F.lit("0"), number)).otherwise(F.concat(F.lit("1"), F.coalesce(key, F.lit("")))),
        F.lit("\x00"), F.coalesce("document_id", F.lit("")),
    )


def retrieve(documents: DataFrame, queries: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, states) of a query table over a document table.

    ``queries``: query_id, journal_id, text, ticket, symbol, document_type, top_k (null: default) and, if
    the column is there, the journal_fingerprint that the journal's documents must carry.
    A corpus whose documents carry several fingerprints answers nothing.
    A query that cannot be asked (text over the limit, top_k below 1, a ticket that is
    no ticket, an unknown type) gives no rows and counts nothing. A ticket's candidates
    are the trades with that ticket. Documents are stored once; their texts are shuffled for
    free queries, if there are any, and to fetch what was found. Statistics belong to
    the distinct (journal, type, symbol) filters, not to queries.
    """
    guarded = "journal_fingerprint" in queries.columns
    asked = queries.select(
        "query_id", "journal_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"), C.ticket(F.col("ticket")).alias("ticket"),
        (C.text(F.col("ticket")).isNotNull() & C.ticket(F.col("ticket")).isNull()).alias("no_ticket"),
        F.lower(compatible(F.trim("symbol"))).alias("symbol"), "document_type",
        F.least(F.coalesce("top_k", F.lit(DEFAULT_TOP_K)), F.lit(MAX_TOP_K)).alias("top_k"),
        (F.col("journal_fingerprint") if guarded else F.lit(None).cast("string")).alias("wanted_print"),
    )
    asked = asked.withColumn("symbol", F.when(F.col("symbol") != "", F.col("symbol")))
    kept = ["journal_id", "document_id", "document_type", "journal_fingerprint", "source_record_key", "content", "evidence_status", "symbol"]
    docs = stored(documents.select(*kept, F.lower(compatible(F.trim("symbol"))).alias("_symbol"), F.monotonically_increasing_id().alias("_row")))
    prints = docs.groupBy("journal_id").agg(F.min("journal_fingerprint").alias("print0"), F.max("journal_fingerprint").alias("print1"), F.count(F.lit(1)).alias("corpus_size"))
    asked = asked.join(prints, "journal_id", "left")
    if verdicts is not None:
        asked = asked.join(verdicts.select("journal_id", "verdict"), "journal_id", "left")
        sound = F.coalesce(F.col("verdict") == "OK", F.lit(False))
    else:
        sound = F.lit(True)
    sound &= F.coalesce(F.col("print0") == F.col("print1"), F.lit(True))  # a corpus is of one state of its journal
    if guarded:
        sound &= F.coalesce((F.col("print0") == F.col("wanted_print")) & (F.col("print1") == F.col("wanted_print")), F.lit(False))
    fault = (
        F.when(F.char_length("text") > MAX_QUERY_CHARS, "INVALID_QUERY").when(F.col("top_k") < 1, "INVALID_TOP_K").when(~sound, "CORPUS_INVALID")
        .when(~F.col("document_type").isin(*TYPE_PRIORITY), "INVALID_DOCUMENT_TYPE").when(F.col("no_ticket"), "INVALID_TICKET")
    )
    combo = F.to_json(F.struct("journal_id", "document_type", "symbol"), {"ignoreNullFields": "false"})
    asked = settled(asked.withColumns({"fault": fault, "combo": combo}))
    live = asked.filter("fault IS NULL")
    want = live.select(F.col("combo").alias("combo"), F.col("journal_id").alias("journal_id"), F.col("document_type").alias("want_type"), F.col("symbol").alias("want_symbol"))
    fits = (F.col("want_type").isNull() | (F.col("want_type") == F.col("document_type"))) & (
        F.col("want_symbol").isNull() | ((F.col("document_type") == "TRADE_EVIDENCE") & (F.col("_symbol") == F.col("want_symbol")))
    )
    kinds = docs.groupBy("journal_id", "document_type", "_symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("content")).alias("chars"))
    by_combo = settled(want.distinct().join(kinds, "journal_id").filter(fits).groupBy("combo").agg(F.sum("n").alias("candidates"), F.sum("chars").alias("chars")).withColumnRenamed("combo", "_combo")).withColumnRenamed("_combo", "combo")

    trades = docs.filter("document_type = 'TRADE_EVIDENCE'").select("journal_id", "document_type", "_symbol", "_row", rank_key().alias("tie"), C.ticket(F.col("source_record_key")).alias("ticket"))
    by_ticket = live.filter("ticket IS NOT NULL").select("query_id", "journal_id", "ticket", "top_k", F.col("document_type").alias("want_type"), F.col("symbol").alias("want_symbol"))
    exact = by_ticket.join(trades, ["journal_id", "ticket"]).filter(fits)
    one = Window.partitionBy("query_id")
    exact = exact.select("query_id", "top_k", "_row", F.lit("EXACT_TICKET").alias("method"), F.lit(None).cast("double").alias("score"), F.row_number().over(one.orderBy("tie")).alias("rank"), F.count(F.lit(1)).over(one).alias("with_ticket"))
    hits = exact.filter(F.col("rank") <= F.col("top_k"))
    free = live.filter("ticket IS NULL AND text <> ''")
    if not free.isEmpty():
        m = free.groupBy("combo").agg(F.count(F.lit(1)).alias("m"))
        per = by_combo.join(m, "combo").select("combo", F.col("candidates").alias("n"), chunks_of(F.col("candidates"), F.col("chars")).alias("chunks"), parts(F.col("m"), BLOCK_QUERIES).alias("blocks"))
        scopes = want.distinct().join(per.select("combo", "chunks"), "combo")
        texts = docs.withColumn("tie", rank_key()).join(scopes, "journal_id").filter(fits).select("combo", "chunks", "_row", "tie", "content")
        words = settled(free.select(F.col("combo").alias("combo"), "query_id", hashes(F.col("text")).alias("hashes")).join(per, "combo"))
        ranked = rank_texts(texts, hashes(F.col("content")), words, ["combo"], document="_row").join(free.select("query_id", "top_k"), "query_id")
        ranked = ranked.select("query_id", "top_k", "_row", F.lit("TFIDF_COSINE").alias("method"), "score", "rank", F.lit(None).cast("long").alias("with_ticket"))
        hits = hits.unionByName(ranked.filter(F.col("rank") <= F.col("top_k")))
    hits = settled(hits.drop("top_k"))  # at most ten rows a query
    columns = ["document_id", "document_type", "journal_fingerprint", "source_record_key", "content", "evidence_status", "symbol"]
    results = stored(hits.join(docs, "_row").select("query_id", "journal_id", *columns, "method", "score", "rank"))

    returned = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.max("with_ticket").alias("with_ticket"))
    states = asked.join(by_combo, "combo", "left").join(returned, "query_id", "left")
    state = F.coalesce(
        "fault",
        F.when(F.coalesce("returned", F.lit(0)) > 0, "OK").when(F.col("ticket").isNull() & (F.col("text") == ""), "EMPTY_QUERY").otherwise("NO_RELEVANT_EVIDENCE"),
    )
    met = F.when(F.col("ticket").isNotNull(), F.col("with_ticket")).otherwise(F.col("candidates"))
    asked_well = F.col("fault").isNull()
    states = states.select(
        "query_id", "journal_id", state.alias("state"), "top_k",
        F.when(asked_well, F.coalesce("corpus_size", F.lit(0))).otherwise(0).alias("corpus_size"),
        F.when(asked_well, F.coalesce(met, F.lit(0))).otherwise(0).alias("candidate_count"),
    )
    return results, states
