"""Exact n-gram Jaccard self-join with signature trees (operator 4).

A document's set holds hashes of its distinct word shingles; documents with equal
sets are one class. Two classes link when 100 * intersection >= 80 * union.

1. Filters that lose no link. Of a set of n shingles, a linked partner lacks at
   most n/5. So among the n/5 + n/20 + 1 shingles first in hash order, more than
   n/25 occur in another set; and of the whole set, four fifths do. Classes that
   fail either test have no link. Degrees (the number of sets that hold a shingle,
   counted up to ``CAP``) come from blocks of shingle hashes: each task sends one
   entry for a shingle that it has seen often, so common passages stay small.
2. Routing that loses no link. In any fixed order of shingles, linked sets share
   one of their first n/5 + 1. The order by degree puts rare shingles first, so
   sets that share only common passages do not meet. Classes that share a routing
   shingle, directly or through others, form a cluster.
3. Signature trees. Each cluster, cut into bands of set sizes and these into blocks
   of bounded size, is joined block against block: a tree per block whose nodes hold OR-combined token bitmaps and
   size ranges, and a traversal of both trees that drops a pair of nodes when the
   largest possible overlap is too small for their sizes. Where the block pair has
   more distinct tokens than bits, the bound allows for shared bits and the pairs
   left over are compared on the sets themselves.

Edge cases: null and empty texts, and texts without a word, have an empty set and
no link; fewer than n words make one shingle of the whole sequence; ids may repeat
(equal rows are copies of one document, and different texts under one id join
their links); a row with a null id is left out of links and has a null component;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.components import components
from tallyspark.llm.scratch import drop, materialize
from tallyspark.llm.skew import spread_join

SHINGLE = 5
#: Degrees are told apart up to this many sets.
CAP = 64
#: Shingle entries per range of hashes, and shingles per block of a cluster, about.
RANGE_ENTRIES, BLOCK_SHINGLES = 500_000, 400_000
MIN_RANGES = 64
#: Sets per leaf, children per node, and bits of a bitmap at most.
LEAF, FAN, MAX_BITS = 32, 4, 1 << 15
#: Factor of the bands of set sizes: linked sets' sizes differ by 1.25 at most.
BAND = 1.26
#: Parts into which a cluster's rows are dealt where they meet a row per cluster.
SALTS = 16
#: Copies from which on a class is met in that many parts.
MANY_COPIES = 1000


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, count, data, starts in W.blocks(texts):
        space = W.IS_SPACE[data]
        begins = W.word_starts(space)
        words, rows = W.word_hashes(W.LOWER[data], space, begins), W.row_of(begins, starts)
        grams = W.joined_hash(words, n, n)
        whole = rows[: len(grams)] == rows[n - 1 :] if len(grams) else np.zeros(0, bool)
        gram_rows, grams = rows[: len(grams)][whole], grams[whole]
        sizes = np.bincount(rows, minlength=count)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            firsts = np.searchsorted(rows, short)
            extra = [W.joined_hash(words[a : a + k], k, 100 + k)[0] for a, k in zip(firsts.tolist(), sizes[short].tolist(), strict=True)]
            gram_rows, grams = np.append(gram_rows, short), np.append(grams, np.array(extra, np.uint64))
        order = np.lexsort((grams, gram_rows))
        gram_rows, grams = gram_rows[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (gram_rows[1:] != gram_rows[:-1])
        gram_rows, grams = gram_rows[new], grams[new]
        edges = np.searchsorted(gram_rows, np.arange(count + 1))
        for i in range(count):
            yield grams[edges[i] : edges[i + 1]]


def class_key(tokens: np.ndarray) -> int | None:
    """One 63-bit key per set; none for the empty set."""
    if not len(tokens):
        return None
    both = np.array([W.mix(tokens).sum(dtype=np.uint64), np.uint64(len(tokens))], np.uint64)
    return int(W.joined_hash(both, 2, 77)[0] >> np.uint64(1))


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, cls) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), class_key(s)) for s in shingle_sets(W.utf8(batch.column(1)), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                ["doc_id", "n_shingles", "cls"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long")


def class_sets(docs: DataFrame, n: int) -> DataFrame:
    """(cls, copies, n_shingles, tokens) of ``docs`` (text, cls, copies), where the text is of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(W.utf8(batch.column(0)), n))
            classes, copies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept = [(c, k, s) for c, k, s in zip(classes, copies, sets, strict=True) if class_key(s) == c]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()),
                    pa.array([len(x[2]) for x in kept], pa.int64()),
                    pa.array([x[2].view(np.int64) for x in kept], pa.list_(pa.int64())),
                ],
                ["cls", "copies", "n_shingles", "tokens"],
            )

    return docs.select("text", "cls", "copies").mapInArrow(run, "cls long, copies long, n_shingles long, tokens array<long>")


DEALT = "part int, low binary, cls binary, sets binary"
#: Bytes of a shingle's hash that an entry keeps, beside its range.
KEPT = 6


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def _unpack(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // KEPT, 8), np.uint8)
    out[:, :KEPT] = packed.reshape(-1, KEPT)
    return out.view("<u8").ravel()


def _deal(tokens: np.ndarray, cls: np.ndarray, ranges: int, cap: int, batch_no: int) -> list[tuple]:
    """One batch's entries by range of hashes, and what it can settle by itself.

    An entry is the low part of a hash, a class and how many sets it stands for. A
    shingle in ``cap`` or more sets of the batch has degree ``cap`` whatever other
    batches hold: its members are settled here (parts from ``ranges`` on), and one
    entry tells the others.
    """
    tokens = W.mix(tokens)  # first shingles have small hashes; ranges shall be even
    order = np.lexsort((cls, tokens))
    tokens, cls = tokens[order], cls[order]
    same = np.zeros(len(tokens), bool)
    same[1:] = (tokens[1:] == tokens[:-1]) & (cls[1:] == cls[:-1])
    tokens, cls = tokens[~same], cls[~same]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    group = np.cumsum(first) - 1
    size = np.bincount(group, minlength=0)
    settled = size[group] >= cap if len(tokens) else np.zeros(0, bool)
    sent = ~settled | first
    weight = np.where(settled, cap, 1).astype(np.uint8)
    part = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    out = []
    at = np.flatnonzero(sent)
    edges = np.searchsorted(part[at], np.arange(ranges + 1))
    for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        x = at[edges[r] : edges[r + 1]]
        out.append((r, _pack(tokens[x]), cls[x].tobytes(), weight[x].tobytes()))
    if settled.any():
        out.append((ranges + batch_no % ranges, _pack(tokens[settled]), cls[settled].tobytes(), b""))
    return out


def _blocks_of(pdf: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), kind)


def _settle(pdf: pd.DataFrame, ranges: int, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, routing key, degree) of the entries of one part whose shingle has two sets or more."""
    part = int(pdf["part"].iloc[0])
    cls, low = _blocks_of(pdf, "cls", np.int64), _unpack(_blocks_of(pdf, "low", np.uint8))
    if part >= ranges:
        return cls, low, np.full(len(cls), cap)
    weight = _blocks_of(pdf, "sets", np.uint8).astype(np.int64)
    order = np.lexsort((cls, low))
    low, cls, weight = low[order], cls[order], weight[order]
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    again = np.zeros(len(low), bool)
    again[1:] = ~new[1:] & (cls[1:] == cls[:-1]) & (weight[1:] == weight[:-1])
    group = np.cumsum(new) - 1
    degree = np.minimum(np.bincount(group, weights=np.where(again, 0, weight)).astype(np.int64), cap)[group]
    told = (degree >= 2) & (weight == 1) & ~again
    return cls[told], low[told], degree[told]


def _dealt(rows: DataFrame, take, ranges: int, cap: int) -> DataFrame:
    """``take(batch)`` gives a batch's (shingle hashes, classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for batch in batches:
            tokens, cls = take(batch)
            out = _deal(tokens, cls, ranges, cap, TaskContext.get().partitionId())
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "low", "cls", "sets"]
            )

    return rows.mapInArrow(run, DEALT)


def _ranges(entries: int | None) -> int:
    return max(MIN_RANGES, -(-(entries or 0) // RANGE_ENTRIES))


def first_hits(docs: DataFrame, entries: int, n: int) -> DataFrame:
    """(cls, hits): how many of a class's first shingles occur in another set (or more)."""
    ranges = _ranges(entries)

    def take(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        sets = [(class_key(s), s[: len(s) // 5 + len(s) // 20 + 1]) for s in shingle_sets(W.utf8(batch.column(0)), n) if len(s)]
        tokens = np.concatenate([s for _, s in sets]) if sets else np.zeros(0, np.uint64)
        return tokens, np.repeat(np.array([c for c, _ in sets], np.int64), [len(s) for _, s in sets])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, _, _ = _settle(pdf, ranges, 2)
        cls, hits = np.unique(cls, return_counts=True)
        return pd.DataFrame({"cls": cls, "hits": hits})

    parts = _dealt(docs.select("text"), take, ranges, 2).groupBy("part").applyInPandas(settle, "cls long, hits long")
    return parts.groupBy("cls").agg(F.sum("hits").alias("hits"))


def routes(sets: DataFrame, entries: int) -> DataFrame:
    """(cls, route): the routing shingles, rare ones first, of classes that may have a link."""
    ranges = _ranges(entries)

    def take(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return lists.flatten().to_numpy().view(np.uint64), np.repeat(batch.column(0).to_numpy(), sizes)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, key, degree = _settle(pdf, ranges, CAP)
        route = (degree.astype(np.uint64) << np.uint64(56) | key).view(np.int64)
        order = np.argsort(cls, kind="stable")
        cls, route = cls[order], route[order]
        own, at = np.unique(cls, return_index=True)
        lists = pd.Series(np.split(route, at[1:]) if len(own) else [], dtype=object)
        return pd.DataFrame({"cls": own, "routes": lists})

    found = _dealt(sets.select("cls", "tokens"), take, ranges, CAP).groupBy("part").applyInPandas(settle, "cls long, routes array<long>")
    found = found.groupBy("cls").agg(F.sort_array(F.flatten(F.collect_list("routes"))).alias("routes"))  # one set's shingles
    shared = F.size("routes")
    used = F.floor(F.col("n_shingles") / 5) + 1 - (F.col("n_shingles") - shared)  # shingles of no other set come first
    return (
        found.join(sets.select("cls", "n_shingles").distinct(), "cls")
        .filter((shared * 5 >= F.col("n_shingles") * 4) & (used > 0))
        .select("cls", F.explode(F.slice("routes", F.lit(1), used.cast("int"))).alias("route"))
    )


def clusters(routed: DataFrame) -> DataFrame:
    """(id, label): classes that share routing shingles, directly or through others."""
    firsts = routed.groupBy("route").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).filter("least < most")
    edges = spread_join(routed, firsts.select("route", "least"), "route").filter("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"))
    return components(edges.distinct(), "clusters")


class SignatureTree:
    """Nodes over sets sorted by size: OR-combined bitmaps, size ranges and spare tokens."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, spare: np.ndarray):
        self.levels = []
        leaf = np.arange(0, len(sizes), LEAF)
        level = (
            np.bitwise_or.reduceat(bitmaps, leaf, 0), np.minimum.reduceat(sizes, leaf), np.maximum.reduceat(sizes, leaf),
            np.maximum.reduceat(spare, leaf),
        )
        self.levels.append(level)
        while len(level[1]) > 1:
            up = np.arange(0, len(level[1]), FAN)
            level = (
                np.bitwise_or.reduceat(level[0], up, 0), np.minimum.reduceat(level[1], up), np.maximum.reduceat(level[2], up),
                np.maximum.reduceat(level[3], up),
            )
            self.levels.append(level)


def possible(left: tuple, right: tuple) -> np.ndarray:
    """Which node pairs, row by row, may hold a link: by size ranges and largest overlap."""
    (bits_a, low_a, high_a, spare_a), (bits_b, low_b, high_b, spare_b) = left, right
    overlap = np.bitwise_count(bits_a & bits_b).sum(-1, dtype=np.int64) + np.minimum(spare_a, spare_b)
    overlap = np.minimum(overlap, np.minimum(high_a, high_b))
    return (9 * overlap >= 4 * (low_a + low_b)) & (5 * high_a >= 4 * low_b) & (5 * high_b >= 4 * low_a)


def leaf_pairs(a: SignatureTree, b: SignatureTree, same: bool) -> np.ndarray:
    """Leaf pairs that the traversal of both trees, level by level, cannot drop."""
    depth = max(len(a.levels), len(b.levels)) - 1
    pairs = np.zeros((1, 2), np.int64)
    for level in range(depth, -1, -1):
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        kept = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(pairs), 4096):
            x, y = pairs[at : at + 4096].T
            kept.append(pairs[at : at + 4096][possible(tuple(c[x] for c in la), tuple(c[y] for c in lb))])
        pairs = np.concatenate(kept)
        if level == 0:
            break
        grow_a = FAN if level <= len(a.levels) - 1 else 1
        grow_b = FAN if level <= len(b.levels) - 1 else 1
        kids = np.stack(np.meshgrid(np.arange(grow_a), np.arange(grow_b), indexing="ij"), -1).reshape(-1, 2)
        pairs = (pairs * [grow_a, grow_b])[:, None, :] + kids
        pairs = pairs.reshape(-1, 2)
        below_a = len(a.levels[min(level - 1, len(a.levels) - 1)][1])
        below_b = len(b.levels[min(level - 1, len(b.levels) - 1)][1])
        pairs = pairs[(pairs[:, 0] < below_a) & (pairs[:, 1] < below_b)]
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    return pairs


def _bitmaps(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps, tokens of each set beyond its bits); exact if the vocabulary fits."""
    bits = 64
    while bits < min(len(vocabulary), MAX_BITS):
        bits *= 2
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for row, tokens in zip(maps, sets, strict=True):
        place = np.unique(np.searchsorted(vocabulary, tokens) % bits)
        np.bitwise_or.at(row, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    spare = np.array([len(s) for s in sets], np.int64) - np.bitwise_count(maps).sum(1, dtype=np.int64)
    return maps, spare


def links(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """Index pairs (left, right) of sets that link; for ``same`` each unordered pair once."""
    vocabulary = np.unique(np.concatenate([*left, *([] if same else right)]))
    order_a = np.argsort([len(s) for s in left], kind="stable")
    sides = []
    for sets, order in ((left, order_a), (right, order_a if same else np.argsort([len(s) for s in right], kind="stable"))):
        sets = [sets[i] for i in order]
        maps, spare = _bitmaps(sets, vocabulary)
        sizes = np.array([len(s) for s in sets], np.int64)
        sides.append((sets, order, maps, spare, sizes, SignatureTree(maps, sizes, spare)))
        if same:
            sides *= 2
            break
    (sets_a, at_a, maps_a, spare_a, size_a, tree_a), (sets_b, at_b, maps_b, spare_b, size_b, tree_b) = sides
    exact = not spare_a.any() and not spare_b.any() and len(vocabulary) <= maps_a.shape[1] * 64
    out = [np.zeros((0, 2), np.int64)]
    for p, q in leaf_pairs(tree_a, tree_b, same).tolist():
        x, y = np.arange(p * LEAF, min(p * LEAF + LEAF, len(sets_a))), np.arange(q * LEAF, min(q * LEAF + LEAF, len(sets_b)))
        common = np.zeros((len(x), len(y)), np.int64)
        for word in range(0, maps_a.shape[1], 64):
            both = maps_a[x, None, word : word + 64] & maps_b[None, y, word : word + 64]
            common += np.bitwise_count(both).sum(-1, dtype=np.int64)
        common += np.minimum(spare_a[x, None], spare_b[None, y])
        near = 9 * common >= 4 * (size_a[x, None] + size_b[None, y])
        if same and p == q:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if not exact:
            true = [
                9 * len(np.intersect1d(sets_a[x[u]], sets_b[y[v]], assume_unique=True)) >= 4 * (size_a[x[u]] + size_b[y[v]])
                for u, v in zip(i.tolist(), j.tolist(), strict=True)
            ]
            i, j = i[true], j[true]
        out.append(np.stack([at_a[x[i]], at_b[y[j]]], 1))
    return np.concatenate(out)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each node's component under the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per class of a pair of blocks with links there: a class of its local component, documents linked."""
    first, second = int(pdf["first"].iloc[0]), int(pdf["second"].iloc[0])
    pdf = pdf.drop_duplicates("cls")  # rows repeated under one id bring their class again
    a = pdf[pdf["block"] == first]
    b = a if first == second else pdf[pdf["block"] == second]  # a block of the band above has a negative number
    if a.empty or b.empty:
        return pd.DataFrame({"cls": [], "near": [], "n_links": []}, dtype="int64")
    as_sets = lambda side: [np.asarray(t, np.int64).view(np.uint64) for t in side["tokens"]]
    sets_a = as_sets(a)
    i, j = links(sets_a, sets_a if first == second else as_sets(b), first == second).T
    both = a if first == second else pd.concat([a, b])
    if first != second:
        j = j + len(a)
    cls, copies = both["cls"].to_numpy(), both["copies"].to_numpy()
    linked = np.bincount(i, weights=copies[j], minlength=len(cls)) + np.bincount(j, weights=copies[i], minlength=len(cls))
    root, some = _local_roots(len(cls), i, j), np.flatnonzero(linked)
    return pd.DataFrame({"cls": cls[some], "near": cls[root[some]], "n_links": linked[some].astype(np.int64)})


def block_counts(sizes: DataFrame) -> DataFrame:
    """(label, band, salt, blocks) of the bands that need more than one block, once per salt."""
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.sqrt("members") / 4)).cast("int")
    large = sizes.select("label", "band", blocks.alias("blocks")).filter("blocks > 1")
    return large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def cluster_links(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, near, n_links) from the trees of every cluster, block against block.

    A cluster's sets are told apart by size first: in bands of a factor of 1.26
    linked sets are in one band or in neighbouring ones, so other block pairs never
    exist. A band of m sets has about sqrt(m) / 4 blocks, more if they hold many
    shingles, so blocks stay small, and a set is sent to as many tasks as its band
    and the two beside it have blocks. Block pairs, not clusters, are what tasks are
    dealt by, and joins on the cluster are salted, so one large cluster is spread
    over all tasks. The sets themselves travel once, to the tasks of their pairs.
    """
    rows = labels.select(F.col("id").alias("cls"), "label").join(sets.select("cls", "n_shingles"), "cls")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(BAND))).cast("int")
    rows = rows.withColumns({"band": band, "salt": F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(SALTS)).cast("int")})
    sizes = rows.groupBy("label", "band").agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("members"))
    many = materialize(block_counts(sizes), "shingle-blocks")  # of bands too large for one block
    present = materialize(sizes.select("label", "band", "members"), "shingle-bands")
    rows = rows.join(many, ["label", "band", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    for side in (-1, 1):
        # A neighbouring band that is not listed has one block or does not exist.
        beside = many.select("label", (F.col("band") - side).alias("band"), "salt", F.col("blocks").alias(f"blocks{side}"))
        rows = rows.join(beside, ["label", "band", "salt"], "left").withColumn(f"blocks{side}", F.coalesce(f"blocks{side}", F.lit(1)))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda lo, first, second: F.struct(lo.alias("band"), first.alias("first"), second.alias("second"))
    # The pair of (band, block i) and (band + 1, block j) is written as (band, i, -1 - j); inside one band as (band, i, j), i <= j.
    inside = F.transform(upto("blocks"), lambda o: pair(F.col("band"), F.least("block", o), F.greatest("block", o)))
    above = F.transform(upto("blocks1"), lambda o: pair(F.col("band"), F.col("block"), -1 - o))
    below = F.transform(upto("blocks-1"), lambda o: pair(F.col("band") - 1, o, -1 - F.col("block")))
    placed = rows.withColumn("block", block).select("cls", "label", "block", F.col("band").alias("own"), F.explode(F.concat(inside, above, below)).alias("pair"))
    placed = placed.select("cls", "label", F.when(F.col("own") == F.col("pair.band"), F.col("block")).otherwise(-1 - F.col("block")).alias("block"), "pair.*")
    # Inside a band a pair needs two members, between bands one on the other side too.
    crossing = F.col("second") < 0
    other = F.when(crossing & (F.col("block") >= 0), F.col("band") + 1).otherwise(F.col("band"))
    bands = present.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("band", "other")
    placed = placed.withColumns({"other": other, "salt": F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(SALTS)).cast("int")})
    placed = placed.join(bands, ["label", "other", "salt"]).filter(crossing | (F.col("members") > 1)).drop("other", "salt", "members")
    dealt = placed.join(sets.select("cls", "copies", "tokens"), "cls")
    keys = ["label", "band", "first", "second"]
    return dealt.repartition(*keys).groupBy(*keys).applyInPandas(_join_blocks, "cls long, near long, n_links long")


def jaccard_join(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row.

    ``component_id`` is the smallest id reachable by links, ``n_links`` the number
    of other documents that link to this one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = materialize(set_sizes(rows, n), "shingle-sizes")
    known = table.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies")
    )
    total = table.agg(F.sum(F.floor(F.col("n_shingles") / 4) + 1)).first()[0]
    hits = first_hits(rows, total, n)
    alive = materialize(
        classes.join(hits, "cls").filter(F.col("hits") > F.floor(F.col("n_shingles") / 25)).drop("hits"), "shingle-alive"
    )
    sets = materialize(class_sets(rows.join(alive.select("doc_id", "cls", "copies").hint("merge"), "doc_id"), n), "shingle-sets")
    routed = materialize(routes(sets, alive.agg(F.sum("n_shingles")).first()[0]), "shingle-routes")
    labels = clusters(routed)
    found = materialize(cluster_links(sets, labels), "shingle-links")
    drop(alive, sets, routed, labels)
    # Ids with several texts: their classes belong together, and a text without a set belongs to them.
    split = table.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("cls").alias("own"), F.max("cls").alias("last"), F.bool_or(F.col("cls").isNull()).alias("bare")
    )
    split = materialize(split.filter("own < last OR (own IS NOT NULL AND bare)").select("doc_id", "own"), "jaccard-split")
    held = known.join(split, "doc_id").filter("cls <> own").select(F.col("own").alias("a"), F.col("cls").alias("b"))
    joined = components(found.filter("cls <> near").select(F.col("cls").alias("a"), F.col("near").alias("b")).unionByName(held), "jaccard")
    firsts = joined.select(F.col("id").alias("cls"), "label").join(classes.select("cls", "doc_id"), "cls")
    component = firsts.groupBy("label").agg(F.min("doc_id").alias("least"))
    of_class = spread_join(firsts, component, "label").select("cls", "least")
    counted = found.groupBy("cls").agg(F.sum("n_links").alias("others"))
    answer = materialize(
        classes.join(of_class, "cls", "left").join(counted, "cls", "left").select(
            "cls", "copies",
            F.coalesce("least", "doc_id").alias("component_id"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "jaccard-classes",
    )
    drop(found, joined)
    placed = table.join(split, "doc_id", "left").withColumns({"bare": F.col("cls").isNull(), "cls": F.coalesce("cls", "own")})
    return of_classes(placed, answer).select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("bare"), 0).otherwise(F.coalesce("n_links", F.lit(0)))).alias("n_links"),
    )


def of_classes(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """``rows`` (doc_id, cls, ...) with component_id and n_links of their class, null where there is none.

    A class of very many copies is met in ``SALTS`` parts, and rows without a class,
    or whose class is known by then, are spread by their ids, so no value of the
    class gathers its rows in one task.
    """
    own = -1 - F.pmod(F.xxhash64("doc_id", "n_shingles"), F.lit(1 << 40))  # classes are 0 or more
    large = answer.filter(F.col("copies") >= MANY_COPIES).select(
        F.col("cls").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("component_id").alias("large_id"), F.col("n_links").alias("large_links")
    )
    rows = rows.withColumns({"key": F.coalesce("cls", own), "salt": F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SALTS)).cast("int")})
    rows = rows.join(large, ["key", "salt"], "left").withColumn("key", F.when(F.col("large_id").isNotNull(), own).otherwise(F.col("key")))
    small = answer.filter(F.col("copies") < MANY_COPIES).select(F.col("cls").alias("key"), "component_id", "n_links")
    found = rows.join(small, "key", "left")
    return found.withColumns({"component_id": F.coalesce("large_id", "component_id"), "n_links": F.coalesce("large_links", "n_links")})


def one_of_each(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose id is the smallest of its component.

    Texts of one id stay or go together, equal rows (id and text) as one row; rows
    with a null id stay.
    """
    gone = jaccard_join(docs, n, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialize(gone, "jaccard-gone")
    key = docs[id_col].cast("long")
    again = docs.select(key.alias("again")).groupBy("again").agg(F.count(F.lit(1)).alias("n")).filter("again IS NOT NULL AND n > 1")
    again = materialize(again.select("again"), "jaccard-again")
    kept = docs.join(gone, key == gone["gone"], "left_anti")
    single = kept.join(again, key == again["again"], "left_anti")
    return single.unionByName(kept.join(again, key == again["again"], "left_semi").dropDuplicates([id_col, text_col]))
