"""Exact top-k inner products with a KD-tree per shard (operator 10).

1. Cells. Vectors become integers, floor(scale * x). Median splits of a bounded
   sample cut space into at most ``CELLS`` cells; every vector is dealt to its cell,
   and a cell of many vectors, equal ones included, to several shards by row.
2. Trees. Each shard's KD-tree is built once and written down: median splits of the
   widest dimension, a tight bounding box per node.
3. Search in three rounds: one shard of the cell that promises most, the ``NEAR``
   cells that promise most, all others. A round takes the kth score that a query has
   reached from the round before, and leaves out cells of whose box no point could
   reach it. In a tree nodes are visited best first, by the largest inner product that
   any point of the box could have, until that bound is below the kth score.

Queries come in blocks, so neither side has to fit into one task. The driver holds
the sample, the cells' splits, boxes and sizes: at most ``SAMPLE`` vectors.

Edge cases: null vectors, vectors with null or non-finite components, and rows
with a null id take no part; repeated ids are repeated candidates, and a query's
own id is no candidate of it, whichever row holds it; repeated queries of one id
are answered once, by the smallest vector; vectors of different lengths do not
meet (those of another length than most of the sample form one cell without a box);
ties go to the smaller id; a score beyond 64 bits raises; fewer candidates than k
give fewer rows; an empty table gives none; only the named columns are read.
"""

from __future__ import annotations

import heapq
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import drop, materialize

LEAF = 128
#: Vectors per shard and queries per block, about.
SHARD_ROWS, BLOCK_ROWS = 2048, 8192
#: Vectors that the cells' splits are learned from, cells at most, and cells of the second round.
SAMPLE, CELLS, NEAR = 2048, 256, 4
#: Beyond this magnitude sums of products round as doubles; exact Python integers take over.
EXACT = 1 << 53


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part."""

    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    fine = F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, whole).alias("v"), F.size(vector_col).alias("dim")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def cell_splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(dimension, value) of a full binary tree's inner nodes in heap order; a value of infinity sends all left."""
    splits, parts = [], [sample]
    while len(parts) < cells:
        halves = []
        for part in parts:
            wide = part.max(0) - part.min(0) if len(part) else np.zeros(0)
            if len(wide) and wide.max() > 0:
                dim = int(wide.argmax())
                value = float(np.median(part[:, dim]))
                value = value if value < part[:, dim].max() else float(part[:, dim].min())
            else:
                dim, value = 0, np.inf
            splits.append((dim, value))
            left = part[:, dim] <= value if part.shape[1] else np.ones(len(part), bool)
            halves += [part[left], part[~left]]
        parts = halves
    return splits


def cells_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point."""
    dims, values = np.array([d for d, _ in splits], np.int64), np.array([v for _, v in splits])
    node = np.zeros(len(points), np.int64)
    while len(splits) and len(points) and points.shape[1] and node[0] < len(splits):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > values[node])
    return node - len(splits) if len(points) and node[0] >= len(splits) else node


class Tree:
    """Median splits with tight boxes; leaves hold runs of the reordered rows."""

    PARTS = ("low", "high", "kids", "span", "points", "ids")

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        low, high, kids, span = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = points[order[a:b]]
            me = len(low)
            low.append(part.min(0)), high.append(part.max(0)), span.append((a, b)), kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = me
            wide = high[me] - low[me]
            if b - a > LEAF and len(wide) and wide.max() > 0:
                dim, mid = int(wide.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, dim], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.low, self.high, self.kids, self.span = np.array(low), np.array(high), np.array(kids), np.array(span)
        self.points, self.ids = points[order], ids[order]

    def written(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.PARTS})
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for name in cls.PARTS:
                setattr(tree, name, parts[name])
        return tree

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, id), none below ``least``; ties to the smaller id."""
        bounds = np.where(query >= 0, self.high, self.low) @ query
        heap, best = [(-bounds[0], 0)], []  # best: a heap of (score, -id)
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if self.kids[node][0] >= 0:
                for kid in self.kids[node].tolist():
                    if bounds[kid] >= least:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            a, b = self.span[node]
            scores, ids = self.points[a:b] @ query, self.ids[a:b]
            near = np.flatnonzero((scores >= least) & (ids != own))
            for i in near[np.lexsort((ids[near], -scores[near]))][:k].tolist():
                item = (scores[i], -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                else:
                    break
            if len(best) == k:
                least = max(least, best[0][0])
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _exact(matrix: np.ndarray) -> np.ndarray:
    whole = np.empty(matrix.shape, object)
    whole[...] = [[int(x) for x in row] for row in matrix] if matrix.size else whole
    return whole


def _searcher(k: int):
    def run(key, trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(trees) and len(queries):
            tree, asked = Tree.read(trees["tree"].iloc[0]), _matrix(queries["v"])
            largest = np.abs(tree.points).max(initial=0) * np.abs(asked).max(initial=0) * max(asked.shape[1], 1)
            if largest >= EXACT:
                tree.low, tree.high, tree.points, asked = map(_exact, (tree.low, tree.high, tree.points, asked))
            for q, own, least in zip(asked, queries["vec_id"].tolist(), queries["kth"].tolist(), strict=True):
                out += [(own, i, int(s)) for s, i in tree.search(q, own, k, least)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _dealer(splits: list[tuple[int, float]], main: int):
    """Gives every row its cell; other lengths than ``main`` share the cell after the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.full(len(batch), len(splits) + 1, np.int64)
            same = (batch["dim"] == main).to_numpy()
            cell[same] = cells_of(_matrix(batch["v"][same]), splits)
            yield batch.assign(cell=cell)

    return run


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(_matrix(rows["v"]), rows["vec_id"].to_numpy(np.int64))
    of = {name: rows[name].iloc[0] for name in ("cell", "sub", "dim")}
    return pd.DataFrame([{**of, "low": tree.low[0], "high": tree.high[0], "tree": tree.written()}])


def _asker(cells: np.ndarray, low: np.ndarray, high: np.ndarray, main: int, other: int, first: int, last: int):
    """Names a query's cells, those of rank ``first`` to before ``last`` by what their boxes promise, if they can reach its kth score."""
    widest = np.maximum(np.abs(low), np.abs(high))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for v, dim, kth in zip(batch["v"], batch["dim"], batch["kth"], strict=True):
                if dim != main:
                    found.append([(other, 0)] if first == 0 else [])
                    continue
                query = np.asarray(v, np.float64)
                bound = np.where(query >= 0, high, low) @ query + 1e-12 * (widest @ np.abs(query))  # room for rounding
                order = np.argsort(-bound, kind="stable")[first:last]
                found.append([(int(cells[i]), first + r) for r, i in enumerate(order.tolist()) if bound[i] >= kth])
            times = [len(f) for f in found]
            out = batch.loc[batch.index.repeat(times)].copy()
            out["cell"] = np.array([c for f in found for c, _ in f], np.int64)
            out["place"] = np.array([r for f in found for _, r in f], np.int64)
            yield out

    return run


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per query (rows whose id is divisible by ``every``) its k best other rows."""
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toPandas()["v"]
    main = Counter(len(v) for v in sample).most_common(1)[0][0] if len(sample) else 0
    cells = 1
    while cells < CELLS and cells * SHARD_ROWS < n:
        cells *= 2
    splits = cell_splits(_matrix(pd.Series([v for v in sample if len(v) == main])), cells)
    numbered = rows.select("*", F.monotonically_increasing_id().alias("row"))
    dealt = materialize(
        numbered.mapInPandas(_dealer(splits, main), "vec_id long, v array<double>, dim int, row long, cell long"), "kd-dealt"
    )
    held = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most CELLS + 1 rows
    n_subs = F.array(*(F.lit(-(-held.get(c, 1) // SHARD_ROWS)) for c in range(cells + 1)))
    subs_of = F.element_at(n_subs, F.col("cell").cast("int") + 1)
    sharded = dealt.select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("row"), subs_of).alias("sub"))
    trees = materialize(
        sharded.groupBy("cell", "sub", "dim").applyInPandas(_build, "cell long, sub long, dim int, low array<double>, high array<double>, tree binary"),
        "kd-trees",
    )
    sides = trees.filter(F.col("dim") == main).select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("place", "side"))
    edges = sides.groupBy("cell", "place").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high")).toPandas()  # a box per cell
    edges = edges.sort_values(["cell", "place"])
    known = np.array(sorted(c for c in held if c < cells), np.int64)
    low, high = (edges[side].to_numpy(np.float64).reshape(len(known), main) for side in ("low", "high"))

    blocks = max(1, -(-n // (every * BLOCK_ROWS)))
    asked = (
        dealt.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        .select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("block"))
    )
    asked = materialize(asked, "kd-queries")
    keys, shard = ["cell", "sub", "dim", "block"], ["cell", "sub", "dim"]
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(queries: DataFrame, first: int, last: int, first_sub: int, last_sub: int) -> DataFrame:
        """What the round's cells and shards hold for the queries, from their kth scores on."""
        schema = "vec_id long, v array<double>, dim int, block long, kth double, cell long, place long"
        meant = queries.select("vec_id", "v", "dim", "block", "kth").mapInPandas(_asker(known, low, high, main, cells, first, last), schema)
        meant = materialize(meant, "kd-asked")
        used.append(meant)
        reach = F.sequence(F.lit(0).cast("long"), (subs_of - 1).cast("long"))
        meant = meant.select("*", F.explode(reach).alias("sub"))
        pilot = (F.col("place") == 0) & (F.col("sub") == 0)
        meant = meant.filter(pilot if last_sub else ~pilot if first_sub else F.lit(True)).drop("place")
        places = meant.select(*(F.col(name).alias(name) for name in keys)).distinct()
        wanted = trees.select(*shard, "tree").join(places, shard)
        search = wanted.groupBy(*keys).cogroup(meant.groupBy(*keys))
        return search.applyInPandas(_searcher(k), "query_id long, vec_id long, score long")

    found, open_end = None, F.lit(float("-inf"))
    queries, used = asked.withColumn("kth", open_end), []
    for step, (first, last, first_sub, last_sub) in enumerate([(0, 1, 0, 1), (0, NEAR, 1, 0), (NEAR, cells, 0, 0)]):
        if step == 2 and cells <= NEAR:
            break
        more = answers(queries, first, last, first_sub, last_sub)
        both = more if found is None else found.unionByName(more)
        best = both.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        found = materialize(best.drop("rank"), f"kd-round-{step}")
        used.append(found)
        # A little below the kth score, as a double may be above the whole number.
        kth = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15
        reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(kth).alias("kth")).filter(F.col("n") == k)
        queries = asked.join(reached.select(F.col("query_id").alias("vec_id"), "kth"), "vec_id", "left").withColumn("kth", F.coalesce("kth", open_end))
    drop(dealt, trees, asked, *(table for table in used if table is not found))
    return found.withColumn("rank", F.row_number().over(by_score).cast("int")).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
