"""Prefix trie of conversations by truncation peeling (operator 11).

A conversation becomes the chain of its turns' digests and lengths; texts stay behind.
Conversations lie in the order of their chains, dealt to tasks by ranges of it, so every
trie node's members are neighbours. A task peels its range: it descends from its greatest
depth, merges the conversations that end there with the nodes that survive, strips the
last turn and regroups by what is left. A node is discovered and finished in one step,
as its children have just been merged into it.

Nodes on a range's first and last chain may have members in other ranges. They stay open:
the range's two chains go on, each with what the range has found for its nodes without
their open children. These few chains are peeled in the same way in the next round, until
one task holds them all; a round keeps two chains of each range, so a hot first turn, host
or copied conversation takes no more tasks' time than any other. Children of open nodes
and what ended at them carry the open node's number within its task, and take the node's
smallest member from the round that closes it.

Ids that end at an open node are kept as text, some hundreds at a time, and hashed in
order by one task that streams them; no list of ids is ever whole in memory.

Edge cases: a null conversation id takes no part; a null turn comes first, turns of one
number follow in the order of their digests, and equal turns each count; null roles and
texts are empty; an absent host gives no turns; a conversation without turns is a
member of the root; a conversation lies in one row, 50 bytes a turn; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.merkle import CRC_SQL
from tallyspark.llm.scratch import materialize

#: Conversations of a block share the first turns of its first one: fewer than so many each.
BLOCK, SHARED = 100, 6
#: Turns that a task peels, and ids of one piece of text.
TURNS_PER_TASK = 200_000
IDS_PER_PIECE = 500
#: Hex digits of a turn's digest.
WIDTH = 32
NOTHING = hashlib.sha256(b"").hexdigest()

ENTRY = "struct<depth:int,n:bigint,low:bigint,kids:bigint,leaves:bigint,saved:bigint,key:bigint>"
PIECES = f"path string, chars array<bigint>, entries array<{ENTRY}>"
FOUND = f"kind string, low long, depth int, parent long, key long, n long, kids long, leaves long, saved long, ends string, place long, {PIECES}"
_NUMBERS = ("depth", "n", "low", "kids", "leaves", "saved", "key")
_KINDS = {
    "kind": pa.string(), "depth": pa.int32(), "ends": pa.string(), "path": pa.string(), "chars": pa.list_(pa.int64()),
    "entries": pa.list_(pa.struct([(c, pa.int32() if c == "depth" else pa.int64()) for c in _NUMBERS])),
}
_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars): the digests of the turns end to end, and the code points of their texts.

    A conversation takes its first crc32(id) % 6 turns from its host, the block's first
    conversation, and goes on with its own.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    digest = F.left(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), F.lit(WIDTH))
    turn = F.struct("turn", digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))
    own = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = materialize(own, "conversations")
    hosts = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("host"), F.slice("turns", 1, SHARED - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    joined = own.withColumn("host", F.col("conv_id") - F.col("conv_id") % BLOCK).join(hosts, "host", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), n), F.slice("turns", n + 1, F.size("turns")))
    joined = joined.select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.array_join(F.col("turns.digest"), "").alias("path"), F.col("turns.chars").alias("chars"))


class Node:
    """What is known of a trie node: its own entries and its finished children."""

    __slots__ = ("row", "n", "low", "kids", "leaves", "saved", "keys", "ended", "children")

    def __init__(self, row: int) -> None:
        self.row, self.n, self.low, self.kids, self.leaves, self.saved = row, 0, None, 0, 0, 0
        self.keys: list[int] = []
        self.ended: list[int] = []
        self.children: list[dict] = []

    def add(self, n: int, low: int | None, kids: int, leaves: int, saved: int) -> None:
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved
        if low is not None and (self.low is None or low < self.low):
            self.low = low


def chained(paths: list[str]) -> list[list[bytes]]:
    """Per path the digest of each of its prefixes, the empty one first; sorted paths share most of them with the one before."""
    out: list[list[bytes]] = []
    last, before = [], [b""]
    for path in paths:
        turns = [path[i : i + WIDTH] for i in range(0, len(path), WIDTH)]
        same = next((i for i, (a, b) in enumerate(zip(turns, last)) if a != b), min(len(turns), len(last)))  # noqa: B905
        chain = before[: same + 1]
        for turn in turns[same:]:
            chain.append(hashlib.blake2b(chain[-1] + bytes.fromhex(turn), digest_size=16).digest())
        out.append(chain)
        last, before = turns, chain
    return out


def peel(rows: list[tuple[str, list[int], list[dict]]], task: int, whole: bool, first_round: bool) -> Iterator[dict]:
    """Peel the sorted ``rows`` (path, chars, entries) of one task; unless ``whole``, nodes on the outer chains stay open."""
    chains = chained([r[0] for r in rows])
    outer = [] if whole else [0, len(rows) - 1]
    open_nodes: dict[bytes, int] = {}  # digest -> number, by the chain that carries it on
    carried: list[list[dict]] = []
    for row in outer:
        carried.append([])
        for key in chains[row]:
            open_nodes.setdefault(key, (task << 32) + len(open_nodes))
    carrier = {key: k for k in reversed(range(len(outer))) for key in chains[outer[k]]}
    ending: dict[int, list[tuple[int, dict]]] = {}
    for i, (_, _, entries) in enumerate(rows):
        for entry in entries:
            ending.setdefault(entry["depth"], []).append((i, entry))

    alive: dict[bytes, Node] = {}
    for depth in range(max(ending), -1, -1):
        for i, e in ending.get(depth, ()):
            node = alive.setdefault(chains[i][depth], Node(i))
            node.add(e["n"], e["low"], e["kids"], e["leaves"], e["saved"])
            if e["key"] is not None:
                node.keys.append(e["key"])
            if first_round:
                node.ended.append(e["low"])
        shorter: dict[bytes, Node] = {}
        for key, node in alive.items():
            number = open_nodes.get(key)
            if number is not None:
                carried[carrier[key]].append(dict(depth=depth, n=node.n, low=node.low, kids=node.kids, leaves=node.leaves, saved=node.saved, key=number))
                for child in node.children:
                    yield child | {"key": number}
                for old in node.keys:
                    yield {"kind": "link", "place": old, "key": number}
                for k in range(0, len(node.ended), IDS_PER_PIECE):
                    yield {"kind": "ids", "key": number, "place": (task << 32) + k, "ends": ",".join(map(str, node.ended[k : k + IDS_PER_PIECE]))}
                continue
            chars = rows[node.row][1][depth - 1] if depth else 0
            leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * chars
            found = {"kind": "node", "low": node.low, "depth": depth, "n": node.n, "kids": node.kids, "leaves": leaves, "saved": saved}
            if first_round:
                found["ends"] = hashlib.sha256(",".join(map(str, node.ended)).encode()).hexdigest() if node.ended else NOTHING
            for child in node.children:
                yield child | {"parent": node.low}
            for old in node.keys:
                yield {"kind": "link", "place": old, "low": node.low, "depth": depth}
            if depth:
                above = shorter.setdefault(chains[node.row][depth - 1], Node(node.row))
                above.add(node.n, node.low, 1, leaves, saved)
                above.children.append(found)
            else:
                yield found
        alive = shorter
    for row, entries in zip(outer, carried, strict=True):
        if entries:
            yield {"kind": "chain", "path": rows[row][0], "chars": rows[row][1], "entries": entries}


def peeled(pieces: DataFrame, first_round: bool, name: str) -> tuple[DataFrame, bool]:
    """(what a round finds, whether it was the last): pieces are dealt to tasks by ranges of their paths."""
    turns, n = pieces.agg(F.sum(F.size("chars") + 1), F.count(F.lit(1))).first()
    tasks = min(math.ceil((turns or 0) / TURNS_PER_TASK), math.ceil(n / 8))  # each task leaves two chains at most
    whole = tasks <= 1
    order = ["path", F.col("entries")[0]["low"]]
    dealt = pieces.repartition(1) if whole else pieces.repartitionByRange(tasks, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "entries")), strict=True)
        found = peel(rows, TaskContext.get().partitionId(), whole, first_round) if rows else iter(())
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in some], _KINDS.get(c, pa.int64())) for c in _COLUMNS], _COLUMNS)

    return materialize(dealt.sortWithinPartitions(*order).mapInArrow(run, FOUND), name), whole


def _hashed(pieces: DataFrame) -> DataFrame:
    """(low, depth, told): SHA-256 of each node's pieces of text in order, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for low, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("low", "depth", "ends")), strict=True):
                if (low, depth) == now:
                    digest.update(b",")
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (low, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _hash_rows(out)
        if now:
            yield _hash_rows([(*now, digest.hexdigest())])

    dealt = pieces.select("low", "depth", "place", "ends").repartition("low", "depth").sortWithinPartitions("low", "depth", "place")
    return dealt.mapInArrow(run, "low long, depth int, told string")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["low", "depth", "told"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations."""
    entry = {"depth": F.size("chars"), "n": F.lit(1), "low": F.col("conv_id"), "kids": F.lit(0), "leaves": F.lit(0), "saved": F.lit(0), "key": F.lit(None)}
    entries = F.array(F.struct(*(v.cast("int" if k == "depth" else "bigint").alias(k) for k, v in entry.items())))
    pieces = materialize(rebuilt(conversations), "rebuilt").select("path", "chars", entries.alias("entries"))
    rounds: list[DataFrame] = []
    while True:
        found, last = peeled(pieces, not rounds, f"trie-{len(rounds)}")
        rounds.append(found)
        if last:
            break
        pieces = found.filter("kind = 'chain'").select("path", "chars", "entries")
    # What an open node's number stands for, from the last round back to the first.
    closed, nodes = None, []
    for k in reversed(range(len(rounds))):
        part = rounds[k].filter("kind = 'node'").select("low", "depth", "parent", "key", "n", "kids", "leaves", "saved", "ends")
        if closed is not None:
            part = part.join(closed.select("key", F.col("low").alias("above")), "key", "left").withColumn("parent", F.coalesce("parent", "above")).drop("above")
        nodes.append(part.drop("key"))
        if k:
            links = rounds[k].filter("kind = 'link'").select(F.col("place").alias("old"), "low", "depth", "key")
            if closed is not None:
                later = closed.select("key", F.col("low").alias("l"), F.col("depth").alias("d"))
                links = links.join(later, "key", "left").select("old", F.coalesce("low", "l").alias("low"), F.coalesce("depth", "d").alias("depth"))
            closed = links.select(F.col("old").alias("key"), "low", "depth")
    table = nodes[0]
    for more in nodes[1:]:
        table = table.unionByName(more)
    if closed is not None:
        ids = rounds[0].filter("kind = 'ids'").select("key", "place", "ends")
        table = table.join(_hashed(ids.join(closed, "key")), ["low", "depth"], "left").withColumn("ends", F.coalesce("ends", "told"))
    return table.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


ORACLE_SQL = f"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL),{CRC_SQL},
  plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  told AS (SELECT conv_id, turn, length(text) AS chars, sha256(strlen(role) || ':' || role || text) AS digest FROM plain),
  own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM told),
  joined AS (SELECT id, 0 AS part, k, digest, chars FROM crcs JOIN own ON conv_id = id - id % {BLOCK} AND k <= crc % {SHARED}
    UNION ALL SELECT id, 1, k, digest, chars FROM crcs JOIN own ON conv_id = id AND k > crc % {SHARED}),
  prefixes AS (SELECT id, row_number() OVER w AS d, chars, string_agg(digest, '') OVER w AS path FROM joined WINDOW w AS (PARTITION BY id ORDER BY part, k)
    UNION ALL SELECT id, 0, 0, '' FROM ids),
  nodes AS (SELECT d, path, min(id) AS low, count(*) AS n, max(chars) AS chars FROM prefixes GROUP BY d, path),
  whole AS (SELECT id, max(d) AS d, max_by(path, d) AS path FROM prefixes GROUP BY id),
  ended AS (SELECT path, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ends FROM whole GROUP BY path),
  kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
  above AS (SELECT left(x.path, 64 * g.i) AS path, count(*) FILTER (WHERE k.kids IS NULL) AS leaves, sum((n - 1) * chars) AS saved
    FROM nodes x LEFT JOIN kids k ON k.path = x.path JOIN range(0, 100000) g(i) ON g.i <= x.d GROUP BY 1)
SELECT v.low AS conv_id, v.d AS depth, p.low AS parent_conv_id, v.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes v JOIN above a ON a.path = v.path LEFT JOIN kids k ON k.path = v.path LEFT JOIN ended e ON e.path = v.path
LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.path = left(v.path, 64 * (v.d - 1))"""
