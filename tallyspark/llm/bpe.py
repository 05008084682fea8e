"""Byte-pair encoding and decoding by tree concatenation (operator 8).

A text is halved, wherever the middle falls, until its parts are short. The parts
are encoded by themselves, and neighbours are joined pairwise, level by level: a
window of text around the seam is encoded anew, and grown until its first pieces
are those of the left half and its last ones those of the right half. A piece is
what no merge crosses; where it ends depends on what follows it and on nothing
before it, so from a common end on both sides go on alike, and the joined list is
exact. Each distinct piece is encoded once per worker. A piece longer than a leaf
is a tree of its own, over tokens: an encoding is the right one when each adjacent
pair of its tokens is, so agreement in one token at either end of a window makes
the joined list exact.

The upper halves of a text longer than ``PART_TEXT`` are rows of their own, encoded by
tasks that other parts of the same text do not share; in a second step the parts of a
text meet by its row, and the seams between them are encoded anew in the same way. Only there is
a text's list of pieces whole, as its digests ask for.

Edge cases: null text counts as empty; empty text gives no ids; each input row
gives one output row, repeated rows and null ids included; only the named id and
text columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import materialize

#: Characters above which a piece is encoded as a tree of leaves, and above which a text is.
LEAF_CHARS, LEAF_TEXT = 1024, 512
#: Characters above which the halves of a text are rows of their own.
PART_TEXT = 1 << 16
#: Characters on either side of a seam that the first window holds.
SEAM_CHARS = 24
#: Pieces that a worker remembers before it starts anew.
MEMORY_PIECES = 400_000

# How the vocabulary's own pattern sorts the code points below U+0100.
LATIN_LETTERS = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_SPACES = "\t-\r \x85\xa0"
LATIN_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
)
BLANK = re.compile("[^\t-\r ]+")
#: Begins a piece whose bytes are already written as letters.
MAPPED = "\uffff"


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered(dict):
    """piece -> make(ids of the piece), filled on demand."""

    def __init__(self, encoder: PieceEncoder, make: Callable):
        super().__init__()
        self.encoder, self.make = encoder, make

    def __missing__(self, piece: str):
        value = self.make(self.encoder.piece_ids(piece))
        if len(piece) < LEAF_CHARS:
            self[piece] = value
        return value


class PieceEncoder:
    """Ids of texts under one vocabulary file of word-final BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = self.whole.normalizer, self.whole.pre_tokenizer
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = {t: self.whole.token_to_id(t) for t in special}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        vocab, merges = self.whole.get_vocab(with_added_tokens=False), _merges(path)
        self.end = "</w>"
        self.final = BPE(vocab, merges, end_of_word_suffix=self.end)
        self.inner = Tokenizer(BPE(vocab, merges))
        self.outer = Tokenizer(self.final)
        self.n_ids = max(self.whole.get_vocab().values()) + 1
        self.token = {i: t for t, i in self.whole.get_vocab().items()}
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def plain(self, text: str) -> bool:
        """Whether the text has code points below U+0100 only and no special token."""
        try:
            return b"<|" not in text.encode("latin-1")
        except UnicodeEncodeError:
            return False

    def pieces(self, text: str, plain: bool | None = None) -> list[str]:
        """The text's pieces in order, each as its bytes' letters or a special token."""
        if self.plain(text) if plain is None else plain:
            return LATIN_PIECE.findall(text.lower())
        out: list[str] = []
        for chunk in BLANK.findall(text):
            for part in self.special_cut.split(chunk):
                if part in self.special:
                    out.append(part)
                elif part:
                    mapped = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))
                    out += [MAPPED + piece for piece, _ in mapped]
        return out

    def tree_pieces(self, text: str, plain: bool | None = None, known: dict[tuple[int, int], list[str]] | None = None) -> list[str]:
        """As ``pieces``, by halves that are encoded on their own and joined; ``known`` holds the pieces of some parts (``halves``)."""
        plain = self.plain(text) if plain is None else plain
        known = known or {}

        def tree(start: int, stop: int) -> list[str]:
            if (start, stop) in known:
                return known[start, stop]
            if stop - start <= LEAF_TEXT:
                return self.pieces(text[start:stop], plain)
            middle = (start + stop) // 2
            return seam(start, middle, stop, tree(start, middle), tree(middle, stop))

        def seam(start: int, middle: int, stop: int, left: list[str], right: list[str]) -> list[str]:
            width = SEAM_CHARS
            while True:
                a, b = max(middle - width, start), min(middle + width, stop)
                if a == start and b == stop:
                    return self.pieces(text[a:b], plain)
                before, new, after = (self.pieces(text[x:y], plain) for x, y in ((a, middle), (a, b), (middle, b)))
                # The window's outermost piece may be cut; those beside it must be the halves' own. At the halves' ends nothing is cut.
                if a == start:
                    n_left, skip, agrees = len(left), 0, before == left
                else:
                    n_left, skip = len(before) - 1, 1
                    agrees = n_left >= 2 and before[1:] == left[-n_left:] and new[:2] == before[:2]
                if agrees and b == stop:
                    n_right, keep, agrees = len(right), len(new), after == right
                elif agrees:
                    n_right, keep = len(after) - 1, len(new) - 1
                    agrees = n_right >= 2 and after[:-1] == right[:n_right] and new[-2:] == after[-2:]
                if agrees and keep > skip:
                    return left[: len(left) - n_left] + new[skip:keep] + right[n_right:]
                width *= 2

        return tree(0, len(text))

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        if piece[0] == MAPPED:
            mapped = piece[1:]
        else:
            mapped = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        if len(mapped) > LEAF_CHARS:
            return self.tree_ids(mapped)
        return [t.id for t in self.final.tokenize(mapped)]

    def tree_ids(self, mapped: str) -> list[int]:
        """Encode leaves side by side, then join neighbours until one list is left."""
        cuts = range(0, len(mapped), LEAF_CHARS)
        leaves = [mapped[i : i + LEAF_CHARS] for i in cuts]
        level = [e.ids for e in self.inner.encode_batch(leaves[:-1])] + [self.outer.encode(leaves[-1]).ids]
        while len(level) > 1:
            joined = [self.joined(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Re-encode growing windows around the seam until both ends agree."""
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            text = "".join(self.token[i] for i in a + b)
            last = text.endswith(self.end)
            text = text.removesuffix(self.end)
            seam = (self.outer if last else self.inner).encode(text).ids
            agree_left = len(a) == len(left) or seam[0] == a[0]
            agree_right = len(b) == len(right) or seam[-1] == b[-1]
            if agree_left and agree_right:
                return left[: len(left) - len(a)] + seam + right[len(b) :]
            width *= 2

    def piece_list_ids(self, pieces: list[str]) -> list[int]:
        return [i for piece in pieces for i in self.piece_ids(piece)]

    def ids(self, text: str) -> list[int]:
        return self.piece_list_ids(self.tree_pieces(text))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: its tokens are joined by blanks."""
        return " ".join(self.token[i] for i in ids)


def halves(start: int, stop: int, most: int) -> list[tuple[int, int]]:
    """The parts of at most ``most`` characters that halving leaves, in order."""
    if stop - start <= most:
        return [(start, stop)]
    middle = (start + stop) // 2
    return halves(start, middle, most) + halves(middle, stop, most)


def _merges(path: str) -> list[tuple[str, str]]:
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["merges"]
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_MEMORIES: dict[tuple[str, str], Remembered] = {}


def remembered(path: str, kind: str, make: Callable) -> Remembered:
    """The worker's piece memory of this kind, emptied when it has grown large."""
    known = _MEMORIES.setdefault((path, kind), Remembered(encoder(path), make))
    if len(known) > MEMORY_PIECES:
        known.clear()
    return known


def _id_text(ids: list[int]) -> str:
    return " ".join(map(str, ids))


def _encoded(docs: DataFrame, vocab: str, told: Callable[[PieceEncoder, list[str]], tuple], schema: str, kinds: list[pa.DataType], id_col: str, text_col: str) -> DataFrame:
    """doc_id and what ``told`` makes of the pieces of each text: short texts as they lie, long ones by parts."""
    names, most = [c.split()[0] for c in schema.split(", ")], PART_TEXT
    part_names = ["row", "doc_id", "plain", "start", "stop", "text"]
    part_kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds], strict=True)], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        for batch in batches:
            yield rows_of([(i, *told(coder, coder.tree_pieces(t or ""))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(vocab), TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, row = text.as_py(), row + 1
                plain = coder.plain(text)
                found = [(row, doc_id, plain, a, b, text[a:b]) for a, b in halves(0, len(text), most)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), part_kinds, strict=True)], part_names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        for batch in batches:
            pieces = [coder.tree_pieces(t.as_py(), p.as_py()) for t, p in zip(batch.column("text"), batch.column("plain"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in part_names), pa.array(pieces, pa.list_(pa.string()))], [*part_names, "pieces"])

    def join(table: pa.Table) -> pa.Table:
        coder = encoder(vocab)
        table = table.sort_by("start")
        bounds = zip(table["start"].to_pylist(), table["stop"].to_pylist(), strict=True)
        known = {at: pieces.as_py() for at, pieces in zip(bounds, table["pieces"], strict=True)}
        pieces = coder.tree_pieces("".join(table["text"].to_pylist()), table["plain"][0].as_py(), known)
        return pa.Table.from_batches([rows_of([(table["doc_id"][0].as_py(), *told(coder, pieces))])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long = F.char_length("text") > most
    short = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(whole, schema)
    part_schema = "row long, doc_id long, plain boolean, start long, stop long, text string"
    # Written, so that the rows' numbers are drawn once.
    parts = materialize(rows.filter(long).mapInArrow(parted, part_schema), "bpe-parts")
    # A number of tasks is named, as few bytes are much work here and would be put together otherwise.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = parts.repartition(tasks, "row", "start").mapInArrow(encode, f"{part_schema}, pieces array<string>")
    return short.unionByName(pieces.repartition(tasks, "row").groupBy("row").applyInArrow(join, schema))


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int) and the text decoded from them."""

    def told(coder: PieceEncoder, pieces: list[str]) -> tuple:
        ids = coder.piece_list_ids(pieces)
        return ids, coder.decode(ids)

    return _encoded(docs, vocab, told, "doc_id long, ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()], id_col, text_col)


def encode_digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, digests of the ids and of the decoded text."""

    def told(coder: PieceEncoder, pieces: list[str]) -> tuple:
        id_text, decoded = remembered(vocab, "id_text", _id_text), remembered(vocab, "decoded", coder.decode)
        joined = " ".join([id_text[p] for p in pieces])
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return joined.count(" ") + 1 if joined else 0, digest(joined), digest(" ".join([decoded[p] for p in pieces]))

    return _encoded(docs, vocab, told, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], id_col, text_col)
