"""Token counts that follow edits: a segment tree of pre-tokens for each document, kept with its text.

count() cuts texts where pre-tokens cannot cross (see pieces.py), puts LEAF_PIECES pieces into a leaf and writes with each
document the leaves of its tree: characters and tokens of each; the sums above follow from them without encoding.
recount() takes that table with edits: it finds the touched leaves by descending the character sums, encodes anew only
those leaves' text (with MARGIN characters of context on either side, since an edge nearer to the edit may be none any more),
and adds the differences along the path to the root. Touched text that has grown beyond a leaf is dealt over new leaves, so that
the next edit there stays as small. It returns the new texts and trees: the next recount() starts from those.

Edits are (at, removed, inserted) in code points of the text as the edits before left it; places beyond the text are moved to its end.

Defined results: a null text counts as empty (a tree without leaves); null or empty edits change nothing; null fields of an edit count
as 0 or empty; repeated rows each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import text_or_empty
from marquee.llm.pieces import PATTERN, blocks, cut, piece_starts, spans

LEAF_PIECES = 32
#: Whether a place is an edge depends on one character before it and one after.
MARGIN = 2
EDITS = "array<struct<at:int,removed:int,inserted:string>>"
#: A document and its tree: what count() writes and recount() reads and returns.
TREE = "leaf_chars array<int>, leaf_tokens array<int>"


class CountTree:
    """Sums of characters (column 0) and tokens (column 1); node i has children 2i and 2i + 1, leaves from `width` on."""

    def __init__(self, leaves: np.ndarray):
        self.grow(np.asarray(leaves, np.int64).reshape(-1, 2))

    def grow(self, leaves: np.ndarray) -> None:
        self.n = len(leaves)
        self.width = 1 << max(0, int(self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + self.n] = leaves
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[self.width : self.width + self.n]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last leaf with text, if beyond) and its first place."""
        node, start = 1, 0
        place = min(place, max(0, self.chars - 1))
        while node < self.width:
            node *= 2
            if place >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def replace(self, first: int, last: int, new: np.ndarray) -> None:
        """New leaves in place of those from first to before last: path sums if their number stays, else the tree is built anew from its leaves."""
        if len(new) != last - first:
            self.grow(np.concatenate([self.leaves[:first], new.reshape(-1, 2), self.leaves[last:]]))
            return
        for k, leaf in enumerate(new):
            node = first + k + self.width
            change = leaf - self.sums[node]
            while node:
                self.sums[node] += change
                node //= 2


def leaves_of(text: str, counts: Callable[[str], int], whole: bool = False) -> np.ndarray:
    """Characters and tokens of the leaves of a text."""
    if not text:
        return np.zeros((0, 2), np.int64)
    data = text.encode()
    starts = np.zeros(1, np.int64) if whole else piece_starts(np.frombuffer(data, np.uint8), np.zeros(1, np.int64))
    edges = [*starts[::LEAF_PIECES].tolist(), len(data)]
    parts = [data[a:b].decode() for a, b in zip(edges, edges[1:])]
    return np.array([[len(p), counts(p)] for p in parts], np.int64)


def edit(tree: CountTree, text: str, at: int, removed: int, inserted: str, counts: Callable[[str], int], whole: bool = False) -> tuple[str, int]:
    """The new text and how many characters were encoded anew; the tree is updated."""
    at = min(max(0, at), len(text))
    removed = min(max(0, removed), len(text) - at)
    if not removed and not inserted:
        return text, 0
    first, start = tree.leaf_at(max(0, at - MARGIN))
    while start and start + MARGIN > at:  # the edge before this leaf is too near
        first, start = tree.leaf_at(start - 1)
    after = at + removed + MARGIN
    last, end = tree.leaf_at(after) if after < len(text) else (tree.n, len(text))
    if last < tree.n and end < after:  # the end must be a leaf's edge at or behind `after`
        end += int(tree.leaves[last, 0])
        last += 1
    region = text[start:at] + inserted + text[at + removed : end]
    tree.replace(first, last, leaves_of(region, counts, whole))
    return text[:at] + inserted + text[at + removed :], len(region)


def _counter(pattern: str, ranks: dict[bytes, int]) -> Callable[[str], int]:
    import tiktoken

    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(library.encode_ordinary(t))


def _ints(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def count(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """id, text, n_tokens and the tree's leaf_chars and leaf_tokens of every row; and the edits, where the table has some that wait."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(pattern, shared.value)
        for block in blocks(batches):
            found = cut(block.column("text"), pattern != PATTERN)
            each = np.array([[len(p), counts(p)] for p in found.pieces], np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum(found.counts)])
            for a, b in spans(found.counts, 1 << 20):
                pieces = found.counts[a:b]
                leaves = -(-pieces // LEAF_PIECES)
                offsets = np.concatenate([[0], np.cumsum(leaves)])
                # leaf k of a text starts LEAF_PIECES * k pieces behind the text's first
                starts = np.repeat(ends[a:b] - ends[a], leaves) + LEAF_PIECES * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], leaves))
                sums = np.add.reduceat(each[found.numbers[ends[a] : ends[b]]], starts) if len(starts) else np.zeros((0, 2), np.int64)
                tokens = np.concatenate([[0], np.cumsum(sums[:, 1])])[offsets]
                docs_here = block.slice(a, b - a)
                columns = [docs_here.column("id"), docs_here.column("text"), pa.array(np.diff(tokens)), _ints(offsets, sums[:, 0]), _ints(offsets, sums[:, 1])]
                names = ["id", "text", "n_tokens", "leaf_chars", "leaf_tokens"]
                yield pa.RecordBatch.from_arrays(columns if edits_col is None else [*columns, docs_here.column("edits")], names=names if edits_col is None else [*names, "edits"])

    columns = [docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("text")]
    schema = f"id long, text string, n_tokens long, {TREE}"
    if edits_col is not None:
        columns.append(docs[edits_col].cast(EDITS).alias("edits"))
        schema += f", edits {EDITS}"
    return docs.select(*columns).mapInArrow(run, schema)


def recount(trees: DataFrame, ranks: dict[bytes, int], pattern: str, edits_col: str = "edits") -> DataFrame:
    """id, text, n_tokens, leaf_chars and leaf_tokens after the edits, tokens_before and encoded_chars (encoded anew) of every row of a table of count() or recount() with edits."""
    shared = trees.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(pattern, shared.value)
        whole = pattern != PATTERN
        for large in batches:
            for at in range(0, large.num_rows, 256):
                batch = large.slice(at, 256)
                sums = np.stack([np.asarray(c.flatten()) for c in (batch.column("leaf_chars"), batch.column("leaf_tokens"))], axis=1)
                ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(batch.column("leaf_chars"))))])
                texts, leaves, before, after, encoded = [], [], [], [], []
                for k, (text, edits) in enumerate(zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist())):
                    tree, n = CountTree(sums[ends[k] : ends[k + 1]]), 0
                    before.append(tree.tokens)
                    for e in edits or ():
                        if e is not None:
                            text, more = edit(tree, text, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", counts, whole)
                            n += more
                    texts.append(text)
                    leaves.append(tree.leaves)
                    after.append(tree.tokens)
                    encoded.append(n)
                offsets, new = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]), np.concatenate(leaves)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(texts, pa.string()), pa.array(after, pa.int64()), _ints(offsets, new[:, 0]), _ints(offsets, new[:, 1]), pa.array(before, pa.int64()), pa.array(encoded, pa.int64())],
                    names=["id", "text", "n_tokens", "leaf_chars", "leaf_tokens", "tokens_before", "encoded_chars"],
                )

    source = trees.select("id", "text", "leaf_chars", "leaf_tokens", F.col(edits_col).cast(EDITS).alias("edits"))
    return source.mapInArrow(run, f"id long, text string, n_tokens long, {TREE}, tokens_before long, encoded_chars long")
