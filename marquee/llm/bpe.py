"""Byte-level BPE: Spark higher-order functions fold ranked merges over the byte arrays of distinct words.

Encoding runs in one stage without a shuffle. Each task takes its documents in blocks (see pieces.py). A first
Arrow step finds the distinct pieces of a block and the distinct words (matches of the pre-token pattern) of those, sends the
words' byte arrays, then the documents as numbers of pieces; Spark's aggregate() folds the merges over every byte array, looking
ranks up in a literal map (dealt into buckets, since Spark searches a map from end to end); a second Arrow step
gathers each block's ids by number. Words once folded are kept for the next blocks of the task, up to KEPT_WORDS; both steps
number them alike. A word that is a token by itself needs no fold. The fold takes time with the square of a word's length, so words of over FOLD_BYTES bytes
are merged by the tiktoken library instead, with the same ranks; results are the same.

Decoding maps ids to their binary pieces and concatenates them, in Spark functions.

Vocabularies of up to 131,071 ids; a pattern other than pieces.PATTERN makes whole texts the pieces, which gives the same ids slower.

Defined results: a null text counts as empty and has no ids; repeated rows each get a row; ids outside the vocabulary
decode to nothing; an empty table gives an empty result; of the table only the id, text and named row columns are read.
"""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import text_or_empty
from marquee.llm.pieces import PATTERN, Lists, blocks, cut, spans, words_of

FOLD_BYTES = 256
#: Bytes of a block here, where two Python workers for each core hold one.
BLOCK_BYTES = 12_000_000
BUCKETS = 32749
#: Folded words, and characters of these, that a task keeps for the blocks that follow.
KEPT_WORDS, KEPT_CHARACTERS = 400_000, 6_000_000
#: Stands before and after the bytes of a word; it merges with nothing.
EDGE = 256
#: State of the fold: one long for each piece, rank of its merge with the next piece << 34 | first byte << 17 | id.
ID_BITS, RANK_SHIFT = 17, 34
ID_MASK, NO_RANK = (1 << ID_BITS) - 1, (1 << 17) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, which is also the vocabulary: rank = id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# ---------------------------------------------------------------- the fold


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a fold over nothing whose finish is the body."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """Array of BUCKETS maps from a pair of ids (left << 17 | right) to the id of their merge << 34; a constant."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pair = a << ID_BITS | b
                buckets[pair % BUCKETS][str(pair)] = rank << RANK_SHIFT
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")


def start_literal(ranks: dict[bytes, int]) -> Column:
    """State of the fold for a byte and the byte or EDGE behind it, at (EDGE + 1) * byte + next, its place still to be added; a constant."""
    ids = [*(ranks[bytes([b])] for b in range(256)), ID_MASK]
    rank = lambda a, b: NO_RANK if EDGE in (a, b) else ranks.get(bytes([a, b]), NO_RANK)
    return F.split(F.lit(",".join(str(rank(a, b) << RANK_SHIFT | ids[a]) for a in range(EDGE + 1) for b in range(EDGE + 1))), ",").cast("array<bigint>")


def encoded_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of each word of an array of byte arrays, which stand between two EDGE marks (array<array<int>>)."""
    return _let(rank_literal(ranks), lambda table: _let(start_literal(ranks), lambda starts: F.transform(words, lambda data: merged(data, table, starts))))


def merged(data: Column, table: Column, starts: Column) -> Column:
    """Ids of one word from its byte array: at each step the pair of lowest rank merges, the leftmost first."""
    none = F.lit(NO_RANK << RANK_SHIFT).cast("bigint")
    keep_all_but_rank = F.lit((1 << RANK_SHIFT) - 1)
    keep_place = F.lit((1 << RANK_SHIFT) - (1 << ID_BITS))

    def ranked(a: Column, b: Column) -> Column:
        """The rank of a pair of ids, in its place in the state."""
        return _let(F.shiftleft(a, ID_BITS).bitwiseOR(b), lambda pair: F.coalesce(F.get(table, (pair % BUCKETS).cast("int"))[pair], none))

    def id_of(piece: Column) -> Column:
        return piece.bitwiseAND(F.lit(ID_MASK))

    def merge(pieces: Column, lowest: Column, at: Column) -> Column:
        """The piece at `at` (from 1) and the next become one; the piece before gets its new rank."""
        new = F.shiftright(lowest, RANK_SHIFT)
        here = ranked(new, id_of(F.get(pieces, at + 1))).bitwiseOR(lowest.bitwiseAND(keep_place)).bitwiseOR(new)
        # no two pieces of a word are equal, since each carries its first byte
        return _let(
            F.get(pieces, at - 2),
            lambda before: F.transform(
                F.array_remove(pieces, F.get(pieces, at)), lambda x: F.when(x == lowest, here).when(x == before, ranked(id_of(before), new).bitwiseOR(before.bitwiseAND(keep_all_but_rank))).otherwise(x)
            ),
        )

    def step(pieces: Column, _: Column) -> Column:
        return _let(F.array_min(pieces), lambda low: F.when(low < none, _let(F.array_position(pieces, low).cast("int"), lambda at: merge(pieces, low, at))).otherwise(pieces))

    pairs = F.transform(data, lambda x, i: F.get(starts, x * (EDGE + 1) + F.coalesce(F.get(data, i + 1), F.lit(EDGE))).bitwiseOR(F.shiftleft(i.cast("bigint"), ID_BITS)))
    # n bytes between their marks merge n - 1 times at most
    return _let(F.aggregate(F.slice(data, F.lit(4), F.size(data)), pairs, step), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda x: id_of(x).cast("int")))


# ---------------------------------------------------------------- blocks

#: What a row between the two Arrow steps holds: words to fold, lengths and ids of the other words, how many folded words to keep, word counts and word numbers of pieces, or a document's piece numbers.
FOLD, LENGTHS, GIVEN, KEEP, COUNTS, WORDS, DOCUMENT = range(7)
ROWS = "kind int, words array<array<int>>, flat array<int>, id long, row_no string"


def _byte_arrays(words: list[bytes]) -> pa.Array:
    """Lists of byte values between two EDGE marks, from one buffer."""
    ends = np.cumsum([len(w) + 2 for w in words])
    flat = np.full(int(ends[-1]), EDGE, np.int32)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    inside[np.concatenate([[0], ends[:-1]])] = False
    flat[inside] = np.frombuffer(b"".join(words), np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def _lists(offsets: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32, copy=False)))


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, direct: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """For each block: its new words, its pieces, then its documents. Words kept from blocks before are numbered first, then those to fold, in the order of their rows."""
    import regex

    findall = regex.compile(pattern).findall
    kinds = {"kind": pa.int32(), "words": pa.list_(pa.list_(pa.int32())), "flat": pa.list_(pa.int32()), "id": pa.int64(), "row_no": pa.string()}
    library = None
    kept: dict[str, int] = {}
    characters = 0

    def rows(kind: int, n: int = 1, **columns) -> pa.RecordBatch:
        columns["kind"] = pa.array([kind] * n, pa.int32())
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

    def flat(kind: int, values: np.ndarray) -> pa.RecordBatch:
        return rows(kind, flat=_lists(np.array([0, len(values)]), values))

    def ids_of(word: str, data: bytes) -> list[int]:
        nonlocal library
        if data in direct:
            return [direct[data]]
        if library is None:
            import tiktoken

            library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=direct, special_tokens={})
        return library.encode_ordinary(word)

    for block in blocks(batches, size=BLOCK_BYTES):
        found = cut(block.column("text"), pattern != PATTERN)
        block = block.select(["id", "row_no"])  # the texts are numbers from here on
        words, numbers, counts = words_of(found.pieces, findall)
        found.pieces = []
        place = np.fromiter(map(kept.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        words = [words[k] for k in new]
        coded = [w.encode() for w in words]
        folds = np.array([b not in direct and len(b) <= FOLD_BYTES for b in coded], bool)
        order = np.argsort(~folds, kind="stable")
        place[new[order]] = len(kept) + np.arange(len(order))
        first = int(folds.sum())
        for at in range(0, first, 2048):
            some = [coded[k] for k in order[at : min(at + 2048, first)]]
            yield rows(FOLD, words=_lists(np.array([0, len(some)]), _byte_arrays(some)))
        given = [ids_of(words[k], coded[k]) for k in order[first:]]
        yield flat(LENGTHS, np.fromiter(map(len, given), np.int32, len(given)))
        yield flat(GIVEN, np.fromiter(itertools.chain.from_iterable(given), np.int32))
        ends = characters + np.cumsum(np.fromiter((len(words[k]) for k in order[:first]), np.int64, first))
        more = min(KEPT_WORDS - len(kept), int(np.searchsorted(ends, KEPT_CHARACTERS, "right")))
        if more:
            kept.update(zip([words[k] for k in order[:more]], itertools.count(len(kept))))
            characters = int(ends[more - 1])
        yield flat(KEEP, np.array([more]))
        yield flat(COUNTS, counts)
        yield flat(WORDS, place[numbers])
        del words, coded, given, numbers
        ends = np.concatenate([[0], np.cumsum(found.counts)])
        for a, b in spans(found.counts, 1 << 18):
            docs = block.slice(a, b - a)
            yield rows(DOCUMENT, b - a, id=docs.column("id"), row_no=docs.column("row_no"), flat=_lists(ends[a : b + 1] - ends[a], found.numbers[ends[a] : ends[b]]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each document from the words and pieces of its block, and from words of blocks before."""
    kept = Lists(np.zeros(1, np.int64), np.zeros(0, np.int32))
    lengths: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    parts: dict[int, np.ndarray] = {}
    pieces = None

    for batch in batches:
        kinds = np.asarray(batch.column("kind"))
        edges = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (kinds[1:] != DOCUMENT)]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)]):  # one row of words or pieces, or some documents
            some = batch.slice(a, b - a)
            kind = int(kinds[a])
            if kind == FOLD:
                folded = some.column("ids").flatten()
                lengths.append(np.asarray(folded.value_lengths()))
                ids.append(np.asarray(folded.flatten()))
                continue
            flat = some.column("flat")
            values = np.asarray(flat.flatten())
            if kind != DOCUMENT:
                parts[kind] = values
                if kind == WORDS:
                    words = Lists.of(np.concatenate([kept.lengths, *lengths, parts[LENGTHS]]), np.concatenate([kept.values, *ids, parts[GIVEN]]))
                    pieces = words.joined(values, parts[COUNTS])
                    if more := int(parts[KEEP][0]):
                        n = len(kept.lengths) + more
                        kept = Lists(words.offsets[: n + 1].copy(), words.values[: words.offsets[n]].copy())
                    words, lengths, ids = None, [], []
                continue
            counts = np.asarray(flat.value_lengths())
            ends = np.concatenate([[0], np.cumsum(counts)])
            for x, y in spans(counts, 1 << 18):
                tokens = pieces.joined(values[ends[x] : ends[y]], counts[x:y])
                docs = some.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([docs.column("id"), docs.column("row_no"), _lists(tokens.offsets, tokens.values)], names=["id", "row_no", "ids"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, row_no (row_col as text, if given) and ids (array<int>) of every row."""
    if max(ranks.values(), default=0) >= ID_MASK:
        raise ValueError(f"the fold holds ids below {ID_MASK}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size
    row = F.lit(None).cast("string") if row_col is None else docs[row_col].cast("string")
    source = docs.select(docs[id_col].cast("long").alias("id"), row.alias("row_no"), text_or_empty(docs, text_col).alias("text"))
    numbered = source.mapInArrow(lambda b: _blocks(b, pattern, shared.value), ROWS)
    coded = numbered.select("kind", encoded_words(F.col("words"), ranks).alias("ids"), "flat", "id", "row_no")
    return coded.mapInArrow(_joined, "id long, row_no string, ids array<int>")


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    size = max(ranks.values()) + 1
    pieces = [""] * size
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
