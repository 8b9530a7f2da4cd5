"""Token ids of documents as directly addressable codes (DACs).

Each id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every token, level
k + 1 the next chunk of those tokens of level k that continue; a bitmap on each level marks them, and a rank
directory (ones before each 512 bits) leads from a token's place on a level to its place on the next. Any
token is read by one lookup a level, without decoding others.

A segment is one binary value that holds whole documents, at least SEGMENT_TOKENS tokens unless a task's rows end:

    "DAC1", levels u32, documents u32, tokens u64 | ids i64[d], known u8[d], ends u64[d] |
    for each level: items u64, chunks u8[n], continuation bitmap u8[ceil(n / 8)], ranks u32[ceil(n / 512)]

Segments are rows of a Parquet table (first_id, part, seq, part_start, n_tokens, segment) in ascending id order, so Spark writes
them to any store and a reader can fetch one segment alone; part_start counts the tokens before it in its part. A document is never split over segments.

Texts are encoded as the tokenizers library does by itself: the string of an added token in a text is that token.

Defined results: a null text counts as empty (its only token is the end id); null ids come first; rows that repeat an id follow
each other by text; an empty table gives empty files and an empty result; only id and text are read.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import scratch_root, text_or_empty
from marquee.llm.pieces import PATTERN, Cut, Lists, blocks, cut, spans, words_of

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
#: Different pieces, and characters of these, whose ids a Python worker keeps for the blocks and tasks that follow.
KEPT_PIECES, KEPT_CHARACTERS = 600_000, 8_000_000


# ---------------------------------------------------------------- the code


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> CHUNK_BITS) > 0
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(blocks) - blocks).astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), ranks))
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK_BITS


def unpack(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    below = None
    for chunks, bitmap, _ in reversed(levels):
        here = chunks.astype("<u4")
        if below is not None:
            here[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= below << CHUNK_BITS
        below = here
    return below


def token_at(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], i: int) -> int:
    """The i-th token alone."""
    value = 0
    for k, (chunks, bitmap, ranks) in enumerate(levels):
        value |= int(chunks[i]) << (CHUNK_BITS * k)
        if not bitmap[i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_BITS
        bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
        i = int(ranks[block]) + int(bits.sum())
    return value


def write_segment(ids: list[int | None], tokens: np.ndarray, ends: np.ndarray) -> bytes:
    levels = pack(tokens)
    parts = [MAGIC, np.array([len(levels), len(ids)], "<u4").tobytes(), np.array([len(tokens)], "<u8").tobytes()]
    parts += [np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(), ends.astype("<u8").tobytes()]
    for chunks, bitmap, ranks in levels:
        parts += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """ids, ends and levels; the arrays are views of data."""
    if data[:4] != MAGIC:
        raise ValueError("not a DAC segment")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    n_levels, n_docs = take("<u4", 2).tolist()
    take("<u8", 1)
    ids, known, ends = take("<i8", n_docs).tolist(), take("u1", n_docs).tolist(), take("<u8", n_docs)
    levels = []
    for _ in range(n_levels):
        n = int(take("<u8", 1)[0])
        levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // RANK_BITS))))
    return [i if k else None for i, k in zip(ids, known)], ends, levels


# ---------------------------------------------------------------- Spark


def visible_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it prints, else the next of those from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class LibraryEncoder:
    """Token ids of the texts of a block by the tokenizers library, as it encodes whole texts with add_special_tokens=False.

    Where the tokenizer is byte-level BPE over PATTERN, texts are cut (see pieces.py) and the library's model merges each different
    word once; pieces that hold the string of an added token go to the tokenizer as they are. Any other tokenizer gets whole texts.
    Ids of the first KEPT_PIECES different pieces are kept, since most pieces of a block stand in others too; no result depends on it.
    """

    def __init__(self, tokenizer_json: str):
        import json

        import regex
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.characters = self.tokenizer.model, visible_bytes()
        self.findall = regex.compile(PATTERN).findall
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        self.added = [a["content"] for a in added]
        self.kept, self.kept_ids, self.kept_characters = {}, Lists(np.zeros(1, np.int64), np.zeros(0, "<u4")), 0
        self.by_words = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].split() != [a["content"]] for a in added)
        )

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))]

    def __call__(self, texts: pa.Array) -> tuple[Lists, Cut]:
        """Ids of different pieces, and where the texts have them, by the numbers of these ids."""
        found = cut(texts, not self.by_words)
        if not self.by_words:
            coded = [self.whole(p) for p in found.pieces]
            return lists_of(coded), found
        numbers = np.fromiter(map(self.kept.get, found.pieces, itertools.repeat(-1)), np.int64, len(found.pieces))
        fresh = np.flatnonzero(numbers < 0)
        pieces = [found.pieces[k] for k in fresh]
        new = self.fresh(pieces)
        numbers[fresh] = len(self.kept) + np.arange(len(fresh))
        ids = Lists(np.concatenate([self.kept_ids.offsets, self.kept_ids.offsets[-1] + new.offsets[1:]]), np.concatenate([self.kept_ids.values, new.values]))
        self.keep(pieces, ids)
        return ids, Cut(found.pieces, numbers[found.numbers], found.counts)

    def fresh(self, pieces: list[str]) -> Lists:
        """Ids of pieces by their words."""
        words, numbers, counts = words_of(pieces, self.findall)
        ids = lists_of([self.word(w) for w in words]).joined(numbers, counts)
        odd = {k: self.whole(p) for a in self.added for k, p in enumerate(pieces) if a in p}
        if odd:
            ids = lists_of([odd[k] if k in odd else ids.values[ids.offsets[k] : ids.offsets[k + 1]] for k in range(len(pieces))])
        return ids

    def keep(self, pieces: list[str], ids: Lists) -> None:
        """Keeps as many of the pieces as still have room; ids: those of the kept ones, then theirs."""
        ends = self.kept_characters + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        more = min(KEPT_PIECES - len(self.kept), int(np.searchsorted(ends, KEPT_CHARACTERS, "right")))
        if more > 0:
            self.kept.update(zip(pieces[:more], itertools.count(len(self.kept))))
            self.kept_ids = Lists(ids.offsets[: len(self.kept) + 1].copy(), ids.values[: ids.offsets[len(self.kept)]].copy())
            self.kept_characters = int(ends[more - 1])


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_json: str) -> LibraryEncoder:
    """The Python worker's encoder, which Spark's next tasks in it go on with."""
    return LibraryEncoder(tokenizer_json)


def lists_of(coded: list) -> Lists:
    return Lists.of(np.fromiter(map(len, coded), np.int64, len(coded)), np.fromiter(itertools.chain.from_iterable(coded), "<u4"))


def segments(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the segment table, range-partitioned and sorted by id."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(shared.value)
        ids, parts, total, seq, written = [], [], 0, 0, 0
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            ends = np.cumsum([len(p) + 1 for p in parts[::2]])
            data = write_segment(ids, tokens, ends)
            return pa.RecordBatch.from_pydict({"first_id": pa.array([ids[0]], pa.int64()), "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "part_start": pa.array([written], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "segment": pa.array([data], pa.binary())})

        for block in blocks(batches):
            coded, found = encode(block.column(1))
            doc_ids, at = block.column(0).to_pylist(), np.concatenate([[0], np.cumsum(found.counts)])
            for a, b in spans(found.counts, 1 << 19):
                some = coded.joined(found.numbers[at[a] : at[b]], found.counts[a:b])
                for k in range(a, b):
                    ids.append(doc_ids[k])
                    parts += [some.values[some.offsets[k - a] : some.offsets[k - a + 1]], end]
                    total += len(parts[-2]) + 1
                    if total >= SEGMENT_TOKENS:
                        yield flush()
                        written += total
                        ids, parts, total, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    rows = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("text"))
    return rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, "first_id long, part int, seq int, part_start long, n_tokens long, segment binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    segments(docs, tokenizer_json, end_id, id_col, text_col).write.parquet(path)


def read_tokens(spark, path: str, digest: Callable[[np.ndarray], int] = lambda ids: zlib.crc32(ids.tobytes())) -> DataFrame:
    """id, start, n_tokens and digest (of the ids as little-endian unsigned 32-bit integers) of every document of a segment table.

    Starts are sums of two levels: a segment knows the tokens before it in its part; the window runs over the parts, of which
    each writing task made one.
    """
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids, ends, levels = read_segment(data.as_py())
                tokens, ends = unpack(levels), ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                found = [digest(tokens[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(base + starts), pa.array(ends - starts), pa.array(found, pa.int64())], names=["part", "id", "inner", "n_tokens", "digest"]
                )

    documents = files.select("part", "part_start", "segment").mapInArrow(run, "part int, id long, inner long, n_tokens long, digest long")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    return documents.join(parts, "part").select("id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "digest")


def segment_path(spark) -> str:
    import uuid

    return f"{scratch_root(spark)}/marquee/tokens-{uuid.uuid4().hex}"
