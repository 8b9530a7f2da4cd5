"""Cutting texts into pieces that a byte-level BPE encodes independently, a block of texts at a time.

The pre-token pattern (PATTERN) never joins a character that is not white space to white space behind it. So a text may be cut
before every run of white space, and each piece (a run of white space and what follows it) encodes alone as it does inside its text.
Cuts stand only before ASCII white space and never behind other white space, whose class engines might disagree on.
Pieces repeat much more often than texts: a block's different pieces are found by Arrow, and encoded once each.

Under any other pattern a text is one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pre-token pattern for which the cuts hold.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the texts of one block.
BLOCK_BYTES = 16_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that may end a white-space character of several bytes, and control characters that some engines count as white space.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[*range(0x1C, 0x20), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about `size` bytes together; one longer text is a batch of its own."""
    size = BLOCK_BYTES if size is None else size
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        at = 0
        lengths = np.cumsum(np.asarray(pc.binary_length(batch.column(column))).astype(np.int64))
        while at < batch.num_rows:
            before = int(lengths[at - 1]) if at else 0
            to = min(batch.num_rows, int(np.searchsorted(lengths, before + size - total)) + 1)
            held.append(batch.slice(at, to - at))
            total += int(lengths[to - 1]) - before
            at = to
            if total >= size:
                block, held, total = pa.concat_batches(held), [], 0
                yield block
                del block
    if held:
        block, held = pa.concat_batches(held), []
        yield block
        del block
    pa.default_memory_pool().release_unused()  # the worker may wait for its next task for long


def piece_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where pieces start; firsts: where texts start (places of empty texts may repeat or stand at the end)."""
    edge = np.zeros(len(data), bool)
    doubtful = []
    for part in range(0, len(data), 1 << 20):  # keeps what is made on the way small
        first = max(0, part - 1)
        here = data[first : part + (1 << 20)]
        space = _SPACE[here]
        np.greater(space[1:], space[:-1], out=edge[first + 1 : first + len(here)])
        doubtful.append(np.flatnonzero(edge[first + 1 : first + len(here)] & _DOUBTFUL[here[:-1]]) + (first + 1))
    at = np.concatenate(doubtful) if doubtful else np.zeros(0, np.int64)
    if len(at):
        b1, b2, b3 = data[at - 1], data[at - 2], data[at - 3]  # before the start of the data they are other bytes; a cut less does no harm
        white = b1 < 0x20
        white |= (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        white |= (b3 == 0xE1) & (((b2 == 0x9A) & (b1 == 0x80)) | ((b2 == 0xA0) & (b1 == 0x8E)))
        white |= (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
        white |= (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
        white |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
        edge[at[white]] = False
    edge[firsts[firsts < len(data)]] = True
    return np.flatnonzero(edge)


@dataclass
class Cut:
    """Different pieces, the number of each piece of the texts in order, and how many pieces each text has."""

    pieces: list[str]
    numbers: np.ndarray
    counts: np.ndarray


def strings(values: pa.Array) -> list[str]:
    """The strings of an array of UTF-8 bytes."""
    if not len(values):
        return []
    if pc.any(pc.match_substring(values, b"\0")).as_py():
        return values.cast(pa.large_string()).to_pylist()
    one = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)
    return pc.binary_join(one, pa.scalar(b"\0", values.type))[0].as_py().decode().split("\0")


def cut(texts: pa.Array, whole: bool = False) -> Cut:
    """Cuts an array of texts without nulls; whole: each text is one piece."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    places = offsets - offsets[0]
    starts = np.unique(places[:-1][places[:-1] < len(data)]) if whole else piece_starts(data, places[:-1])
    ends = np.append(starts, len(data)) + offsets[0]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), buffer]).dictionary_encode()
    return Cut(strings(coded.dictionary), np.asarray(coded.indices), np.diff(np.searchsorted(starts, places)))


@dataclass
class Lists:
    """Lists of ids one after another; list k is values[offsets[k] : offsets[k + 1]]."""

    offsets: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, lengths, values: np.ndarray) -> Lists:
        return cls(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), values)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def take(self, index: np.ndarray) -> np.ndarray:
        """The values of the lists named in index, one after another."""
        n = self.lengths[index]
        ends = np.cumsum(n)
        at = np.repeat(self.offsets[index] - (ends - n), n)
        at += np.arange(len(at))
        return self.values[at]

    def joined(self, index: np.ndarray, counts: np.ndarray) -> Lists:
        """Lists that join counts[k] of the lists named in index each."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[index])])
        return Lists(ends[np.concatenate([[0], np.cumsum(counts)])], self.take(index))


def words_of(pieces: list[str], findall: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words (matches of the pattern) of pieces, the word numbers of all pieces in order, and how many words each piece has.

    Letters, with or without one space before them, are one word, and a mark behind them another; these need no search.
    """
    known: dict[str, int] = {}
    numbers: list[int] = []
    counts = np.ones(len(pieces), np.int64)
    for k, p in enumerate(pieces):
        body = p[1:] if p[0] == " " else p
        if body.isalpha():
            numbers.append(known.setdefault(p, len(known)))
        elif p[-1] in ".,;:!?" and body[:-1].isalpha():
            counts[k] = 2
            numbers += (known.setdefault(p[:-1], len(known)), known.setdefault(p[-1], len(known)))
        else:
            found = findall(p)
            counts[k] = len(found)
            numbers.extend([known.setdefault(w, len(known)) for w in found])
    return list(known), np.array(numbers, np.int64), counts


def spans(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` of the counted things together, so that what is made of them stays small."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to
