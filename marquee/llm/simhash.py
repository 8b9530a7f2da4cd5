"""SimHash near-duplicates with a generalised pigeonhole index.

Fingerprints of 64 bits are cut into partitions of correlated bits. By the general pigeonhole
principle two fingerprints within distance d agree, in at least one of m partitions, up to that
partition's threshold t[i], for any integers t[i] >= -1 with sum(t) = d - m + 1. Each
fingerprint gets its own thresholds from a dynamic program over estimated candidate counts, probes
every value of a partition within its threshold, and every candidate is verified on all 64 bits.

near_duplicates() links by differing bits. deduplicated() takes a similarity of word shingles instead, and decides every pair by its
two whole sets. The index above proposes the first pairs. Texts of similarity 0.8 often differ in more bits than it finds at a
bearable cost, so texts also meet at the rarest shingles of their sets, of which similar sets share at least one (see prefix_of()):
first one partner is tried for each, then every pair that is not connected yet. So no pair is lost.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and links like
any other; repeated rows each get a row; a null id stays null and never becomes a component id unless its whole
component has none; an empty table gives an empty result. Only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marquee.llm.common import HOT, discard, join_counted, keep_rows, materialise, text_or_empty, with_row_ids

BITS = 64
#: Rows of one side of a verification block; larger buckets are split into several blocks.
BLOCK_ROWS = 4096
#: Cost of sending one probe, in candidate comparisons.
PROBE_COST = 32.0
MAX_RADIUS = 2
#: Parities (at least) that tell most unlike sets apart; meeting places of more sets than FEW compare this many at once.
SKETCH_BITS, FEW = 1024, 8
#: A shingle is common from so many texts on, or so many of each 10,000; how many common ones are sent to all tasks.
COMMON_FROM, COMMON_MOST = 3, 100_000


# ---------------------------------------------------------------- fingerprints


def fingerprint_of(text: str, words: int = 4) -> int:
    """The SimHash of one text; unsigned."""
    return int(fingerprint_from(shingle_hashes(text, words)))


def shingle_hashes(text: str, words: int = 4) -> np.ndarray:
    """The hash of every word shingle of one text, in its order; none for a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    shingles = max(1, len(parts) - words + 1)
    first = starts[:shingles].tolist()
    last = ends[len(parts) - shingles :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(shingles, "<u8")
    for at in range(0, shingles, 65536):
        hashes[at : at + 65536] = [digest(joined[a:b], 42) for a, b in zip(first[at : at + 65536], last[at : at + 65536])]
    return hashes


def fingerprint_from(hashes: np.ndarray) -> np.uint64:
    """A bit is set if it is in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    source = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("text"))
    return source.mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds


def correlated_partitions(counts: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Group the bits: start from the most correlated free bit, add those most correlated with the group.

    counts[i][j]: fingerprints with both bits set.
    """
    share = counts / max(total, 1)
    p = np.diag(share)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(share - np.outer(p, p), spread, out=np.zeros_like(share), where=spread > 0))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        order = sorted(free)
        group = [max(order, key=lambda b: corr[b, order].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """One row of partition values for each group of bits."""
    u = fps.view(np.uint64)
    out = np.zeros((len(groups), len(u)), np.int64)
    for g, bits in enumerate(groups):
        for k, b in enumerate(bits):
            out[g] |= (((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.int64)
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """All values of that width with at most radius bits set; zero first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], np.int64)


def ball_counts(histogram: np.ndarray, width: int, max_radius: int) -> np.ndarray:
    """[e][v]: fingerprints whose value is within e bits of v."""
    at = np.arange(len(histogram))
    rows, total, seen = [], np.zeros(len(histogram)), 0
    for e in range(max_radius + 1):
        ring = masks(width, e)[seen:]
        seen += len(ring)
        for m in ring:
            total = total + histogram[at ^ m]
        rows.append(total)
    return np.stack(rows).astype(np.float32)


def allocate(values: np.ndarray, balls: list[np.ndarray], widths: list[int], distance: int) -> np.ndarray:
    """Thresholds for each fingerprint (row) and partition (column), at the least estimated cost.

    Dynamic program over partitions and the budget spent; thresholds run from -1 (skip) to MAX_RADIUS.
    """
    parts, n = values.shape
    top = balls[0].shape[0] - 1
    choices = range(-1, top + 1)
    budget = distance - parts + 1
    spent = range(-parts, budget + parts + 1)
    best = {0: np.zeros(n, np.float32)}
    took: list[dict[int, np.ndarray]] = []
    for p in range(parts):
        step: dict[int, np.ndarray] = {}
        how: dict[int, np.ndarray] = {}
        cost = {-1: np.zeros(n, np.float32)} | {e: balls[p][e][values[p]] + np.float32(PROBE_COST * len(masks(widths[p], e))) for e in range(top + 1)}
        for b, so_far in best.items():
            for e in choices:
                if b + e not in spent:
                    continue
                total = so_far + cost[e]
                if b + e not in step:
                    step[b + e], how[b + e] = total, np.full(n, e, np.int8)
                else:
                    less = total < step[b + e]
                    step[b + e] = np.where(less, total, step[b + e])
                    how[b + e] = np.where(less, np.int8(e), how[b + e])
        best = step
        took.append(how)
    if budget not in best:
        raise ValueError(f"distance {distance} needs more than {parts} partitions with radius {top}")
    out = np.zeros((n, parts), np.int8)
    left = np.full(n, budget)
    for p in range(parts - 1, -1, -1):
        for b, how in took[p].items():
            here = left == b
            out[here, p] = how[here]
        left = left - out[:, p]
    return out


# ---------------------------------------------------------------- links


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that connect what the pairs a-b connect; at most one for each value."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label.copy())  # what a label stood for gets the smaller one too
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def verified(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, probe): indexed fingerprints of a block come before its probes.

    Emits spanning links of the pairs within the distance; memory holds one batch and the open block's index side.
    """
    open_block, held = None, np.zeros(0, np.int64)
    for batch in batches:
        block = np.asarray(batch.column("block"))
        probe = np.asarray(batch.column("probe"))
        fp = np.asarray(batch.column("fp"))
        if not len(block):
            continue
        if open_block is not None and block[0] == open_block:
            block = np.concatenate([np.full(len(held), open_block), block])
            probe = np.concatenate([np.zeros(len(held), bool), probe])
            fp = np.concatenate([held, fp])
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(starts[1:], len(block))
        indexed = np.add.reduceat((~probe).astype(np.int64), starts)
        which = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.flatnonzero(probe)
        first, count = starts[which[at]], indexed[which[at]]
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        done = np.concatenate([[0], np.cumsum(count)])
        k = 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(done, done[k] + 500_000, "right")) - 1)
            c = count[k:to]
            other = np.repeat(first[k:to] - (done[k:to] - done[k]), c) + np.arange(done[to] - done[k])
            left, right = fp[np.repeat(at[k:to], c)], fp[other]
            near = (np.bitwise_count((left ^ right).view(np.uint64)) <= distance) & (left != right)
            if near.any():
                more, less = spanning_links(left[near], right[near])
                yield pa.RecordBatch.from_arrays([pa.array(more), pa.array(less)], names=["a", "b"])
            k = to
        open_block = block[-1]
        held = fp[starts[-1] : starts[-1] + indexed[-1]]


def measured_partitions(nodes: DataFrame, parts: int) -> tuple[list[list[int]], list[int], list[np.ndarray]]:
    """Partitions of correlated bits, their widths, and how many fingerprints (column fp) have each value of each."""

    def pair_counts(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            fps = np.asarray(batch.column(0))
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    cells = nodes.select("fp").mapInArrow(pair_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 64 x 64 + 1 rows
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in cells:
        flat[r.cell] = r.n
    groups = correlated_partitions(flat[:-1].reshape(BITS, BITS).astype(float), int(flat[-1]), parts)
    widths = [len(g) for g in groups]
    if max(widths) > 16:
        raise ValueError("use at least 4 partitions: a histogram has 2^width cells")

    def value_counts(batches):
        for batch in batches:
            values = part_values(np.asarray(batch.column(0)), groups)
            found = [np.unique(v, return_counts=True) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(v), p, np.int32) for p, (v, _) in enumerate(found)])), pa.array(np.concatenate([v for v, _ in found]).astype(np.int32)), pa.array(np.concatenate([c for _, c in found]))], names=["part", "value", "n"]
            )

    counted = nodes.select("fp").mapInArrow(value_counts, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    histograms = [np.zeros(1 << w) for w in widths]
    for batch in [counted.toArrow()]:  # at most parts * 2^16 rows
        for p in range(parts):
            here = batch.filter(pa.compute.equal(batch["part"], p))
            histograms[p][here["value"].to_numpy()] = here["n"].to_numpy()
    return groups, widths, histograms


def links(nodes: DataFrame, distance: int = 4, parts: int = 4) -> DataFrame:
    """Links a > b that connect all fingerprints (column fp, distinct) within the distance, directly or in steps."""
    spark = nodes.sparkSession
    groups, widths, histograms = measured_partitions(nodes, parts)
    shared = spark.sparkContext.broadcast([ball_counts(h, w, MAX_RADIUS) for h, w in zip(histograms, widths)])

    def probes(batches):
        balls = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                fps = np.asarray(whole.column(0)[at : at + 2048])
                values = part_values(fps, groups)
                thresholds = allocate(values, balls, widths, distance)
                salt = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)  # any spread of equal keys
                out = []

                def send(p, who, value, probe):
                    index_blocks = np.maximum(1, np.ceil(balls[p][0][value] / BLOCK_ROWS)).astype(np.int64)
                    probe_blocks = np.maximum(1, np.ceil(balls[p][MAX_RADIUS][value] / BLOCK_ROWS)).astype(np.int64)
                    own, copies = (probe_blocks, index_blocks) if probe else (index_blocks, probe_blocks)
                    own = (salt[who] % own.astype(np.uint64)).astype(np.int64)
                    other = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    who, value, own = (np.repeat(x, copies) for x in (who, value, own))
                    i, j = (other, own) if probe else (own, other)
                    block = (((np.int64(p) << 16) | value) << 40) | (i << 20) | j
                    out.append((block, np.full(len(who), probe), fps[who]))

                for p in range(parts):
                    send(p, np.arange(len(fps)), values[p], False)
                    for e in range(MAX_RADIUS + 1):
                        who = np.flatnonzero(thresholds[:, p] == e)
                        if len(who):
                            around = masks(widths[p], e)
                            send(p, np.repeat(who, len(around)), np.repeat(values[p][who], len(around)) ^ np.tile(around, len(who)), True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["block", "probe", "fp"])

    sent = nodes.select("fp").mapInArrow(probes, "block long, probe boolean, fp long")
    return sent.repartition("block").sortWithinPartitions("block", "probe").mapInArrow(lambda b: verified(b, distance), "a long, b long").distinct()


# ---------------------------------------------------------------- exact similarity of shingle sets

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte, the base of the polynomial over them and its inverse (all modulo 2^64).
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_PART = 1 << 16
_POWERS = np.cumprod(np.full(_PART, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(_PART, _INVERSE, np.uint64))


def stirred(x: np.ndarray) -> np.ndarray:
    """x (overwritten) with its high bits spread over all."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and places of the words of a text (between ASCII white space, A-Z lower-cased): polynomials over the bytes, from running sums."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    bytes_ = _LOWER[np.frombuffer(data, np.uint8)]
    space = _SPACE[bytes_]
    at = 0
    while at < len(bytes_):
        to = min(len(bytes_), at + _PART)
        if to < len(bytes_):  # a part ends at its last white space; a longer word is a part of its own
            gap = np.flatnonzero(space[at:to])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                more = np.flatnonzero(space[to:])
                to = to + int(more[0]) if len(more) else len(bytes_)
        here, gaps = bytes_[at:to], np.concatenate([[True], space[at:to], [True]])
        starts, ends = np.flatnonzero(gaps[:-1] & ~gaps[1:]), np.flatnonzero(~gaps[:-1] & gaps[1:])
        if len(starts):
            powers, inverses = _POWERS, _INVERSES
            if len(here) > _PART:
                powers, inverses = (np.cumprod(np.full(len(here), x, np.uint64)) for x in (_BASE, _INVERSE))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[here] * powers[: len(here)])])
            hashes.append(stirred((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)))
            places.append(starts + at)
        at = to
    return np.concatenate(hashes), np.concatenate(places)


def shingle_hashes_of(found: np.ndarray, words: int) -> np.ndarray:
    """Hashes of every `words` neighbouring word hashes."""
    n = len(found) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += found[k : k + n]
        stirred(total)
    return stirred(total)


def sets_of_texts(texts: list[str], words: int, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The different word shingles of each text as ascending 64-bit hashes; a text of fewer words has one of all of them, one without words none.

    Texts of about `size` bytes together are hashed at once.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(c) + 1 for c in coded])
    at = 0
    while at < len(coded):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        hashes, places = word_hashes(b"\n".join(coded[at:to]))
        bounds = np.searchsorted(places, ends[at:to] - (ends[at - 1] if at else 0)).tolist()
        every = shingle_hashes_of(hashes, words) if len(hashes) >= words else None
        for a, b in zip([0, *bounds], bounds):
            if b - a >= words:
                yield np.unique(every[a : b - words + 1])
            else:
                yield shingle_hashes_of(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        at = to


def shingle_set(text: str, words: int) -> np.ndarray:
    return next(sets_of_texts([text], words))


def digest_of(hashes: np.ndarray) -> int:
    """The node number of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).astype(np.int64))


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles of all texts (text), ascending, and how many texts have each.

    Every text is counted. The counts only order the shingles, so that rare ones propose pairs, and cut the meetings at common ones into
    blocks: no result depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = np.concatenate(list(sets_of_texts(batch.column(0)[at : at + 256].to_pylist(), words)))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    least = max(COMMON_FROM, -(-COMMON_FROM * texts.count() // 10_000))
    counted = texts.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counted.orderBy(F.col("n").desc(), "shingle").limit(COMMON_MOST).toArrow()
    hashes, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_hash = np.argsort(hashes)
    return hashes[by_hash], n[by_hash]


def frequency_of(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many texts have each shingle; 0 for one that is not common."""
    common, n = order
    if not len(common):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, n[at], 0)


def prefix_of(hashes: np.ndarray, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n - ceil(similarity * n) + 1 rarest shingles of a set (ascending hashes): two sets of that similarity share at least one of theirs.

    They have ceil(similarity * n) shingles in common for the n of either, so the first common one in the order stands among these of both.
    """
    s = Fraction(str(similarity))
    first = len(hashes) - -(-len(hashes) * s.numerator // s.denominator) + 1
    return hashes[np.argsort(frequency_of(hashes, order), kind="stable")][: first if len(hashes) else 0]


def sketch_of(hashes: np.ndarray) -> bytes:
    """At least 2 parities for each shingle, each of which flips one. Two sketches differ in no more bits than their sets differ in shingles;
    halves of a sketch that are xored are a sketch of half the bits."""
    bits = max(SKETCH_BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else SKETCH_BITS
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketch: bytes, longs: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, longs), axis=0)


def sketches(column: pa.Array) -> np.ndarray:
    """One row of SKETCH_BITS bits, as longs, for each sketch."""
    return np.array([folded(b, SKETCH_BITS // 64) for b in column.to_pylist()], np.uint64).reshape(-1, SKETCH_BITS // 64)


def far_apart(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, s: Fraction) -> np.ndarray:
    """Whether sets of sizes n and m with these sketches differ in more shingles than similar sets may: (1 - s) / (1 + s) of the sum of sizes."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (s.denominator + s.numerator) > (n + m) * (s.denominator - s.numerator)


def shingle_sets(texts: DataFrame, words: int, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row for each different shingle set of texts (row_no, id, text): node (its digest), fp, n (its size), prefix (see prefix_of()), sketch
    and first (the first of its rows: null ids last, then by id and row)."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = list(sets_of_texts(batch.column(2).to_pylist(), words))
                fps = np.array([fingerprint_from(h) for h in sets], np.uint64).view(np.int64)
                nodes = np.array([digest_of(h) for h in sets], np.int64)
                prefixes = [prefix_of(h, similarity, shared.value) for h in sets]
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64)))
                columns = [batch.column(1), batch.column(0), pa.array(fps), pa.array(nodes), pa.array([len(h) for h in sets], pa.int64()), prefix, pa.array([sketch_of(h) for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row_no", "fp", "node", "n", "prefix", "sketch"])

    described = texts.select("row_no", "id", "text").mapInArrow(run, "id long, row_no string, fp long, node long, n long, prefix array<long>, sketch binary")
    # all but the id and row follow from the set, so any row of it will do
    return described.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no")).alias("first"), *[F.first(c).alias(c) for c in ("fp", "n", "prefix", "sketch")])


#: Of a set: its size << 32 and how many of its shingles stand from the block's one on in the order of rarity.
SIZE_SHIFT = 32


def may_be_similar(x: np.ndarray, y: np.ndarray, s: Fraction) -> np.ndarray:
    """Whether sets that share no shingle before the block's can still be similar: overlap >= s * union is (1 + s) * overlap >= s * (sum of sizes)."""
    low = (1 << SIZE_SHIFT) - 1
    return np.minimum(x & low, y & low) * (s.numerator + s.denominator) >= s.numerator * ((x >> SIZE_SHIFT) + (y >> SIZE_SHIFT))


def met(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, node, size) sorted by block and node. Emits those of blocks where several sets meet, with the block's first set, if
    it may be similar. Memory holds one batch and a block's first row."""
    s = Fraction(str(similarity))
    held, sent = [np.zeros(0, np.int64)] * 3, False
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(held[0])
        block, node, size = (np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns))
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        counts = np.diff(np.append(starts, len(block)))
        first = np.repeat(starts, counts)
        out = np.repeat(counts > 1, counts)
        if old and sent:
            out[0] = False
        at = np.flatnonzero(out)
        if len(at):
            near = may_be_similar(size[at], size[first[at]], s) & (node[at] != node[first[at]])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (block, node, size)), pa.array(node[first[at]], mask=~near)], names=["block", "node", "size", "first"])
        sent = bool(counts[-1] > 1)
        held = [x[starts[-1] : starts[-1] + 1] for x in (block, node, size)]


def meetings(nodes: DataFrame, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """block, node, size and first (see met()) of the sets (nodes: node, n, prefix) wherever several meet at a shingle of their prefixes.

    A common shingle of over BLOCK_ROWS texts is cut into slices, each pair of which is one block.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(order)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                node, n = (np.asarray(batch.column(k)) for k in range(2))
                lengths = np.asarray(pa.compute.list_value_length(batch.column(2))).astype(np.int64)
                who = np.repeat(np.arange(len(node)), lengths)
                left = n[who] - (np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
                block = np.asarray(batch.column(2).flatten()).view(np.uint64)
                slices = np.maximum(1, np.ceil(frequency_of(block, shared.value) / BLOCK_ROWS)).astype(np.int64)
                own = (((node[who].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % slices.astype(np.uint64)).astype(np.int64)
                other = np.arange(slices.sum()) - np.repeat(np.cumsum(slices) - slices, slices)
                who, left, block, own = (np.repeat(x, slices) for x in (who, left, block, own))
                # slice 0 with itself keeps the shingle's hash; blocks that fall together only propose more
                block = block + (np.minimum(own, other) * 0x632BE59BD9B4E019 + np.maximum(own, other) * 0x1E3779B97F4A7C15).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.view(np.int64), node[who], (n[who] << SIZE_SHIFT) | left)], names=["block", "node", "size"])

    rows = nodes.select("node", "n", "prefix").mapInArrow(sent, "block long, node long, size long")
    return rows.repartition("block").sortWithinPartitions("block", "node").mapInArrow(lambda b: met(b, similarity), "block long, node long, size long, first long")


def proposed(batches: Iterator[pa.RecordBatch], similarity: float, one_each: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (block, root, node, size, and sketch or not) sorted by block and root.

    Emits the pairs a > b of a block that are not of one root and may be similar by their sizes, if the block's shingle is the first
    that they share, and by their sketches; one_each: only the first of them for each row. Memory holds one batch and the open block.
    """
    s = Fraction(str(similarity))
    open_block, held = None, None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns[:4]]
        if not len(columns[0]):
            continue
        if batch.num_columns > 4:
            columns.append(sketches(batch.column(4)))
        old = 0
        if columns[0][0] == open_block:
            old = len(held[0])
            columns = [np.concatenate([h, x]) for h, x in zip(held, columns)]
        block, root, node, size = columns[:4]
        new_block = np.concatenate([[True], block[1:] != block[:-1]])
        starts = np.flatnonzero(new_block)
        first = np.repeat(starts, np.diff(np.append(starts, len(block))))
        runs = np.flatnonzero(new_block | np.concatenate([[True], root[1:] != root[:-1]]))
        own = np.repeat(runs, np.diff(np.append(runs, len(block))))
        at = np.arange(old, len(block))  # every new row meets the rows of its block with smaller roots
        count = own[at] - first[at]
        at, count = at[count > 0], count[count > 0]
        done = np.concatenate([[0], np.cumsum(count)])
        k = 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(done, done[k] + 50_000, "right")) - 1)
            c = count[k:to]
            x = np.repeat(at[k:to], c)
            y = np.repeat(first[at[k:to]] - (done[k:to] - done[k]), c) + np.arange(done[to] - done[k])
            may = may_be_similar(size[x], size[y], s)
            x, y = x[may], y[may]
            if len(columns) > 4:
                near = ~far_apart(columns[4][x], columns[4][y], size[x] >> SIZE_SHIFT, size[y] >> SIZE_SHIFT, s)
                x, y = x[near], y[near]
            if one_each:
                x, first_of = np.unique(x, return_index=True)
                y = y[first_of]
            x, y = node[x], node[y]
            if len(x):
                pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            k = to
        open_block = block[-1]
        held = [x[starts[-1] :] for x in columns]


def open_pairs(found: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, one_each: bool = False) -> DataFrame:
    """Pairs a > b of sets of different roots that meet (found: see meetings()): all of that similarity and some below; one_each: of each a one, no more than there are sets.

    Where more than FEW sets meet, their sketches (of nodes) come with them, so that unlike pairs are never written out.
    """
    big = found.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("block")
    rooted = found.select("block", "node", "size").join(roots, "node", "left").select("block", F.coalesce("root", "node").alias("root"), "node", "size")
    pairs = lambda rows: rows.repartition("block").sortWithinPartitions("block", "root").mapInArrow(lambda b: proposed(b, similarity, one_each), "a long, b long")
    at_few = rooted.join(big, "block", "left_anti")
    at_many = rooted.join(big, "block", "left_semi").join(nodes.select("node", "sketch"), "node").select("block", "root", "node", "size", "sketch")
    met_ = pairs(at_few).union(pairs(at_many))
    return met_.groupBy("a").agg(F.min("b").alias("b")) if one_each else met_.distinct()


def not_far(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of nodes (node, n, sketch) that their sketches leave possible."""
    s = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                longs = min(len(x), len(y)) // 8
                near.append(not far_apart(folded(x, longs)[None], folded(y, longs)[None], n, m, s)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch")), end)
    return pairs.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def verified_sets(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (hub, slice, member, node, shingles) sorted so that a hub's own row comes before its members. Emits the pairs (member, hub)
    of that Jaccard similarity. Memory holds one batch and the open hub's set."""
    s = Fraction(str(similarity))
    own = np.zeros(0, np.int64)
    for batch in batches:
        hubs, member, nodes = (batch.column(k).to_pylist() for k in (0, 2, 3))
        sets, a, b = batch.column(4), [], []
        for k, is_member in enumerate(member):
            here = np.asarray(sets[k].values)
            if not is_member:
                own = here
                continue
            at = np.searchsorted(own, here)
            common = int((own[np.minimum(at, len(own) - 1)] == here).sum()) if len(own) else 0
            if common * (s.numerator + s.denominator) >= (len(own) + len(here)) * s.numerator:
                a.append(nodes[k])
                b.append(hubs[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b of nodes (see shingle_sets()) whose texts (row_no, text) have shingle sets of at least that Jaccard similarity.

    Pairs come best through not_far(). Every b is a hub: its set and those of its partners are sent to one place, or to several if it has very many.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [np.sort(h.view(np.int64)) for h in sets_of_texts(batch.column(4).to_pylist(), words)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["hub", "slice", "member", "node", "shingles"])

    pairs = materialise(pairs, "pairs")
    total = pairs.count()
    big = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select("b", F.ceil(F.col("n") / BLOCK_ROWS).alias("slices"))  # fewer than HOT
    dealt = pairs.join(F.broadcast(big), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"))
    members = dealt.select(F.col("b").alias("hub"), "slice", F.lit(True).alias("member"), F.col("a").alias("node"))
    hubs = dealt.select(F.col("b").alias("hub"), "slice").distinct().select("hub", "slice", F.lit(False).alias("member"), F.col("hub").alias("node"))
    asked = materialise(members.union(hubs).join(nodes.select("node", F.col("first.row_no").alias("row_no")), "node").select("hub", "slice", "member", "node", "row_no"), "asked")
    # Spark sends `asked` to all tasks if its files are small, else both sides meet by row
    sets = asked.join(texts.select("row_no", "text"), "row_no").select("hub", "slice", "member", "node", "text").mapInArrow(sets_of, "hub long, slice int, member boolean, node long, shingles array<long>")
    return sets.repartition("hub", "slice").sortWithinPartitions("hub", "slice", "member").mapInArrow(lambda b: verified_sets(b, similarity), "a long, b long")


# ---------------------------------------------------------------- classes


#: Links of a node from which on its rows may be too many for one task's join.
HUB = 1000
#: Links (8 MB, a partition as Spark joins small ones up) that one task connects; more take rounds.
TOGETHER = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def link_figures(edges: DataFrame) -> Row:
    """n (twice the links, null if there are none), h (a sum of their hashes) and most (links of one node)."""
    each = both_ways(edges).groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    return each.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()


def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root, as components() has them, of all links (a, b) together."""
    found = [np.stack([np.asarray(c) for c in b.columns]) for b in batches]
    held = spanning_links(*np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of the links a > b but the roots.

    Up to TOGETHER links are connected by one task: rounds over so few would each cost the driver more plans, exchanges and jobs
    than they save. More links take alternating large-star and small-star steps; each round is a minimum by node (combined before the
    shuffle) and a join back, written to the shared folder. Hubs of very many links are joined without a shuffle.
    """
    seen = materialise(edges.select("a", "b"), "links")
    if seen.count() <= TOGETHER:
        roots = materialise(seen.coalesce(1).mapInArrow(connected, "node long, root long"), "roots")
        discard(seen)
        return roots
    mark = link_figures(seen)
    while mark.n:
        both = both_ways(seen)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        joined = join_counted(both, low, ["a"], "n", mark.n) if mark.most > HUB and mark.most * HOT > mark.n else both.join(low, "a")
        large = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        last, seen = seen, materialise(small, "links")
        discard(last)
        before, mark = mark, link_figures(seen)
        if before == mark:
            break
    return seen.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, parts: int = 4) -> DataFrame:
    """id, fp, component (smallest id reachable over links, null only if the component has none) for every row."""
    return classes(materialise(fingerprints(docs, id_col, text_col, words), "fingerprints"), distance, parts)


def classes(fps: DataFrame, distance: int = 4, parts: int = 4) -> DataFrame:
    """fps (written fingerprints, with columns id and fp) with root (the fingerprint that names the class) and component."""
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "classes")
    stars = components(links(nodes, distance, parts))
    rooted = materialise(nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = materialise(rooted.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("of_root")), "lowest")
    known = join_counted(rooted.select("fp", "n", "root"), lowest, ["root"], "of_root", nodes.count())
    return join_counted(fps, materialise(known, "known"), ["fp"], "n", fps.count())


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 4, parts: int = 4, from_files: bool = False) -> DataFrame:
    """One row of docs for each near-duplicate class: that with the smallest id (null last; of repeated rows one).

    Texts are linked exactly when their sets of word shingles have that Jaccard similarity (shingles count as equal by their
    64-bit hashes); a class is what links connect. Fingerprints within `distance` bits propose the first pairs, and for sets that
    these leave alone the set they share most rare shingles with; then all pairs at rare shingles that are not connected yet
    are tried. Every proposed pair is judged by its whole sets. from_files: see with_row_ids().
    """
    rows, row = with_row_ids(docs, "near", from_files)
    texts = rows.select(F.col(row).alias("row_no"), rows[id_col].cast("long").alias("id"), text_or_empty(rows, text_col).alias("text"))
    order = common_shingles(texts, words)
    nodes = materialise(shingle_sets(texts, words, similarity, order), "sets")
    signed = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "signed")
    by_bits = links(signed, distance, parts)
    for end in ("a", "b"):
        by_bits = by_bits.join(signed.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end).drop(end).withColumnRenamed(f"{end}_node", end)
    same_bits = nodes.select("fp", F.col("node").alias("a")).join(signed.withColumnRenamed("node", "b"), "fp").where("a <> b")
    by_bits = materialise(by_bits.select("a", "b").union(same_bits.select("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "by-bits")
    found = materialise(meetings(nodes, similarity, order), "meetings")
    together = found.where("first is not null").groupBy("node", "first").agg(F.count("*").alias("n"))
    partner = together.groupBy(F.col("node").alias("a")).agg(F.max_by("first", F.struct("n", "first")).alias("b"))
    pairs = by_bits.union(partner.join(by_bits.select("a"), "a", "left_anti").select("a", "b"))
    roots = components(alike(not_far(pairs, nodes, similarity), nodes, texts, words, similarity))
    star = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    # one pair for each set first: what that connects proposes no more pairs; rounds go on from the stars of earlier ones
    one_each = materialise(not_far(open_pairs(found, nodes, roots, similarity, one_each=True), nodes, similarity), "one-each")
    if not one_each.isEmpty():
        roots = components(star(roots).union(alike(one_each, nodes, texts, words, similarity)))
    rest = materialise(not_far(open_pairs(found, nodes, roots, similarity), nodes, similarity), "open")
    if not rest.isEmpty():
        roots = components(star(roots).union(alike(rest, nodes, texts, words, similarity)))
    kept = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    left = keep_rows(rows, row, kept.select(F.col("first.row_no").alias(row)))
    discard(nodes, signed, by_bits, found, one_each, rest)
    return left
