"""Phrase collocations by SON partitioning, one phrase length after the other.

The corpus is cut into shards, blocks of texts of one language, kept as word numbers. For each length
  1. every shard is mined completely at the support lowered in proportion to its part of the language's text: with support s and part p a phrase
     counts as locally frequent from t = ceil(s p) on. A phrase that reaches s overall reaches t in one shard at least;
  2. locally frequent phrases are united. A shard that does not report a phrase holds it t - 1 times at most, so candidates whose reports
     and silent shards together cannot reach s are left out, without any loss;
  3. the candidates are counted in all shards, exactly.
The next length is mined only where both parts one word shorter are frequent, which also loses nothing. With shards so many that t is 1 a report
is the exact count, and the pruning by shorter phrases keeps reports few; so memory is bounded by a shard and the work grows with the corpus.

What a task must know of the phrases before it is one bitmap of BITS bits, hashed from the phrases, whatever their number: it lets
others through, never holds one back, and phrases that pass are counted as themselves, so no result depends on it.

Defined results: a null text counts as empty, a null language as `und`; an empty table gives an empty result; repeated rows count as often as they
stand there; invalid numbers do not occur, since products are decimals of 38 digits; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import discard, give_back, join_counted, materialise
from marquee.operators.ranking import placed

#: What ends a piece, and what a space is; "." marks the end of a piece, since no word can hold it.
ENDS, LETTERS = b".,;:!?\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
READ = bytes.maketrans(ENDS + b"\t" + LETTERS, b"." * len(ENDS) + b" " + LETTERS.lower())
#: Shards that a language is cut into as long as each has at least and at most so many bytes of text; a task may add one smaller one.
SHARDS, LEAST, MOST = 32, 1 << 18, 32 << 20
#: Languages whose size is looked up; all others have less than this part of the text.
SIZED = 1000
#: Bytes of text that are split at once.
AT_ONCE = 2 << 20
#: Words of a shard whose phrases are looked up at once.
WINDOW = 1 << 19
#: Bits of the map of known phrases (8 MB).
BITS = 1 << 26
#: Parts in which the phrases of a shard are sorted, one after the other.
PARTS = 4
#: Multiplies the hash of a phrase before the next word's is added.
STEP = np.uint64(0x9E3779B97F4A7C15)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, octets, n_words, words (the shard's different words), hashes (of these, 64 bits) and ids (word numbers, packed; -1 ends a piece); written to the shared folder."""
    sized = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    per_language = sized.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"))
    largest = {r.lang: r.n for r in per_language.orderBy(F.desc("n")).limit(SIZED).collect()}
    other = min(largest.values()) if len(largest) == SIZED else 0
    limit = lambda lang: min(MOST, max(LEAST, -(-largest.get(lang, other) // SHARDS)))

    def cut(batches):
        growing: dict[str, Shard] = {}
        full: dict[str, Shard] = {}  # waits for what is left of its language, so that no shard is tiny
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                shard = growing.setdefault(lang, Shard(lang))
                shard.add(text.as_py())
                if shard.octets >= limit(lang):
                    if lang in full:
                        yield full.pop(lang).row()
                    full[lang] = growing.pop(lang)
                while sum(s.octets for held in (growing, full) for s in held.values()) >= 2 * MOST:
                    held = full or growing
                    yield held.pop(max(held, key=lambda k: held[k].octets)).row()
        while growing:
            lang, shard = growing.popitem()
            if lang in full and 2 * shard.octets < limit(lang):
                full[lang].take_in(shard)
            else:
                yield shard.row()
            del shard
        while full:
            yield full.popitem()[1].row()
        give_back()

    # a file a shard, so that a task reads few at once
    return materialise(sized.mapInArrow(cut, "lang string, octets long, n_words long, words array<binary>, hashes binary, ids binary"), "shards", rows_per_file=1)


class Shard:
    """Texts of one language as word numbers."""

    def __init__(self, lang: str):
        self.lang, self.octets, self.texts, self.waiting, self.parts = lang, 0, [], 0, []

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.octets += len(text)
        self.waiting += len(text)
        if self.waiting >= AT_ONCE:
            self.split()

    def split(self) -> None:
        import pyarrow as pa

        tokens = b".".join([*self.texts, b""]).translate(READ).replace(b".", b" . ").split(b" ")
        self.parts.append(pa.array([t for t in tokens if t], pa.binary()).dictionary_encode())
        self.texts, self.waiting = [], 0

    def take_in(self, other: Shard) -> None:
        self.split()
        other.split()
        self.parts += other.parts
        self.octets += other.octets

    def row(self):
        import pyarrow as pa
        import xxhash
        import zstandard

        self.split()
        coded, self.parts = pa.chunked_array(self.parts).unify_dictionaries(), []
        words = coded.chunk(0).dictionary
        ids = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks], dtype=np.int32)
        del coded
        plain = words.to_pylist()
        if b"." in plain:
            ids[ids == plain.index(b".")] = -1
        seed = xxhash.xxh32_intdigest(self.lang)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in plain), np.uint64, len(plain))
        values = {"lang": self.lang, "octets": self.octets, "n_words": int((ids >= 0).sum()), "words": plain, "hashes": hashes.tobytes(), "ids": zstandard.compress(ids.tobytes(), 1)}
        kinds = {"lang": pa.string(), "octets": pa.int64(), "n_words": pa.int64(), "words": pa.list_(pa.binary()), "hashes": pa.binary(), "ids": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([values[k]], kind) for k, kind in kinds.items()], names=list(kinds))


def known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in the map."""
    out = np.ones(len(hashes), bool)
    for place in (hashes & np.uint64(BITS - 1), (hashes >> np.uint64(26)) & np.uint64(BITS - 1)):
        out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bitmap(spark: SparkSession, phrases: DataFrame):
    """The map of the hashes `h` of phrases, at all executors; 1 million numbers at most come to the driver."""
    bits = phrases.select(F.explode(F.array(F.col("h").bitwiseAND(BITS - 1), F.shiftrightunsigned("h", 26).bitwiseAND(BITS - 1))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("w")).toArrow()
    whole = np.zeros(BITS // 64, np.int64)
    whole[words.column("at").to_numpy()] = words.column("w").to_numpy()
    return spark.sparkContext.broadcast(whole.view(np.uint8))


def phrase_hashes(ids: np.ndarray, word_hash: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    hashes = word_hash[ids[at]]
    for k in range(1, length):
        hashes = hashes * STEP + word_hash[ids[at + k]]
    return hashes


def starts_of(ids: np.ndarray, word_hash: np.ndarray, length: int, shorter: np.ndarray | None, wanted: np.ndarray | None) -> np.ndarray:
    """Where phrases of `length` words start whose parts one word shorter are in the map `shorter`, and which are in `wanted`, where these are given."""
    found = []
    for start in range(0, max(0, len(ids) - length + 1), WINDOW):
        part = ids[start : start + WINDOW + length - 1]
        inside = part >= 0
        n = len(part) - length + 1
        good = inside[:n].copy()
        for k in range(1, length):
            good &= inside[k : k + n]
        if length > 1:
            # parts that start at the first or the second word of a phrase
            able = np.zeros(n + 1, bool)
            able[:-1] |= good
            able[1:] |= good
            at = np.flatnonzero(able)
            able[at] = known(shorter, phrase_hashes(part, word_hash, at, length - 1))
            good &= able[:-1] & able[1:]
        at = np.flatnonzero(good)
        if wanted is not None:
            at = at[known(wanted, phrase_hashes(part, word_hash, at, length))]
        found.append((at + start).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def counted(ids: np.ndarray, at: np.ndarray, length: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the number of each different phrase that starts at one of `at`; phrases are told apart by their words."""
    if length == 1:
        first = np.zeros(n_words, np.int64)
        first[ids[at[::-1]]] = np.arange(len(at) - 1, -1, -1)
        n = np.bincount(ids[at], minlength=n_words)
        return first[n > 0], n[n > 0]
    found = []
    start = ids[at] % PARTS  # equal phrases start with the same word, so they fall in one part
    for part in range(PARTS):
        own = np.flatnonzero(start == part)
        here = at[own]
        key, size = ids[here].astype(np.int64), max(1, n_words)
        for k in range(1, length):
            if size * n_words >= 1 << 62:
                different, key = np.unique(key, return_inverse=True)
                size = max(1, len(different))
            key *= n_words
            key += ids[here + k]
            size *= n_words
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        found.append((own[first], n))
    return np.concatenate([f for f, _ in found]), np.concatenate([n for _, n in found])


PHRASES = "lang string, phrase binary, h long, n long, excess long"


def counts(parts: DataFrame, length: int, support: int, shorter, candidates) -> DataFrame:
    """Without candidates: the locally frequent phrases of every shard, n, and excess = n - (t - 1); and a row without a phrase whose excess is t - 1.
    With candidates: how often each shard has them. Both arguments are maps of bitmap(), or None."""

    def mine(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                words = row.column("words").flatten()
                word_hash, ids = np.frombuffer(row.column("hashes")[0].as_buffer(), np.uint64), np.frombuffer(zstandard.decompress(row.column("ids")[0].as_buffer()), np.int32)
                least = -(-support * row.column("octets")[0].as_py() // max(1, row.column("total")[0].as_py()))
                at = starts_of(ids, word_hash, length, *(None if m is None else m.value for m in (shorter, candidates)))
                first, n = counted(ids, at, length, len(words))
                if candidates is None:
                    first, n = first[n >= least], n[n >= least]
                at = at[first]
                del first
                hashes = phrase_hashes(ids, word_hash, at, length).view(np.int64)
                texts = [words.take(pa.array(ids[at + k])) for k in range(length)]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())) if length > 1 else texts[0]
                slack, own = max(0, least - 1), 1 if candidates is None else 0
                columns = [phrase, pa.array(hashes), pa.array(n.astype(np.int64)), pa.array((n - slack).astype(np.int64))]
                if own:
                    columns = [pa.concat_arrays([c, pa.array([v], c.type)]) for c, v in zip(columns, (None, None, None, slack))]
                columns.insert(0, pa.repeat(row.column("lang")[0], len(at) + own))
                del words, word_hash, ids, at, n, hashes, texts, phrase  # nothing of a shard stays while the next one is read
                give_back()
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "h", "n", "excess"])
                del columns

    return parts.select("lang", "octets", "total", "words", "hashes", "ids").mapInArrow(mine, PHRASES)


def frequent(docs: DataFrame, support: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k (its words) and n for all phrases of 1 to `longest` words that stand `support` times or more in a language; and lang, n_words."""
    spark = docs.sparkSession
    cut = shards(docs, text_col, lang_col)
    languages = materialise(cut.groupBy("lang").agg(F.sum("octets").alias("total"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_shards")), "languages")
    parts = join_counted(cut, languages.drop("n_words"), ["lang"], "n_shards", cut.count())
    found, shorter = [], None
    for length in range(1, longest + 1):
        local = materialise(counts(parts, length, support, shorter, None), "local")
        silent = local.where("phrase is null").groupBy("lang").agg(F.sum("excess").alias("slack"))
        united = local.where("phrase is not null").groupBy("lang", "phrase").agg(F.first("h").alias("h"), F.sum("excess").alias("reported"))
        able = bitmap(spark, with_facts(united, silent).where(F.col("reported") + F.col("slack") >= support))
        exact = counts(parts, length, support, shorter, able).groupBy("lang", "phrase").agg(F.first("h").alias("h"), F.sum("n").alias("n")).where(F.col("n") >= support)
        found.append(materialise(exact.select("lang", F.col("phrase").cast("string").alias("phrase"), "h", F.lit(length).alias("k"), "n"), "frequent"))
        able.unpersist()
        discard(local)
        if shorter is not None:
            shorter.unpersist()
        shorter = bitmap(spark, found[-1])
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole.drop("h"), languages.select("lang", "n_words")


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their language, of which there is one row; a small table, which Spark sends to all tasks by its size."""
    return rows.join(materialise(facts, "facts"), "lang")


def scored(phrases: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of phrases of two words or more: the lowest score of all cuts, the first of equal ones."""
    words = F.split("phrase", " ")
    cut = F.col("cut")
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), cut), " ").alias("_left"), F.array_join(F.slice(words, cut + 1, F.col("k") - cut), " ").alias("_right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = with_facts(cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"]), languages.withColumnRenamed("n_words", "n"))
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(13,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_m"))
    return lowest.select("lang", "phrase", "k", "a", "_m.l", "_m.r", "n", "_m.score")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, keep: float = 1.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best `top` phrases of each language.

    A phrase goes if one that holds it, longer by any number of words, has `keep` of its occurrences or more. A phrase between the two has as many
    at least, so one word more is all that has to be looked at.
    """
    found, languages = frequent(docs, support, longest, text_col, lang_col)
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase")
    held = found.where("k > 2").select("lang", inner, "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    open_ = scored(found, languages).join(held, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * F.lit(round(keep * 100)))).drop("_longer", "k")
    ranked = placed(open_, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], name="rank").where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
