"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its special cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from marquee.llm import bpe, chat, counting, exactdedup, mixing, pieces, quality, queries, simhash, tokenfile, vptree, warc
from marquee.llm.common import materialise, table

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def slow_components(pairs, distance):
    """pairs: (id, fingerprint). Union-find over all pairs of fingerprints."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return {(i, f): low.get(find(f)) for i, f in pairs}


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 5 + 1))}


def slow_classes(text):
    """The smallest id of each class of texts (by id) that pairs of the wanted similarity connect."""
    parts = {i: shingles(t) for i, t in text.items()}
    root = {i: i for i in text}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(text), 2):
        if len(parts[a] & parts[b]) * 5 >= 4 * len(parts[a] | parts[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in text}


def test_simhash_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    want = slow_components([(i, slow_fingerprint(t, 4)) for i, t in texts_of(docs)], 4)
    got = queries.op1_simhash(spark, sf).collect()
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == want


def test_simhash_special_cases(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    pairs = [(i, slow_fingerprint(t, 4)) for i, t in texts_of(odd_docs)]
    assert Counter((r.id, r.fp % (1 << 64), r.component) for r in got) == Counter((i, f, slow_components(pairs, 4)[i, f]) for i, f in pairs)
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.deduplicated(odd_docs).columns == odd_docs.columns
    assert simhash.deduplicated(odd_docs).count() == len(slow_classes(dict(enumerate(t for _, t in texts_of(odd_docs)))))
    assert simhash.deduplicated(no_docs).count() == 0


def test_simhash_dense_clusters(spark):
    """A ball of fingerprints with many links, chains and far ones; small blocks force splitting."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))]
    chain = [int(rng.integers(1 << 62))]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)))
    fps += chain + [int(x) for x in rng.integers(1 << 62, size=300)]
    pairs = [(n, f) for n, f in enumerate(fps)]
    was, simhash.BLOCK_ROWS = simhash.BLOCK_ROWS, 50
    try:
        got = simhash.classes(spark.createDataFrame([(n, f) for n, f in pairs], "id long, fp long")).collect()
    finally:
        simhash.BLOCK_ROWS = was
    assert {(r.id, r.fp): r.component for r in got} == slow_components(pairs, 4)


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """Chains, a star and no links at all: by one task in a handful of jobs, and by rounds, with the same roots."""
    rng = np.random.default_rng(7)
    names = [int(x) for x in rng.permutation(np.arange(-2000, 2000))]
    ends = [(names[k], names[k + 1]) for k in range(600)] + [(names[700], names[k]) for k in range(701, 1500)] + [(names[k], names[k + 3]) for k in range(1600, 1800)]
    root = {x: x for e in ends for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ends:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    links = spark.createDataFrame([(max(e), min(e)) for e in ends], "a long, b long").repartition(4)
    found = {}
    try:
        for most in (simhash.TOGETHER, len(ends) - 1):
            monkeypatch.setattr(simhash, "TOGETHER", most)
            spark.sparkContext.setJobGroup(f"components-{most}", "")
            got = simhash.components(links)
            found[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}"))
            assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)
            assert simhash.components(links.where("a is null")).count() == 0
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert min(found.values()) <= 8 < max(found.values())


# ---------------------------------------------------------------- 2


def test_tokenfile_round_trip(spark, sf, odd_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    source = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    library = Tokenizer.from_str(source)
    marked = spark.createDataFrame([(k, t) for k, t in enumerate(["<|endoftext|>", "a <|endoftext|>  b", "x<|endoftext|><|endoftext|>y\n", "<|endoftext", " <|endoftext|> ", "\x1c \x85 a\xa0 b"])], "doc_id long, text string")
    for n, docs in enumerate((table(spark, sf, "documents"), odd_docs, no_docs, marked)):
        tokenfile.write_tokens(docs, str(tmp_path / str(n)), source, 2)
        got = sorted(((r.id is not None, r.id or 0, r.start, r.n_tokens, r.digest) for r in tokenfile.read_tokens(spark, str(tmp_path / str(n))).collect()))
        want, start = [], 0
        for i, t in sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
            ids = library.encode(t, add_special_tokens=False).ids + [2]
            want.append((i is not None, i or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want


def test_direct_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 24, 900), rng.integers(0, 50257, 3000)]).astype(np.uint32)
    ids, ends, levels = tokenfile.read_segment(tokenfile.write_segment([5, None], ids, np.array([10, len(ids)])))[0], None, tokenfile.read_segment(tokenfile.write_segment([5, None], ids, np.array([10, len(ids)])))
    assert ids == [5, None]
    whole = tokenfile.unpack(levels[2])
    assert len(levels[2]) == 3
    for i in [0, 1, 511, 512, 513, 1023, 1024, *rng.integers(0, len(whole), 200).tolist()]:
        assert tokenfile.token_at(levels[2], i) == whole[i]


# ---------------------------------------------------------------- 3


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example/x", "<html><head><title>t</title></head><body><p>One &amp; two</p><script>no()</script><p>three<br>four</p></body></html>", 0), (2, None, None, 0), (2, None, None, 0)], "page_id long, url string, html string, block int"
    )
    made = warc.responses(pages)
    assert made.count() == 3
    source = {r.source_id: r.record for r in made.collect()}
    got = warc.derivatives(made).collect()
    assert Counter((r.source_id, r.record_type) for r in got) == {(1, "metadata"): 1, (1, "conversion"): 1, (2, "metadata"): 2, (2, "conversion"): 2}
    for r in got:
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        block = rest[:-4]
        assert rest.endswith("\r\n\r\n") and int(fields["Content-Length"]) == len(block.encode())
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert f"WARC-Record-ID: {fields['WARC-Refers-To']}" in source[r.source_id]
        assert f"WARC-Payload-Digest: {fields['X-Source-Payload-Digest']}" in source[r.source_id]
    one = {r.record_type: r for r in got if r.source_id == 1}
    assert one["conversion"].block == "One & two\nthree\nfour"
    assert "http-content-type: text/html; charset=utf-8\r\n" in one["metadata"].block
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_keeps_every_header(spark):
    """Records of other origin: repeated and folded headers, other WARC headers, no payload digest, plain text, entities, a length that ends the block."""
    http = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/plain\r\nSet-Cookie: b=2\r\nVia: x,\r\n  y\r\n\r\n"
    body = "plain é text\r\n\r\nend"
    page = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>&eacute;&#233;&#xE9; &amp;#65; &#0; &lt;</p>"
    head = lambda block, more="": f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-IP-Address: 1.2.3.4\r\n{more}\r\n{block}"
    size = len((http + body).encode())
    records = [(1, head(http + body + "junk\r\n\r\n", f"Content-Length: {size}\r\n")), (2, head(page, "Content-Length: no\r\n")), (3, "WARC/1.0\r\nWARC-Type: request\r\n\r\nx"), (4, head("")), (5, ""), (6, None)]
    got = {(r.source_id, r.record_type): r for r in warc.derivatives(spark.createDataFrame(records, "source_id long, record string")).collect()}
    assert sorted(got) == [(i, t) for i in (1, 2, 4) for t in ("conversion", "metadata")]
    lines = got[1, "metadata"].block.split("\r\n")
    assert lines == ["http-status: HTTP/1.1 200 OK", "http-set-cookie: a=1", "http-content-type: text/plain", "http-set-cookie: b=2", "http-via: x, y", "source-warc-ip-address: 1.2.3.4", ""]
    assert got[1, "conversion"].block == body and got[1, "conversion"].source_payload_digest == "sha256:" + hashlib.sha256(body.encode()).hexdigest()
    assert got[2, "conversion"].block == "ééé &#65; &#0; <"
    assert got[4, "conversion"].block == "" and got[4, "metadata"].refers_to == "<urn:x>"


# ---------------------------------------------------------------- statements


@pytest.mark.parametrize(
    "html,text",
    [("&#38;lt;b&#38;gt;", "&lt;b&gt;"), ("&#38;amp;", "&amp;"), ("&amp;#65;", "&#65;"), ("&amp;lt;", "&lt;"), ("a&b;c&&lt;&unknown;&#x1F600;&#55296;&#0;", "a&b;c&<&unknown;😀&#55296;&#0;"), ("x & y; &copy;&#xe9;&", "x & y; ©é&"), ("&" + "l" * 5000 + ";", "&" + "l" * 5000 + ";"), ("", ""), ("&#99999999;&euro;", "&#99999999;€")],
)
def test_warc_entities_once(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(warc.unescaped(F.col("h"))).first()[0] == text


def test_warc_odd_lengths_and_lines(spark):
    """A Content-Length below 0 is not obeyed; a record with bare line feeds has no type, so no derivatives."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbody"
    record = lambda n: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {n}\r\n\r\n{http}\r\n\r\n"
    rows = [(n, record(n)) for n in (-5, len(http), 10**12)] + [(0, record(len(http)).replace("\r\n", "\n"))]
    got = warc.derivatives(spark.createDataFrame(rows, "source_id long, record string")).where("record_type = 'conversion'").collect()
    assert sorted((r.source_id, r.block) for r in got) == [(-5, "body"), (len(http), "body"), (10**12, "body")]


def test_warc_cut_inside_a_character(spark):
    """A block that ends inside a character loses that character's start, and nothing else."""
    http, body = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n", "aé🙂z"
    record = lambda n: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(http) + n}\r\n\r\n{http}{body}\r\n\r\n"
    got = warc.derivatives(spark.createDataFrame([(n, record(n)) for n in range(9)], "source_id long, record string")).where("record_type = 'conversion'").collect()
    assert {r.source_id: r.block for r in got} == {n: body.encode()[:n].decode(errors="ignore") for n in range(9)}


def test_warc_text_is_made_once(spark, sf):
    """What takes the tags out of a page stands once in the plan, since Spark computes it wherever it stands; line separators do not hide blanks before them."""
    plan = queries.op3_warc(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(warc.TAGS) == 1
    rows = [("<p>a \t b</p>\n \n<p>\x0b</p> c \u2028", "a b\nc \u2028"), ("x\t", "x"), ("a\tb  c d", "a b c d"), (" \n", ""), ("", "")]
    got = spark.createDataFrame(rows, "html string, want string").select(warc.plain_text(F.col("html")), "want").collect()
    assert all(r[0] == r[1] for r in got)


@pytest.mark.parametrize("name", ["op3_warc", "op4_exactdedup", "op5_mixing", "op10_chat"])
def test_query_equals_its_statement(spark, sf, name):
    import duckdb

    from marquee.llm.oracle import ORACLE

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(found.columns)} from ({ORACLE[name]})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_nearest_statement(spark, sf):
    """The SQL of op8 with a tolerance for scores."""
    import duckdb

    from marquee.llm.oracle import OP8

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = {(q, r): (v, s) for q, r, v, s in con.execute(OP8).fetchall()}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op8_vptree(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_tokenfile_query(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, t in sorted(texts_of(table(spark, sf, "documents"))):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_tokenfile(spark, sf).collect()} == want


# ---------------------------------------------------------------- 4


def slow_keepers(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((i, t))
    return {k: (min(v, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0], len(v)) for k, v in groups.items()}


def test_exact_dedup_special_cases(odd_docs, no_docs):
    texts = texts_of(odd_docs)
    want = slow_keepers(texts)
    for fan_in in (2, 8):
        got = exactdedup.assignments(exactdedup.digests(odd_docs), fan_in).collect()
        assert len(got) == len(texts)
        keys = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        assert all(keys[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
        assert sum(r.kept for r in got) == len(want) and all(r.id == r.keep_id for r in got if r.kept)
    kept = exactdedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(want)
    assert exactdedup.exact_dedup(no_docs).count() == 0 and exactdedup.deduplicated(no_docs).count() == 0


def test_rows_exploded_from_files_stay_apart(spark, odd_docs, tmp_path):
    """Rows made from one row of a file share its place; each copy but one goes all the same."""
    odd_docs.write.parquet(str(tmp_path / "d"))
    exploded = spark.read.parquet(str(tmp_path / "d")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("n")
    assert exactdedup.deduplicated(exploded).count() == exactdedup.deduplicated(odd_docs).count()
    assert simhash.deduplicated(exploded).count() == simhash.deduplicated(odd_docs).count()
    assert exactdedup.deduplicated(spark.read.parquet(str(tmp_path / "d")), from_files=True).count() == exactdedup.deduplicated(odd_docs).count()


# ---------------------------------------------------------------- 5


def test_mixing_targets(spark, odd_docs, no_docs):
    got = mixing.mixed(odd_docs).collect()
    assert len(got) == odd_docs.count()
    total = sum(r.size for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        per[r.source][2] += r.taken
        per[r.source][3] = max(per[r.source][3], r.size)
        assert r.taken <= 3 * r.size and len(r.positions) * r.size == r.taken and all(0 <= p <= 1 for p in r.positions)
    # water filling by repeated sharing
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s][0]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * per[s][0]
            left -= target[s]
        free -= over
        if not free:
            break
    for s, (size, t, taken, largest) in per.items():
        assert math.isclose(t, target[s], rel_tol=1e-12, abs_tol=1e-9) and abs(taken - t) <= largest
    assert mixing.mixed(no_docs).count() == 0
    out = mixing.taken_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(len(r.positions) for r in got)


def test_mixing_is_balanced_and_repeats(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    a, b = (mixing.mixed(d).collect() for d in (docs, docs.repartition(7)))
    assert Counter((r.id, r.taken, tuple(r.positions)) for r in a) == Counter((r.id, r.taken, tuple(r.positions)) for r in b)
    order = [r.position for r in mixing.curriculum(mixing.mixed(docs)).collect()]
    assert order == sorted(order)
    # the schedule of the second source falls from 1.5 to 0.5: its first half of training holds 5/8 of its words
    names = sorted({r.source for r in a})
    second = [(p, r.size) for r in a if r.source == names[1] for p in r.positions]
    assert abs(sum(s for p, s in second if p < 0.5) / sum(s for _, s in second) - 0.625) < 0.1


# ---------------------------------------------------------------- 6


def test_bpe_matches_the_library(spark, sf, odd_docs, no_docs):
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for docs in (table(spark, sf, "documents"), odd_docs):
        coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
        got = Counter((r.id, tuple(r.ids), bytes(r.back)) for r in coded.select("id", "ids", bpe.decoded(F.col("ids"), RANKS).alias("back")).collect())
        assert got == Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in texts_of(docs))
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_many_blocks(spark, sf):
    """Blocks that end inside an Arrow batch."""
    ranks, docs = RANKS, table(spark, sf, "documents")
    want = Counter((r.id, tuple(r.ids)) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect())
    source = docs.select(F.col("doc_id").alias("id"), F.lit("r").alias("row_no"), "text").coalesce(1)

    def blocks(batches):
        bpe.BLOCK_BYTES = 20_000
        parts = (b.slice(at, 5) for b in batches for at in range(0, b.num_rows, 5))
        yield from bpe._blocks(parts, public_tokenizers.PATTERN, ranks)

    coded = source.mapInArrow(blocks, bpe.ROWS).select("kind", bpe.encoded_words(F.col("words"), ranks).alias("ids"), "flat", "id", "row_no")
    assert Counter((r.id, tuple(r.ids)) for r in coded.mapInArrow(bpe._joined, "id long, row_no string, ids array<int>").where("row_no = 'r'").collect()) == want


def test_bpe_folds_a_word_once_in_a_task(spark, sf):
    """A task's later blocks send only new words; where it keeps few words or characters, the ids are the same."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pandas().fillna({"text": ""})
    docs = spark.createDataFrame([(int(i), "r", t) for i, t in zip(texts.doc_id, texts.text)], "id long, row_no string, text string").coalesce(1)
    want = Counter((r.id, tuple(r.ids)) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, id_col="id").collect())
    ranks = RANKS

    def blocks(words, characters):
        def run(batches):
            bpe.BLOCK_BYTES, bpe.KEPT_WORDS, bpe.KEPT_CHARACTERS = 20_000, words, characters
            yield from bpe._blocks((b.slice(at, 5) for b in batches for at in range(0, b.num_rows, 5)), public_tokenizers.PATTERN, ranks)

        return docs.mapInArrow(run, bpe.ROWS)

    sent = [bytes(w[1:-1]) for r in blocks(400_000, 6_000_000).where("kind = 0").collect() for w in r.words]
    assert len(sent) > 1000 and len(sent) == len(set(sent))
    for words, characters in ((400_000, 6_000_000), (50, 6_000_000), (400_000, 300), (0, 0)):
        coded = blocks(words, characters).select("kind", bpe.encoded_words(F.col("words"), ranks).alias("ids"), "flat", "id", "row_no")
        assert Counter((r.id, tuple(r.ids)) for r in coded.mapInArrow(bpe._joined, "id long, row_no string, ids array<int>").collect()) == want


def test_pieces_encode_alone_as_in_their_text():
    """Texts of all kinds of white space, control characters and letters; other patterns get whole texts."""
    import random

    import pyarrow as pa
    import regex
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=pieces.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u2009", "\u1680", "\u2028", "\u202f", "\u205f", "\u180e", "\u200b", "a", "é", "à", "日本", "'s", "12", "!", "?!", "\0", "xxx", "🙂", "٣"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(0, 30))) for _ in range(5000)]
    found = pieces.cut(pa.array(texts))
    words, numbers, counts = pieces.words_of(found.pieces, regex.compile(pieces.PATTERN).findall)
    ids = tokenfile.lists_of([library.encode_ordinary(w) for w in words]).joined(numbers, counts).joined(found.numbers, found.counts)
    assert [ids.values[a:b].tolist() for a, b in zip(ids.offsets, ids.offsets[1:])] == [library.encode_ordinary(t) for t in texts]
    assert pieces.cut(pa.array(texts[:50]), whole=True).counts.tolist() == [bool(t) for t in texts[:50]]


def test_bpe_other_pattern(spark, odd_docs):
    """A pattern that joins words over a space."""
    import tiktoken

    pattern = r"(?s)[^y]+|y"
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    docs = odd_docs.where("length(text) < 1000 or text is null")
    got = Counter((r.id, tuple(r.ids)) for r in bpe.encode(docs, RANKS, pattern).collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t))) for i, t in texts_of(docs))
    with pytest.raises(ValueError):
        bpe.encode(docs, {b"a": 1 << 17}, pattern)


def test_bpe_query(spark, sf):
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = {}
    for i, t in texts_of(table(spark, sf, "documents")):
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, sf).collect()} == want


def test_bpe_fold_alone(spark):
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=r"(?s).+", mergeable_ranks=RANKS, special_tokens={})
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n)).decode() for n in range(1, 200)] + ["a" * n for n in range(1, 250, 7)] + ["é" * 60, "🙂" * 40]
    words = [w for w in words if w.encode() not in RANKS]
    df = spark.createDataFrame([([[bpe.EDGE, *w.encode(), bpe.EDGE] for w in words],)], "w array<array<int>>")
    got = df.select(bpe.encoded_words(F.col("w"), RANKS).alias("ids")).first().ids
    assert got == [library.encode_ordinary(w) for w in words]


# ---------------------------------------------------------------- 7


def test_recount_equals_full_count(spark, sf, odd_docs, no_docs):
    """Two rounds of edits over kept trees."""
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(11)
    inserts = ["", " ", "\n", "  ", "x", " word", "\n\n\t", "é!! 12", "long insertion of several words. \n And more", "'s", "\u3000", " a b c d" * 40]
    texts = texts_of(table(spark, sf, "documents").limit(120)) + texts_of(odd_docs)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(3)
    trees, now = counting.count(docs, ranks, public_tokenizers.PATTERN), {k: t for k, (_, t) in enumerate(texts)}
    for _ in range(2):
        data, before = [], dict(now)
        for k, t in now.items():
            edits = [(int(rng.integers(0, len(t) + 5)), int(rng.integers(0, 60)) * int(rng.integers(0, 2)), inserts[int(rng.integers(len(inserts)))]) for _ in range(int(rng.integers(0, 12)))]
            data.append((k, [*edits, None, (None, None, None)] if rng.integers(2) else edits or None))
            for at, removed, inserted in edits:
                at = min(at, len(t))
                t = t[:at] + inserted + t[at + removed :]
            now[k] = t
        trees = materialise(counting.recount(trees.join(spark.createDataFrame(data, f"id long, edits {counting.EDITS}"), "id"), ranks, public_tokenizers.PATTERN), "trees")
        got = {r.id: r for r in trees.collect()}
        count = lambda t: len(library.encode_ordinary(t))
        assert {k: (r.tokens_before, r.n_tokens, r.text) for k, r in got.items()} == {k: (count(before[k]), count(t), t) for k, t in now.items()}
        assert all(sum(r.leaf_tokens) == r.n_tokens and sum(r.leaf_chars) == len(r.text) for r in got.values())
    assert counting.count(no_docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_counting_query(spark, sf):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts_of(table(spark, sf, "documents")):
        before, n = len(library.encode_ordinary(t)), len(t)
        for at, removed, inserted in ((n // 2, 0, " revised\n 2024"), (n // 3, 7, ""), (n - 1, 3, " end. ")):
            at = min(max(at, 0), len(t))
            t = t[:at] + inserted + t[at + removed :]
        want[i] = (before, len(library.encode_ordinary(t)), len(t))
    assert {r.doc_id: (r.tokens_before, r.tokens_after, r.chars_after) for r in queries.op7_counting(spark, sf).collect()} == want


def test_counts_with_waiting_edits(spark):
    """Edits that come with the table are kept beside the trees; recount() follows them and says how much it encoded."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = "several plain words here. " * 400
    edits = "array<struct<at:int,removed:int,inserted:string>>"
    docs = spark.createDataFrame([(1, text, [(100, 5, "new")]), (2, text, None), (3, None, [(0, 0, "a b")])], f"doc_id long, text string, e {edits}")
    trees = counting.count(docs, ranks, public_tokenizers.PATTERN, edits_col="e")
    got = {r.id: r for r in counting.recount(trees, ranks, public_tokenizers.PATTERN).collect()}
    want = {1: text[:100] + "new" + text[105:], 2: text, 3: "a b"}
    plain = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    whole = {r.id: r for r in counting.count(plain, ranks, public_tokenizers.PATTERN).collect()}
    assert {i: (r.text, r.n_tokens, sum(r.leaf_tokens), sum(r.leaf_chars)) for i, r in got.items()} == {i: (t, whole[i].n_tokens, whole[i].n_tokens, len(t)) for i, t in want.items()}
    assert 0 < got[1].encoded_chars < 600 and got[2].encoded_chars == 0 and got[3].encoded_chars >= 3
    assert got[2].leaf_chars == whole[2].leaf_chars and len(got[2].leaf_chars) == len(got[2].leaf_tokens) > 20


def test_recount_is_local(spark):
    """One edit of a long text, and 200 insertions at one place: leaves that grow are dealt anew."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "some plain words here " * 20_000)], "doc_id long, text string")
    trees = counting.count(docs, ranks, public_tokenizers.PATTERN)
    one = F.lit("[{\"at\":200000,\"removed\":3,\"inserted\":\"new\"}]")
    r = counting.recount(trees.withColumn("edits", F.from_json(one, counting.EDITS)), ranks, public_tokenizers.PATTERN).first()
    assert 0 < r.encoded_chars < 2_000 < len(r.text)
    many = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.struct((k * 15 + 7).alias("at"), F.lit(0).alias("removed"), F.lit(" inserted words").alias("inserted")))
    r = counting.recount(trees.withColumn("edits", many), ranks, public_tokenizers.PATTERN).first()
    assert r.encoded_chars < 200 * 1_000 and r.n_tokens == sum(r.leaf_tokens)


# ---------------------------------------------------------------- 8


def slow_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 50:
            continue
        scores = sorted((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q)
        out[q] = scores[:k]
    return out


def test_nearest_is_exact(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, sf, "embeddings").collect()]
    want = slow_nearest(rows, 5)
    got = defaultdict(list)
    for r in queries.op8_vptree(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(s + w) < 1e-12 for q in want for (_, s), (w, _) in zip(got[q], want[q]))


def test_nearest_recall_falls_with_relax(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.id) for r in vptree.nearest(vectors, asked, shard_rows=200).collect()}
    assert exact == {(r.query_id, r.id) for r in vptree.nearest(vectors, asked).collect()}
    some = {(r.query_id, r.id) for r in vptree.nearest(vectors, asked, relax=0.8).collect()}
    assert 0.75 < len(exact & some) / len(exact) <= 1  # these vectors have no clusters


def test_nearest_special_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (50, [-1.0, 0.0])]
    data += [(i, [3.0, 4.0]) for i in range(100, 400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = vptree.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=100).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.id, round(r.score, 12)))
    assert by[0] == [(1, 1.0), (2, 1.0), (100, 0.6), (101, 0.6), (102, 0.6)]
    assert by[100] == [(101, 1.0), (102, 1.0), (103, 1.0), (104, 1.0), (105, 1.0)]
    odd = spark.createDataFrame([(0, [1.0] * 3), (1, [1.0, 2.0, 1.0]), (2, [1.0] * 5), (50, [2.0] * 5), (100, [1e200, 0.0, 1e200]), (3, [3e-200, 0.0, 3e-200]), (150, [1.0] * 9), (0, [5.0, 0.0, 0.0]), (1, [9.0, 9.0, 9.0])], "vec_id long, embedding array<double>")
    got_odd = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in vptree.nearest(odd, odd.where("vec_id % 50 = 0"), 2).collect()}
    assert got_odd == {(0, 1): (1, round(4 / math.sqrt(18), 9)), (0, 2): (3, round(math.sqrt(2 / 3), 9)), (50, 1): (2, 1.0), (100, 1): (3, 1.0), (100, 2): (0, round(math.sqrt(2 / 3), 9))}
    assert by[50][0] == (9, 0.0) and by[50][1] == (100, -0.6)
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op9_quality(spark, sf)
    assert found.count() == table(spark, sf, "documents").count()
    for r in found.select("doc_id", "held_out").limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = found.join(table(spark, sf, "labels"), "doc_id").where("held_out").select("quality", "predicted").collect()
    for label in (0, 1):
        own = [r.predicted == r.quality for r in held if r.quality == label]
        assert own and sum(own) / len(own) >= 0.95


def test_quality_special_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (77, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(odd_docs, lab)
        got = quality.with_scores(odd_docs.drop("score"), model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert quality.with_scores(no_docs.drop("score"), model).count() == 0
    empty = quality.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality.with_scores(odd_docs.drop("score"), empty).collect()} == {0.5}


def test_factorisation_machine_identity():
    rng = np.random.default_rng(2)
    model = quality.Model(0.3, rng.normal(size=quality.SLOTS).astype(np.float32), rng.normal(size=(quality.SLOTS, quality.FACTORS)).astype(np.float32))
    slots, values = rng.choice(quality.SLOTS, 12, replace=False), rng.normal(size=12).astype(np.float32)
    slow = 0.3 + sum(model.linear[s] * x for s, x in zip(slots, values)) + sum(model.factors[slots[i]] @ model.factors[slots[j]] * values[i] * values[j] for i in range(12) for j in range(i))
    assert abs(model.margins(slots, values, np.array([0]))[0] - slow) < 1e-3


# ---------------------------------------------------------------- 10


def test_chat_layouts_give_the_same_turns(spark):
    import json

    turns = [("user", "Hi <|im_end|>\n \\[INST] <s>"), ("assistant", "a \\ b\\")]
    records = {
        "prompt": {"prompt": turns[0][1], "completion": turns[1][1]},
        "response": {"response": turns[1][1], "prompt": turns[0][1]},
        "instruction_output": {"instruction": turns[0][1], "output": turns[1][1]},
        "instruction_input": {"instruction": turns[0][1], "input": None, "output": turns[1][1]},
        "messages": {"messages": [{"role": r, "content": t} for r, t in turns]},
        "conversations": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]},
        "turns": {"turns": [{"role": r, "text": t} for r, t in turns]},
        "unknown": {"question": "x", "nested": {"a": [1]}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [("broken", "{no"), ("null", None)], "name string, record string")
    made = chat.formatted(chat.canonical(df, roles=chat.ROLES))
    got = {r.name: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for name in records:
        assert got[name].layout == name
        assert [tuple(t) for t in got[name].turns] == ([] if name == "unknown" else turns)
        assert [tuple(t) for t in got[name].back] == [tuple(t) for t in got[name].turns]
        assert got[name].loss == ("" if name == "unknown" else turns[1][1])
        assert got[name].formatted.count("<|im_end|>") == len(got[name].turns) and "[INST]" not in got[name].formatted
    assert got["broken"].layout == got["null"].layout == "unknown"


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"x":1}] and prose', '{"a": {"b": [1]}}', "[1, 2]", "{no", "null"])
def test_chat_texts_that_look_like_json(spark, text):
    import json

    records = {
        "prompt": {"prompt": text, "completion": text},
        "response": {"response": text, "prompt": text},
        "instruction": {"system": text, "instruction": text, "output": text},
        "instruction_input": {"instruction": text, "input": text, "output": text},
        "instruction_output": {"instruction": text, "output": text},
        "messages": {"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": text}]},
        "conversations": {"conversations": [{"from": "human", "value": text}, {"from": "gpt", "value": text}]},
        "turns": {"turns": [{"role": "user", "text": text}, {"role": "assistant", "text": text}]},
    }
    assert set(records) == {layout.name for layout in chat.LAYOUTS}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "name string, record string")
    for r in chat.canonical(df).collect():
        assert r.layout == r.name and len(r.turns) >= 2 and {t.text for t in r.turns} == {text}


@pytest.mark.parametrize("role,text", [("user", ""), ("", "x"), ("odd\nrole\\", "y\n"), ("assistant", "<|im_start|>user\nx<|im_end|>\n"), ("assistant", "\\\\<\\|"), ("system", "<<SYS>>" * 50)])
def test_chat_round_trip(spark, role, text):
    df = spark.createDataFrame([([(role, text), ("assistant", "z🙂")],)], f"turns {chat.TURNS}")
    r = chat.formatted(df).select(chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [tuple(t) for t in r.back] == [(role, text), ("assistant", "z🙂")]
    assert r.loss == (text if role == "assistant" else "") + "z🙂"


def test_chat_query_special_cases(spark, tmp_path):
    data = [(1, 0, "user", None), (1, 1, "assistant", "b"), (2, 1, None, "x"), (2, None, "user", "first"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"user\nfirst\n\nx\n").hexdigest()
    assert got[3].n_turns == 2 and got[3].loss_sha256 == hashlib.sha256(b"samesame").hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{queries.PLANTED}\nassistant\n{queries.PLANTED}\n".encode()).hexdigest()


def test_chat_query_loses_nothing(spark, tmp_path):
    """Texts that look like JSON, roles of other words and very long ones, and a text of 21 million characters."""
    looks = ['{"a": 1}', '[{"k": "v"}]', "[1]", "{}", '"', 'a": {"b": 1}, "c', "\\", '\\"', "null", '{"role": "x", "content": "y"}']
    data = [(k, n, r, t) for k, t in enumerate(looks) for n, r in enumerate(("user", "assistant"))]
    data += [(100 + k, n, r, t) for k, t in enumerate(looks) for n, r in enumerate(("system", "user", "assistant"))]
    data += [(200, 0, "human", "q"), (200, 1, "gpt", "a"), (201, 0, "human", "q"), (201, 1, "gpt", "a"), (201, 2, "assistant", "z"), (202, 0, "r" * 100_000, "x"), (202, 1, "user", "y"), (203, 0, "assistant", 'b"\\\n' * 5_250_000)]
    schema = "conv_id long, turn long, role string, text string"
    parts = [spark.createDataFrame(data[:-1], schema), spark.range(1).selectExpr("203L as conv_id", "0L as turn", "'assistant' as role", r"""repeat('b"\\\n', 5250000) as text""")]
    parts[0].union(parts[1]).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for i, _, role, text in data:
        want.setdefault(i, []).append((role, text))
    got = {r.conv_id: r for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    for i, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()), i
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), i


def test_tokenfile_keeps_ids_of_pieces(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(spec)
    blocks = [["a b's  c", "", "one <|endoftext|> two\n\n one's"], ["two one  c a", "three <|endoftext|>two " + "x" * 90], [], ["", "three four\t  five", "one's two"]]
    for pieces, characters in ((600_000, 8_000_000), (4, 8_000_000), (600_000, 9), (0, 0)):
        monkeypatch.setattr(tokenfile, "KEPT_PIECES", pieces)
        monkeypatch.setattr(tokenfile, "KEPT_CHARACTERS", characters)
        encode = tokenfile.LibraryEncoder(spec)
        for texts in blocks + blocks:
            ids, found = encode(pa.array(texts, pa.string()))
            joined = ids.joined(found.numbers, found.counts)
            got = [joined.values[a:b].tolist() for a, b in zip(joined.offsets, joined.offsets[1:])]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert len(encode.kept) <= pieces and sum(map(len, encode.kept)) <= characters
    encode, seen = tokenfile.encoder(spec), []
    monkeypatch.setattr(tokenfile, "KEPT_PIECES", 600_000)
    monkeypatch.setattr(tokenfile, "KEPT_CHARACTERS", 8_000_000)
    monkeypatch.setattr(encode, "word", lambda w, f=encode.word: seen.append(w) or f(w))
    for _ in range(2):
        tokenfile.encoder(spec)(pa.array(blocks[1], pa.string()))
    assert seen and len(seen) == len(set(seen))
