"""Each stage of the pipeline against a brute-force version on its own input."""

import itertools
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from marquee.llm import bpe, mixing, quality, simhash
from marquee.llm.common import materialise, table
from tests.llm.test_operators import shingles, slow_classes, slow_keepers, texts_of


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, f in P.STAGES:
        out.append(materialise(f(spark, out[-1], sf), name))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage_keeps_clean_documents(spark, sf, stages):
    kept = {i for i, _ in texts_of(stages[1])}
    model = quality.train(stages[0], table(spark, sf, "labels"))
    assert kept == {r.doc_id for r in quality.with_scores(stages[0], model).where("score >= 0.5").collect()}
    labels = table(spark, sf, "labels").collect()
    assert sum(r.doc_id in kept for r in labels if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in labels)
    assert sum(r.doc_id in kept for r in labels if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in labels)


def test_exact_stage(stages):
    assert sorted(i for i, _ in texts_of(stages[2])) == sorted(k for k, _ in slow_keepers(texts_of(stages[1])).values())


def test_near_stage(stages):
    """What stays is the first of each class that pairs of similarity 0.8 connect."""
    assert sorted(i for i, _ in texts_of(stages[3])) == sorted(slow_classes(dict(texts_of(stages[2]))))


def test_near_stage_links_planted_copies(spark):
    """Copies with one word in forty replaced, of which some come in a large group, and unlike texts, which stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(200)] for _ in range(150)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(600):
        copy = list(base[0 if k < 300 else k % 150])
        copy[rng.randrange(200)] = word()
        rows.append((1000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == list(range(150))


def test_near_stage_keeps_pairs_below_the_similarity(spark):
    """Pairs of 0.70 and 0.79 and chains of them stay apart."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows = []
    for k in range(200):
        text = [word() for _ in range(200 + P.WORDS - 1)]
        for step, more in enumerate((0, 86, 76)):  # 200 of 286 shingles, 286 of 362
            text = text + [word() for _ in range(more)]
            rows.append((3 * k + step, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == list(range(600))


def test_near_stage_loses_no_similar_pair(spark):
    """Pairs of exactly 0.8 and little above, of short texts too: a text and the same with words appended."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows = []
    for k in range(1200):
        n, more = [(4, 1), (12, 3), (40, 10), (9, 2)][k % 4]  # shingles of the first, and those appended
        text = [word() for _ in range(n + P.WORDS - 1)]
        rows += [(k, " ".join(text)), (10_000 + k, " ".join(text + [word() for _ in range(more)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == list(range(1200))


def test_rare_shingles_propose_every_similar_pair_in_slices(spark):
    """Texts of common shingles only, with every meeting place cut into slices and every hub into several."""
    rng = random.Random(3)
    lines = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(8)) for _ in range(14)]
    texts = {k: " ".join(sorted(rng.sample(lines, rng.randrange(9, 13)))) for k in range(150)}
    parts = {i: shingles(t) for i, t in texts.items()}
    near = {(a, b) for a, b in itertools.combinations(texts, 2) if parts[a] != parts[b] and len(parts[a] & parts[b]) * 5 >= 4 * len(parts[a] | parts[b])}
    was, simhash.BLOCK_ROWS = simhash.BLOCK_ROWS, 10
    try:
        df = spark.createDataFrame([(str(k), k, t) for k, t in texts.items()], "row_no string, id long, text string")
        order = simhash.common_shingles(df, P.WORDS)
        nodes = materialise(simhash.shingle_sets(df, P.WORDS, P.SIMILARITY, order), "nodes")
        alone = spark.createDataFrame([], "node long, root long")
        pairs = materialise(simhash.open_pairs(simhash.meetings(nodes, P.SIMILARITY, order), nodes, alone, P.SIMILARITY), "pairs")
        found = simhash.alike(pairs, nodes, df, P.WORDS, P.SIMILARITY).collect()
        kept = [r.id for r in simhash.deduplicated(df, id_col="id").collect()]
    finally:
        simhash.BLOCK_ROWS = was
    set_of = lambda i: simhash.shingle_set(texts[i], P.WORDS)
    node = {i: simhash.digest_of(set_of(i)) for i in texts}
    assert near and {frozenset(r) for r in found} == {frozenset((node[a], node[b])) for a, b in near}
    assert sorted(kept) == sorted(slow_classes(texts))


def test_mixing_stage(stages):
    want = sorted(i for r in mixing.mixed(stages[3]).collect() for i in [r.id] * len(r.positions))
    assert sorted(i for i, _ in texts_of(stages[4])) == want


def test_training_order_reaches_the_output(stages):
    """Places of the encoded uses are those of the curriculum, by document."""
    places = {r.id: sorted(r.positions) for r in mixing.mixed(stages[3]).collect()}
    order = [places[r.doc_id].pop(0) for r in stages[5].orderBy("training_place").collect()]
    assert order == sorted(order) and not any(places.values())


def test_encoding_stage(stages):
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = dict(texts_of(stages[4]))
    got = stages[5].collect()
    assert len({r.training_place for r in got}) == len(got) == stages[4].count() and all(r.ids == library.encode_ordinary(text[r.doc_id]) for r in got)


def test_special_cases(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, f in P.STAGES[:-1]:
            docs = materialise(f(spark, docs, sf), "odd")
            assert docs.columns == odd_docs.columns
        P.STAGES[-1][1](spark, docs, sf).count()


def test_common_shingles_are_counted_over_all_texts(spark):
    """More texts than a sample would hold: the counts are exact."""
    df = spark.range(12_000, numPartitions=4).select(F.when(F.col("id") % 1000 == 0, F.concat(F.lit("aa bb cc dd ee only"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("ff gg hh ii jj n"), F.col("id").cast("string"))).alias("text"))
    hashes, n = simhash.common_shingles(df, 5)
    want = {int(simhash.shingle_set("aa bb cc dd ee", 5)[0]): 12, int(simhash.shingle_set("ff gg hh ii jj", 5)[0]): 11_988}
    assert dict(zip(hashes.tolist(), n.tolist())) == want
