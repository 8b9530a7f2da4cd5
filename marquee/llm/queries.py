"""The registered query of each corpus operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, chat, counting, exactdedup, htmltext, merkle, mixing, phrases, quality, simhash, tokenfile, vptree, warc
from marquee.llm.common import materialise, table

#: Where vocabulary files are; a function of a file name.
vocabulary = public_tokenizers.path
END_ID = 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.segment_path(spark)
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, Path(vocabulary("byte_bpe_50k.json")).read_text(), END_ID)
    return tokenfile.read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("digest").alias("ids_crc32"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(F.col("source_id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", F.char_length("block").cast("long").alias("block_chars"), F.sha2("record", 256).alias("record_sha256"))


def op4_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = materialise(mixing.mixed(table(spark, sf_dir, "documents")), "mix")
    out = mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(bpe.decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op7_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every document, keeps the trees, and follows three edits of each: an insertion inside, a removal before it, and a replacement at the end."""
    docs = table(spark, sf_dir, "documents")
    ranks, pattern = bpe.load_ranks(vocabulary("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    trees = materialise(counting.count(docs, ranks, pattern), "trees")
    n = F.char_length("text")
    one = lambda at, removed, inserted: F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(one(F.floor(n / 2), 0, " revised\n 2024"), one(F.floor(n / 3), 7, ""), one(n - 1, 3, " end. "))
    found = counting.recount(trees.withColumn("edits", edits), ranks, pattern)
    return found.select(F.col("id").alias("doc_id"), "tokens_before", F.col("n_tokens").alias("tokens_after"), F.char_length("text").cast("long").alias("chars_after"), "encoded_chars", F.size("leaf_chars").cast("long").alias("n_leaves"))


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = vptree.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Conversation -7 of the query: its texts look like another template's control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = rows.unionByName(planted).groupBy("conv_id").agg(turns.alias("t"))
    # conversations reach the operator in the layouts that such corpora come in
    t = F.col("t")
    roles = F.transform(t, lambda x: x["role"])
    text = lambda i: F.get(t, F.lit(i))["text"]
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(F.size(t) % 2 == 0, F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))))
    )
    made = chat.formatted(chat.canonical(whole.select("conv_id", record.alias("record"))))
    made = made.select("conv_id", "layout", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return made.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: Letters that the tampering of op11 lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", chosen, {"text": F.translate("text", UPPER, LOWER)})
    layers, paths, root = merkle.manifest(found)
    # the version of a tree of one leaf is that leaf
    own_root = F.coalesce(F.element_at("copied", -1), F.coalesce("tampered", "leaf"))
    made = merkle.versions(layers, paths).select("*", F.lit(root).alias("root"), own_root.alias("folded_root"))
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_tokenfile, op3_warc, op4_exactdedup, op5_mixing, op6_bpe, op7_counting, op8_vptree, op9_quality, op10_chat, op11_merkle, op12_htmltext, op13_phrases, pipeline)}
