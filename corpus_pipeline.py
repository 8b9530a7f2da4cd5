"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet and reads again as the next stage's docs. All but the last return the columns of documents.

Defined results: a null text counts as empty and is judged, grouped, mixed (with size 0, so never taken) and encoded as such; repeated
rows are copies of each other, of which one stays; rows without an id are judged by the classifier but teach it nothing, and lose to rows
with one; an empty table passes through every stage and gives an empty result; columns beside those named here are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, exactdedup, mixing, quality, simhash
from marquee.llm.common import discard, fresh, materialise, table

#: Near duplicates: words of a shingle and similarity.
WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.with_scores(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exactdedup.deduplicated(docs, from_files=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return simhash.deduplicated(docs, words=WORDS, similarity=SIMILARITY, from_files=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; their files hold them in training order."""
    return mixing.taken_documents(docs, from_files=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, training_place (sorts the uses in training order), n_tokens, ids and decoded_sha256 of every use of a document."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    place = fresh(docs, "training_place")
    coded = bpe.encode(mixing.training_place(docs, place), ranks, public_tokenizers.PATTERN, row_col=place)
    return coded.select(
        F.col("id").alias("doc_id"), F.col("row_no").alias("training_place"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(bpe.decoded(F.col("ids"), ranks), 256).alias("decoded_sha256")
    )


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier, near duplicates and merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not source:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
