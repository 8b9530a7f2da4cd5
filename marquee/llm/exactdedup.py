"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition first sorts its digests into a run and keeps one entry for each digest (Spark's sort
aggregate does this on the map side). Runs then meet in binomial rounds: in each round the runs of FAN_IN
neighbouring partitions are exchanged by digest and merged, and each merge keeps the verified best entry of every digest;
after ceil(log_FAN_IN(partitions)) rounds one entry is left for each digest. A digest that fills a third
of the table thus shrinks to one entry for each partition before its first exchange and by FAN_IN in each round.

Verified: entries only merge when SHA-256, the normalised length and an independent 64-bit hash all agree.

Defined results: a null text counts as empty; empty texts form a group like any other; among equal
texts the longest original (in code points) stays, then the smallest id (null ids last); of rows
that repeat both, one stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import join_counted, keep_rows, materialise, text_or_empty, with_row_ids

#: The characters that do not count.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"
#: Runs that one merge takes.
FAN_IN = 8
SAME_TEXT = ("text_sha256", "norm_bytes", "check_hash")


def normalised(text: Column) -> Column:
    for ch in IGNORED:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_no, id, the digest columns and n_points of every row, written to the shared folder; the texts stay behind."""
    row = F.monotonically_increasing_id().cast("string") if row_col is None else docs[row_col]
    text = text_or_empty(docs, text_col)
    plain = docs.select(row.alias("row_no"), docs[id_col].cast("long").alias("id"), F.char_length(text).alias("n_points"), normalised(text).alias("norm"), F.spark_partition_id().alias("run"))
    found = plain.select("row_no", "id", "n_points", "run", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("norm_bytes"), F.xxhash64("norm").alias("check_hash"))
    return materialise(found, "digests")


def better() -> Column:
    """An entry whose maximum is the row that stays: most code points, smallest id (null last); row_no decides between repeated rows."""
    return F.struct("n_points", F.col("id").isNotNull().alias("has_id"), (-F.col("id")).alias("minus_id"), "row_no")


def tree_merge(found: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each different text: digest columns, best (see better()) and group_size."""
    runs = (found.agg(F.max("run")).first()[0] or 0) + 1
    level = found.select(*SAME_TEXT, "run", better().alias("best"), F.lit(1).cast("long").alias("group_size"))
    while True:
        runs = -(-runs // fan_in)
        # runs that meet in this round get one number; the exchange deals their digests over all tasks
        level = level.withColumn("run", F.floor(F.col("run") / fan_in)) if runs > 1 else level.drop("run")
        keys = [*SAME_TEXT, "run"] if runs > 1 else [*SAME_TEXT]
        level = level.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
        if runs <= 1:
            return level


def assignments(found: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """id, row_no, keep_id, group_size, kept and text_sha256 for every row of digests()."""
    best = materialise(tree_merge(found, fan_in), "best").withColumn("n", F.col("group_size"))
    return join_counted(found, best, [*SAME_TEXT], "n", found.count()).select(
        "id", "row_no", (-F.col("best.minus_id")).alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """assignments() of a table."""
    return assignments(digests(docs, id_col, text_col))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False) -> DataFrame:
    """The rows of docs that stay, with docs' columns; from_files: see with_row_ids()."""
    rows, row = with_row_ids(docs, "exact", from_files)
    best = tree_merge(digests(rows, id_col, text_col, row))
    kept = best.select(F.col("best.row_no").alias(row))
    return keep_rows(rows, row, kept)


