"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Each source has a weight and a schedule: its density along training time t in [0, 1] is linear,
from `start` to `end` (relative values). The integral of a source's density times its target is its
cumulative token demand D(t). Documents of a source stand in a fixed pseudo-random order; laid end to
end, pass after pass, the document at token offset x gets the training position t that solves D(t) = x,
until the demand D(1) = target is met. Sorting all uses by position (a range sort) gives the training order.

Targets: shares of the total by weight, capped at `max_epochs` times the source's size; the excess is shared
again by weight until no source is above its cap (closed form: sources sorted by cap over weight).

A hot source is no single task: offsets come from two levels of prefix sums, over hash slices of a source and then
inside a slice.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents
of size 0 are never taken; repeated rows are separate documents that take equal places; an
empty table gives an empty result; only id, text and source are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import materialise, text_or_empty, with_row_ids

#: A word, and the weights of sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hexadecimal digits of the slice number: 4096 slices of a source.
SLICE_DIGITS = 3
#: Relative density of the k-th source at the start and end of training, repeating.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "0", row_col: str | None = None) -> DataFrame:
    """row_no, id, source, size (words) and order_key of every row, written to the shared folder."""
    row = F.monotonically_increasing_id().cast("string") if row_col is None else docs[row_col]
    key = F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":" + seed)))
    return materialise(
        docs.select(row.alias("row_no"), docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("source"), F.regexp_count(text_or_empty(docs, text_col), F.lit(WORD)).cast("long").alias("size"), key.alias("order_key")), "sized"
    )


def targets(slices: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """source, source_size, target, start and end of its schedule; one row for each source.

    The windows here run over the list of sources, one row each.
    """
    per = slices.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("nth") % len(values) + 1).cast("int"))
    per = per.withColumn("nth", nth).withColumn("weight", pick([float(w) for w in weights])).withColumn("start", pick([s for s, _ in schedules])).withColumn("end", pick([e for _, e in schedules]))
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = W.orderBy("ratio", "nth")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that the level does not fill fixes the level for itself and all after it
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth"))).over(whole)
    return per.select("source", "source_size", "start", "end", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def position(x: Column) -> Column:
    """The t that solves D(t) = x: with density a + (b - a) t, a t + (b - a) t^2 / 2 = x / target * (a + b) / 2."""
    a, b = F.col("start"), F.col("end")
    share = x / F.col("target") * (a + b) / F.lit(2.0)
    root = (F.sqrt(a * a + F.lit(2.0) * (b - a) * share) - a) / (b - a)
    return F.when(a == b, share / a).otherwise(root)


def assign(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """For every row of sized(): row_no, id, source, size, source_size, target, taken and positions (one for each use, ascending)."""
    rows = rows.withColumn("slice", F.substring("order_key", 1, SLICE_DIGITS))
    slices = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("size")), "slices")
    goal = targets(slices, weights, max_epochs, schedules)
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # at most 16^SLICE_DIGITS rows a source
    base = slices.select("source", "slice", F.coalesce(F.sum("size").over(upto), F.lit(0)).cast("long").alias("base"))
    base = base.join(goal, base["source"].eqNullSafe(goal["source"])).select(base["source"].alias("of"), base["slice"].alias("at"), "base", "source_size", "start", "end", "target")
    near = rows.join(base, (F.col("slice") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    inside = W.partitionBy("source", "slice").orderBy("order_key", "id", "size", "row_no").rowsBetween(W.unboundedPreceding, -1)
    offset = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = near.withColumn("offset", offset)
    # a use starts at offset + pass * source_size; it is taken if its middle lies inside the demand
    starts = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda k: F.col("offset") + k * F.col("source_size"))
    uses = F.filter(starts, lambda s: (F.col("size") > 0) & (s + F.col("size") / F.lit(2.0) <= F.col("target")))
    placed = placed.withColumn("uses", uses)
    return placed.select(
        "row_no", "id", "source", "size", "source_size", "target", (F.size("uses") * F.col("size")).cast("long").alias("taken"), F.transform("uses", lambda s: F.round(position(s.cast("double")), 9)).alias("positions")
    )


def curriculum(assigned: DataFrame) -> DataFrame:
    """One row for each use of a document, range-sorted by training position."""
    return assigned.select("row_no", "id", "source", "size", F.explode("positions").alias("position")).orderBy("position", "id", "row_no")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "0") -> DataFrame:
    """assign() of a table."""
    return assign(sized(docs, id_col, text_col, source_col, seed))


def taken_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "0", from_files: bool = False) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with docs' columns, in training order.

    Size-only facts are joined to the texts by row number. Written as files, the rows stand in training order by file and place,
    which training_place() reads again; from_files: see with_row_ids().
    """
    rows, row = with_row_ids(docs, "mix", from_files)
    uses = curriculum(assign(sized(rows, id_col, text_col, source_col, seed, row))).select(F.col("row_no").alias(row), F.col("position").alias("training_position"))
    place = "training_position"
    while place.lower() in {c.lower() for c in rows.columns}:
        place = "_" + place
    out = rows.join(uses.withColumnRenamed("training_position", place), row)
    return out.repartitionByRange(place).sortWithinPartitions(place, row).select(*docs.columns)


def training_place(docs: DataFrame, name: str) -> DataFrame:
    """A written taken_documents() with one more column, a text that sorts the rows as they stand in its files: file number and place.

    A DataFrame that is not read from files gets its present order.
    """
    try:
        file, place = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.col("_metadata.row_index")
        return docs.select("*", F.concat(F.lpad(file, 10, "0"), F.lit("-"), F.lpad(place.cast("string"), 12, "0")).alias(name))
    except AnalysisException:  # no file behind it
        return docs.withColumn(name, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
