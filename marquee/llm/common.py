"""What the corpus operators share: scratch tables in the cluster's shared folder and column helpers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.scratch import shared_root


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; see marquee.sources.scratch."""
    return shared_root(spark)


def materialise(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage: what follows survives lost executors and does not compute df again. rows_per_file: where rows are large, so many of them in a file.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/marquee/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark sends to a Python worker at once where rows hold whole texts; 10,000 long texts would fill it.
TEXT_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to TEXT_ROWS, unless it is lower, and leaves it so: Spark reads it when a plan runs, not when it is made."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory: a Python worker waits for its next task with as little as it can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(df: DataFrame, text_col: str = "text") -> Column:
    """The text, empty where it is null; Python workers will get it in short batches."""
    short_batches(df.sparkSession)
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def with_row_ids(df: DataFrame, name: str = "rows", from_files: bool = False) -> tuple[DataFrame, str]:
    """df with one more column that tells all rows apart, repeated ones too, the same each time it is read; and its name.

    from_files promises that df is a table as read from files, whose rows each have a file and a place. Any other DataFrame is
    written to the shared folder first, since rows that were made from one row of a file share its place.
    """
    row = fresh(df, "row_key")
    if from_files:
        try:
            return df.select("*", F.concat(F.md5("_metadata.file_path"), F.lit(":"), F.col("_metadata.row_index").cast("string")).alias(row)), row
        except AnalysisException:  # no file behind it
            pass
    return materialise(df.withColumn(row, F.monotonically_increasing_id().cast("string")), name), row


def keep_rows(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose key is in kept (one column of the same name), without the key.

    The keys are unique on both sides, so none is hot. The keys that go are found first, so that whole rows are moved only
    if those are too many to be sent to all tasks; Spark decides by the size of their table.
    """
    gone = materialise(rows.select(row).join(kept.select(row), row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").drop(row)


#: A key is hot if it holds more than this part of all rows; so there are fewer than 1,000 hot keys.
HOT = 1000


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """rows joined with facts, which has one row for each key and in n_col how many of the `total` rows have it; n_col is dropped.

    The facts of hot keys, fewer than HOT, are sent to all tasks and their rows stay where they are; only the others meet by shuffle.
    """
    hot = F.col(n_col) * HOT > total
    few = F.broadcast(facts.where(hot).drop(n_col))
    names = [*rows.columns, *[c for c in facts.columns if c not in keys and c != n_col]]
    direct = rows.join(few, keys)
    others = rows.join(few.select(*keys), keys, "left_anti").join(facts.where(~hot).drop(n_col), keys)
    return direct.select(*names).unionAll(others.select(*names))


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialise() wrote and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"{scratch_root(spark)}/marquee/".removeprefix("file:").lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
