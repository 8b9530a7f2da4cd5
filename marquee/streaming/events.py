"""Structured Streaming twins of the batch operators: latest-state tables and session expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.mutations import latest, upsert_latest
from marquee.sources.files import EVENT_TYPES
from marquee.sources.scratch import scratch_path
from marquee.sources.versions import Store



def valid_events(raw: DataFrame) -> DataFrame:
    """Events with an item and a known type: the item is movie_id, else id; others are rejected."""
    return raw.withColumn("movie_id", F.coalesce("movie_id", "id") if "id" in raw.columns else F.col("movie_id")).where(F.col("movie_id").isNotNull() & F.col("event_type").isin(*EVENT_TYPES))


class LatestState:
    """foreachBatch sink: keeps the last row of each key below `root`.

    A batch rewrites the buckets that its keys fall in, no others, and is committed with its number. So a new instance on the same root goes on from
    what was written, and a batch that is repeated after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: tuple[str, ...], name: str = "state", root: str | None = None, buckets: int = 16):
        self.spark, self.keys, self.order, self.name, self.buckets = spark, keys, order, name, buckets
        self.store = Store(spark, root)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.store.mark(self.name) >= epoch:
            return
        with self.store.begin(self.name, epoch) as tx:
            new = latest(batch, self.keys, *self.order)
            if self.name in tx.next["tables"]:
                tx.upsert(self.name, new, lambda old, more: upsert_latest(old, more, self.keys, *self.order))
            else:
                tx.create(self.name, new, self.keys, self.buckets)

    def read(self) -> DataFrame:
        return self.store.read(self.name)


def table_stream(spark: SparkSession, folder: str, name: str, like: DataFrame, files: int = 4) -> DataFrame:
    """The files of a table as a stream; a table that is one file is picked out of its folder."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files)
    if any(f.endswith(f"/{name}.parquet") for f in like.inputFiles()[:1]):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def run_available(stream: DataFrame, sink, checkpoint: str | None = None) -> None:
    """All that is there now, then stop; with the checkpoint of an earlier run only what came since."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()


def live(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions still valid; expiry is fixed, not sliding."""
    return sessions.where(F.col("expires_at") > now)
