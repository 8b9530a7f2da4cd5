"""Subtitles read through a table that keeps what has been made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.sources.versions import Store

KEYS = ["kind", "media_id", "track"]


class SubtitleCache:
    """Made subtitles by kind (movie or episode), media_id and track, in a store."""

    def __init__(self, store: Store, buckets: int = 16):
        self.store = store
        if "subtitles" not in store.tables():
            with store.begin() as tx:
                tx.create("subtitles", store.spark.createDataFrame([], "kind string, media_id long, track int, body string"), KEYS, buckets)

    def answer(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """wanted (KEYS and start) with body and source: kept, made, or failed (no body).

        What the table has is answered from it, whatever the start. The rest is made once by make(missing), which gives KEYS, start and body, null where
        it failed: that goes to the answer and, if it begins at 0 and is not empty, also to the table, of several the greatest; the rewritten buckets are those of new keys.
        """
        with self.store.begin() as tx:
            there = tx.read("subtitles").where(F.length("body") > 0)
            asked = tx.hold(wanted)
            made = self.written(make(asked.join(there.select(*KEYS), KEYS, "left_anti").distinct()))
            hits = self.written(asked.join(there, KEYS).withColumn("source", F.lit("kept")))
            fresh = made.where((F.col("start") == 0) & (F.length("body") > 0)).groupBy(*KEYS).agg(F.max("body").alias("body"))
            tx.upsert("subtitles", fresh, lambda old, new: old.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new))
            own = self.written(asked.join(hits.select(*KEYS).distinct(), KEYS, "left_anti").join(made.select(*KEYS, "start", "body"), [*KEYS, "start"], "left"))
        return hits.unionByName(own.withColumn("source", F.when(F.col("body").isNull(), "failed").otherwise("made")))

    def written(self, df: DataFrame) -> DataFrame:
        """Rows in the shared folder that outlive the transaction, so that nothing is made twice."""
        from marquee.sources.scratch import scratch_path

        path = scratch_path(self.store.spark, "subtitles")
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)
