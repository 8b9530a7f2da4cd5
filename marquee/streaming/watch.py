"""Posted watch events as a stream into two logs and two tables of progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.mutations import latest, upsert_latest
from marquee.sources.files import EVENT_TYPES, OK, watch_events
from marquee.sources.versions import Store

#: Kind of item: its id, its log and its table of progress.
KINDS = {"movie": ("movie_id", "playback_logs", "playback_progress"), "episode": ("episode_id", "episode_playback_logs", "episode_playback_progress")}


def accepted(posts: DataFrame, body: str = "body") -> DataFrame:
    """The events of posted bodies that are answered with OK and whose type the logs know. Works on streams."""
    return watch_events(posts, body).where((F.col("answer") == OK) & F.col("event_type").isin(*EVENT_TYPES)).drop("answer")


class WatchSink:
    """foreachBatch sink of accepted() with username, ts and id: every event is logged, and the last one of each user and item is its progress.

    The four tables change in one commit, which also holds the number of the batch. A batch that Spark repeats after a failure is known by it
    and left out, also by a new instance on the same root; a batch that failed before its commit has left nothing.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, stream: str = "watch", buckets: int = 16):
        self.store, self.stream, self.buckets = Store(spark, root), stream, buckets

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.store.mark(self.stream) >= epoch:
            return
        with self.store.begin(self.stream, epoch) as tx:
            held = tx.hold(batch)
            for item, log, progress in KINDS.values():
                events = held.where(F.col(item).isNotNull())
                logged = events.select("id", "username", item, "event_type", "position", "ts")
                last = latest(events.select("username", item, "ts", "id", "position", "duration"), ["username", item], "ts", "id")
                if log in tx.next["tables"]:
                    tx.append(log, logged)
                    tx.upsert(progress, last, lambda old, new, keys=("username", item): upsert_latest(old, new, list(keys), "ts", "id"))
                else:
                    tx.create(log, logged)
                    tx.create(progress, last, ["username", item], self.buckets)

    def read(self, table: str) -> DataFrame:
        return self.store.read(table)
