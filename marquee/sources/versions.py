"""Tables that change in transactions: numbered versions below one folder, copied on write by key.

A version is one small file, manifests/<number>.json, that names the folders its tables consist of; the version with the greatest number is the
present one. Data are written first, into folders that nothing names yet, and the manifest is put in place last, by a rename: so
readers see all tables of a commit or none, and what fails half way leaves the version before. Folders are never changed once written; a reader
that holds a version goes on reading it until vacuum() removes it.

A table with keys is dealt into buckets by a hash of the keys. upsert() reads and writes the buckets alone in which changes
fall; all others stay in the folders where earlier versions wrote them. rewrite() takes the whole content at once, and keeps the old folders of
buckets in which nothing changed. A table without keys is a log, to which append() adds a folder.

The hash is the one that Spark deals rows to tasks by. Rows that keyed() has dealt by key, to a multiple of the buckets, therefore lie in tasks of one bucket each:
they are joined by key and written by bucket with one shuffle for both. Only the number of files depends on that, no result.

One writer at a time: a commit that began before another one ended is refused (Conflict). A stream writes its batch number as a mark with its
rows, in the same commit, so a batch that is repeated is known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.sources.scratch import scratch_path

#: Buckets of a new table with keys. A bucket is written by as many tasks as its size asks for.
BUCKETS = 16
#: Bytes of a table's files for each task that rewrites it.
TASK_BYTES = 32 << 20
#: Column of rewrite(): what became of a row.
STATE, SAME, CHANGED, NEW = "_state", 0, 1, 2


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Store:
    """The tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "store")).rstrip("/")

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self):
        return self.path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path, fs = self.path(folder), self.fs()
        return sorted(str(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        there = self.versions()
        if not there:
            return {"version": 0, "tables": {}, "marks": {}}
        stream = self.fs().open(self.path(f"manifests/{there[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def schema(self, name: str, version: int | None = None) -> StructType:
        return StructType.fromJson(self.manifest(version)["tables"][name]["schema"])

    def mark(self, stream: str) -> int:
        """The last batch of a stream that has been committed; -1 before the first."""
        return self.manifest()["marks"].get(stream, -1)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.load(self.manifest(version)["tables"][name])

    def load(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        parts = [p for b, p in table["parts"].items() if buckets is None or int(b) in buckets]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{p}" for p in parts])

    def size(self, table: dict) -> int:
        """Bytes of a table's files."""
        fs = self.fs()
        return sum(fs.getContentSummary(self.path(p)).getLength() for p in table["parts"].values())

    def begin(self, stream: str | None = None, batch: int | None = None) -> Transaction:
        return Transaction(self, stream, batch)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last `keep` versions and the data that none of these names; the number of folders removed."""
        fs, there = self.fs(), self.versions()
        used = {p.split("/")[1] for v in there[-keep:] for t in self.manifest(v)["tables"].values() for p in t["parts"].values()}
        gone = [n for n in self.names("data") if n not in used]
        for v in there[:-keep]:
            fs.delete(self.path(f"manifests/{v}.json"), True)
        for n in gone:
            fs.delete(self.path(f"data/{n}"), True)
        return len(gone)


class Transaction:
    """Writes that become visible together when the block ends, or not at all."""

    def __init__(self, store: Store, stream: str | None = None, batch: int | None = None):
        self.store, self.base = store, store.manifest()
        self.next = json.loads(json.dumps(self.base))
        self.folder, self.written, self.held = f"data/{uuid.uuid4().hex}", 0, []
        #: Of each table the buckets that upsert() wrote anew.
        self.rewritten: dict[str, list[int]] = {}
        if stream is not None:
            self.next["marks"][stream] = batch

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()
        else:
            self.abort()

    def read(self, name: str) -> DataFrame:
        """A table with this transaction's own writes."""
        return self.store.load(self.next["tables"][name])

    def hold(self, df: DataFrame) -> DataFrame:
        """df as written rows, so that it is computed once; they go with the commit."""
        path = self.place("held")
        self.held.append(path)
        df.write.parquet(f"{self.store.root}/{path}")
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{path}")

    def place(self, name: str) -> str:
        self.written += 1
        return f"{self.folder}/{self.written}-{name}"

    def create(self, name: str, df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> None:
        """A new table, or a new content and schema of one."""
        table = {"schema": json.loads(df.schema.json()), "keys": keys or [], "buckets": buckets if keys else 0, "hash": "murmur3", "parts": {}}
        self.next["tables"][name] = table
        if keys:
            table["parts"] = self.deal(self.place(name), df, table)
        else:
            self.append(name, df)

    def drop(self, name: str) -> None:
        self.next["tables"].pop(name, None)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a table without keys."""
        table, path = self.next["tables"][name], self.place(name)
        rows.select(*StructType.fromJson(table["schema"]).fieldNames()).write.parquet(f"{self.store.root}/{path}")
        table["parts"][str(max(map(int, table["parts"]), default=-1) + 1)] = path

    def compact(self, name: str) -> None:
        """A log's folders as one."""
        df = self.read(name)
        self.next["tables"][name]["parts"] = {}
        self.append(name, df)

    def keyed(self, name: str) -> Callable[[DataFrame], DataFrame]:
        """Deals rows by the keys of a table, to so many tasks as its size asks for, each of one bucket."""
        table = self.next["tables"][name]
        tasks = table["buckets"] * max(1, -(-self.store.size(table) // (TASK_BYTES * table["buckets"])))
        return lambda df: df.repartition(tasks, *table["keys"])

    def upsert(self, name: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], by_keys: bool = False, stay: Column | None = None) -> None:
        """The table where `merge(old, changes)` stands for the buckets that the keys of changes fall in; merge keeps every row in its bucket.

        by_keys promises that merge is one join by exactly the table's keys; both sides come dealt by them. Old rows for which `stay` holds are not given
        to merge: they are written as they are by the tasks that read them.
        """
        table = self.next["tables"][name]
        held = self.hold(changes)
        touched = sorted(r[0] for r in held.select(bucket(table)).distinct().collect())  # no more numbers than buckets
        self.rewritten[name] = touched
        if not touched:
            return
        names = StructType.fromJson(table["schema"]).fieldNames()
        dealt = self.keyed(name) if by_keys else lambda df: df
        old, path = self.store.load(table, touched), self.place(name)
        if stay is not None:
            stay = F.coalesce(stay, F.lit(False))
            self.deal(path, old.where(stay), table, True)
            old = old.where(~stay)
        written = self.deal(path, merge(dealt(old), dealt(held)).select(*names), table, by_keys, "error" if stay is None else "append")
        if not written.keys() <= {str(b) for b in touched}:
            raise ValueError(f"merge moved rows of {name} to buckets it had not read")
        table["parts"] = {b: p for b, p in table["parts"].items() if int(b) not in touched} | written

    def rewrite(self, name: str, rows: DataFrame, number: Callable[[DataFrame], DataFrame]) -> None:
        """The table with `rows` as its whole content; STATE tells which are SAME as before, CHANGED or NEW. Buckets without a row that is not the SAME
        stay in the folders they have. New rows are written as they come, read back, given what number() gives them, and written once more.

        Rows best come from one join of keyed() sides; then they are written without another shuffle.
        """
        table, path = self.next["tables"][name], self.place(name)
        schema = StructType.fromJson(table["schema"])
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*typed, STATE).withColumn("_bucket", bucket(table)).write.partitionBy("_bucket", STATE).parquet(f"{self.store.root}/{path}")
        states = {b: self.store.names(f"{path}/{b}") for b in self.store.names(path) if b.startswith("_bucket=")}
        fresh = [f"{path}/{b}/{STATE}={NEW}" for b, there in states.items() if f"{STATE}={NEW}" in there]
        if fresh:
            numbered = number(self.store.spark.read.schema(schema).parquet(*[f"{self.store.root}/{p}" for p in fresh])).select(*schema.fieldNames())
            self.deal(path, numbered, table, mode="append")
            for p in fresh:
                self.store.fs().delete(self.store.path(p), True)
        for b, there in states.items():
            at = b.removeprefix("_bucket=")
            if {f"{STATE}={CHANGED}", f"{STATE}={NEW}"} & set(there):
                table["parts"][at] = f"{path}/{b}"
                self.rewritten.setdefault(name, []).append(int(at))
            else:
                self.store.fs().delete(self.store.path(f"{path}/{b}"), True)
        self.rewritten[name] = sorted(self.rewritten.get(name, []))

    def deal(self, path: str, df: DataFrame, table: dict, in_place: bool = False, mode: str = "error") -> dict[str, str]:
        """Writes rows by bucket. Large buckets are cut to tasks of the usual size; in_place: rows are written by the tasks they are in."""
        placed = df.withColumn("_bucket", bucket(table))
        (placed if in_place else placed.hint("rebalance", "_bucket")).write.mode(mode).partitionBy("_bucket").parquet(f"{self.store.root}/{path}")
        return {n.removeprefix("_bucket="): f"{path}/{n}" for n in self.store.names(path) if n.startswith("_bucket=")}

    def commit(self) -> int:
        """Puts the new manifest in place; its number."""
        fs, number = self.store.fs(), self.base["version"] + 1
        self.next["version"] = number
        own, final = self.store.path(f"manifests/.{uuid.uuid4().hex}"), self.store.path(f"manifests/{number}.json")
        out = fs.create(own, True)
        try:
            out.write(bytearray(json.dumps(self.next).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(own, final):
            fs.delete(own, True)
            self.abort()
            raise Conflict(f"version {number} of {self.store.root} is there already")
        for path in self.held:
            fs.delete(self.store.path(path), True)
        return number

    def abort(self) -> None:
        self.store.fs().delete(self.store.path(self.folder), True)


def bucket(table: dict) -> Column:
    hashed = F.hash if table.get("hash") == "murmur3" else F.xxhash64  # stores written before hashed by the latter
    return F.pmod(hashed(*table["keys"]), F.lit(table["buckets"])).cast("int")
