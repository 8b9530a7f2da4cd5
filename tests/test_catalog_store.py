"""Sessions in the state of a stream, schemas and migrations, kept subtitles, the search index, settings files."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import catalog as C
from marquee.operators import mutations as M
from marquee.operators import search_index as SX
from marquee.sources import files
from marquee.sources import schema as SM
from marquee.sources import subtitles as SU
from marquee.sources import versions as V
from marquee.streaming import events as E
from marquee.streaming import sessions as SS

DAY = 86_400
EVENT = "token string, username string, is_admin int, kind string, ts timestamp"


def feed(spark, folder, batches):
    """One file a batch, in their order."""
    for n, data in enumerate(batches):
        made = spark.createDataFrame([(t, u, 0, kind, s) for t, u, kind, s in data], "token string, username string, is_admin int, kind string, s long")
        made.select("token", "username", "is_admin", "kind", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def changes_of(log):
    return sorted((r.token, r.change, r.at.timestamp()) for r in log.read().collect())


def test_sessions_end_a_day_after_their_login(spark, tmp_path):
    """Timers end sessions for which nothing more comes; a second login prolongs nothing; logouts end at once; a restart goes on."""
    source, mark, store = str(tmp_path / "in"), str(tmp_path / "mark"), V.Store(spark, f"file:{tmp_path}/store")
    run = lambda: E.run_available(SS.session_changes(stream_of(spark, source)), SS.ChangeLog(store, "s"), mark)
    feed(spark, source, [[("a", "u", "login", 1000), ("b", "u", "login", 2000)], [("a", "u", "login", 1000 + DAY - 1), ("c", "w", "login", 1000 + DAY - 1)]])
    run()
    log = SS.ChangeLog(store, "s")
    assert changes_of(log) == [("a", "opened", 1000.0), ("b", "opened", 2000.0), ("c", "opened", 1000.0 + DAY - 1)]
    feed(spark, source, [[("c", "w", "logout", 1001 + DAY), ("x", "u", "logout", 1001 + DAY)]])
    run()
    feed(spark, source, [[("d", "u", "login", 1500 + DAY)], [("a", "u", "login", 1900 + DAY)]])
    run()
    got = changes_of(log)
    assert ("a", "expired", 1000.0 + DAY) in got and ("c", "closed", 1001.0 + DAY) in got and ("a", "opened", 1900.0 + DAY) in got
    assert not any(t == "x" for t, _, _ in got) and not any((t, c) == ("b", "expired") for t, c, _ in got)
    feed(spark, source, [[("e", "u", "login", 5000 + 3 * DAY)], [("f", "u", "login", 5001 + 3 * DAY)]])
    run()
    ended = {(t, c) for t, c, _ in changes_of(log) if c != "opened"}
    assert ended >= {("a", "expired"), ("b", "expired"), ("d", "expired"), ("c", "closed")} and not {("e", "expired"), ("f", "expired")} & ended
    at = lambda s: {r.token for r in SS.live_sessions(log.read(), F.timestamp_seconds(F.lit(s))).collect()}
    assert at(1000 + DAY - 1) == {"a", "b", "c"} and at(1000 + DAY) == {"b", "c"} and at(1002 + DAY) == {"b"} and at(6000 + 3 * DAY) == {"e", "f"}


def test_state_holds_live_sessions_only(spark, tmp_path):
    source = str(tmp_path / "in")
    feed(spark, source, [[(f"t{n}", "u", "login", n) for n in range(100)], [("z", "u", "login", 10 * DAY)], [("y", "u", "login", 10 * DAY + 1)], [("y2", "u", "login", 10 * DAY + 2)]])
    log = SS.ChangeLog(V.Store(spark, f"file:{tmp_path}/store"), "s")
    q = SS.session_changes(stream_of(spark, source)).writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) >= 100 and held[-1] <= 3


def test_sessions_are_followed_in_groups(spark, tmp_path):
    """However many tokens there are, the state has a row a group; every token goes its own way in it."""
    rng, source = random.Random(5), str(tmp_path / "in")
    data = sorted((rng.randrange(3 * DAY), f"t{rng.randrange(60)}", "u", rng.choice(["login", "login", "logout"])) for _ in range(400))
    feed(spark, source, [[(t, u, k, s) for s, t, u, k in data[:200]], [(t, u, k, s) for s, t, u, k in data[200:]], [("end", "u", "login", 9 * DAY)], [("end2", "u", "login", 9 * DAY + 1)], [("end3", "u", "login", 9 * DAY + 2)]])
    log = SS.ChangeLog(V.Store(spark, f"file:{tmp_path}/store"), "s")
    q = SS.session_changes(stream_of(spark, source), groups=3).writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) == 3
    want, live = [], {}
    for s, t, _, k in sorted(data, key=lambda d: (d[0], d[3])):
        if t in live and live[t] + DAY <= s:
            want.append((t, "expired", float(live.pop(t) + DAY)))
        if k == "login" and t not in live:
            live[t] = s
            want.append((t, "opened", float(s)))
        elif k == "logout" and t in live:
            del live[t]
            want.append((t, "closed", float(s)))
    want += [(t, "expired", float(s + DAY)) for t, s in live.items()]
    assert [c for c in changes_of(log) if not c[0].startswith("end")] == sorted(want)


# ---------------------------------------------------------------- schemas and migrations


def old_movies(spark):
    return spark.createDataFrame([(1, "b.mkv", "b", 1, 5, "B"), (1, "a.mkv", "a", 0, None, None)], "library_id long, file_path string, clean_name string, is_present int, tmdb_id long, title string")


def test_migration_runs_once(spark, tmp_path):
    store = V.Store(spark, f"file:{tmp_path}/store")
    with store.begin() as tx:
        tx.create("movies", old_movies(spark), ["library_id", "file_path"])
        tx.create("playback_logs", spark.createDataFrame([(1, "u", 2.0)], "id long, username string, position double"))
        tx.create("playback_progress", spark.createDataFrame([("u", 1.0)], "username string, position double"), ["username"])
        tx.create("movie_metadata", spark.createDataFrame([(1, "a.mkv", 9, "A"), (1, "c.mkv", 8, "C"), (1, "c.mkv", 8, "C")], "library_id long, file_path string, tmdb_id long, title string"))
        tx.create("library_files", spark.createDataFrame([("x",)], "file_path string"))
    assert SM.migrate(store) and store.versions() == [1, 2]
    assert store.tables() == sorted(SM.TABLES)
    got = [(r.id, r.file_path, r.clean_name, r.is_present, r.tmdb_id, r.title, r.file_size) for r in store.read("movies").orderBy("id").collect()]
    assert got == [(1, "a.mkv", "a", 0, None, None, 0), (2, "b.mkv", "b", 1, 5, "B", 0), (3, "c.mkv", "", 1, 8, "C", 0)]
    assert store.read("playback_logs").count() == 0 and SM.column_exists(store, "playback_logs", "movie_id") and not SM.table_exists(store, "library_files")
    before = {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in store.tables()}
    assert not SM.migrate(store) and store.versions() == [1, 2]
    assert {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in store.tables()} == before
    for name in SM.TABLES:
        assert store.read(name).columns == SM.schema(name).fieldNames()


def test_new_store_and_required_values(spark, tmp_path):
    store = V.Store(spark, f"file:{tmp_path}/store")
    assert SM.migrate(store) and store.tables() == sorted(SM.TABLES) and all(store.read(t).count() == 0 for t in SM.TABLES)
    rows = SM.conformed(spark.createDataFrame([(1, "n", "/p", "Movies", 1, 2, "extra"), (2, None, "/q", "Shows", 1, None, "extra")], "id long, name string, path string, type string, created_at long, updated_at long, more string"), "libraries")
    first = rows.where("id = 1").first()
    assert (first.is_enabled, first.depth_limit, first.metadata_language, first.last_scanned_at) == (1, -1, "en", None)
    assert sorted((r.id, r.broken) for r in SM.missing_values(rows, "libraries").collect()) == [(2, "name"), (2, "updated_at")]


# ---------------------------------------------------------------- writes by key


def files_of(tx, name):
    """Of each bucket its number and files."""
    fs, out = tx.store.fs(), {}
    for b, p in tx.next["tables"][name]["parts"].items():
        found = fs.listFiles(tx.store.path(p), True)
        while found.hasNext():
            f = found.next().getPath().getName()
            out.setdefault(b, []).extend([f] if f.endswith(".parquet") else [])
    return out


def test_a_scan_deals_each_side_once_and_writes_by_bucket(spark, tmp_path):
    """One shuffle of the old rows and one of the scan serve the join and the buckets: each task writes into one bucket alone."""
    store = V.Store(spark, f"file:{tmp_path}/store")
    old = spark.range(2000).select("id", (F.col("id") % 7).alias("lib"), F.concat(F.lit("f"), "id").alias("path"), F.col("id").alias("size"), F.lit(1).alias("is_present"))
    with store.begin() as tx:
        tx.create("t", old, ["lib", "path"], 4)
    scan = old.where("id % 5 <> 0").select("lib", "path", (F.col("size") + F.expr("if(id % 2 = 0, 1, 0)")).alias("size")).unionAll(spark.range(30).select(F.lit(3), F.concat(F.lit("n"), "id"), F.lit(9)))
    with store.begin() as tx:
        rows = M.scanned_over(tx.read("t"), scan, ["lib", "path"], ["size"], within=F.col("lib") < 6, dealt=tx.keyed("t"))
        assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
        tx.rewrite("t", rows, lambda new: M.number_new(new, ["lib", "path"], 5000))
        assert len(files_of(tx, "t")) == 4 and all(len(f) <= 4 for f in files_of(tx, "t").values())  # same, changed and new rows
    got = {(r.lib, r.path): (r.id, r["size"], r.is_present) for r in store.read("t").collect()}
    seen = {(r.lib, r.path): r["size"] for r in scan.collect()}
    for r in old.collect():
        key = (r.lib, r.path)
        assert got.pop(key) == ((r.id, seen.get(key, r["size"]), int(key in seen)) if r.lib < 6 else (r.id, r["size"], 1))
    assert sorted(i for i, _, _ in got.values()) == list(range(5000, 5030)) and {v[1:] for v in got.values()} == {(9, 1)}


def test_upsert_leaves_rows_that_stay_to_their_tasks(spark, tmp_path):
    store = V.Store(spark, f"file:{tmp_path}/store")
    with store.begin() as tx:
        tx.create("t", spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v")), ["id"], 4)
    met = []

    def merge(old, new):
        met.append(old.count())
        return old.join(new.withColumnRenamed("v", "w"), "id", "left").select("id", F.coalesce("w", "v").alias("v"))

    with store.begin() as tx:
        tx.upsert("t", spark.range(100).select("id", F.lit(-1).cast("long").alias("v")).where("id % 6 = 0"), merge, by_keys=True, stay=F.col("v") > 0)
    assert met == [34]
    assert {r.id: r.v for r in store.read("t").collect()} == {i: -1 if i % 6 == 0 else None if i % 3 == 0 else i for i in range(100)}


def test_reconcile_reads_its_sides_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    old = spark.createDataFrame([(1, "a", 10, 1), (2, "b", 10, 1)], "id long, k string, size long, is_present int")
    scan = spark.createDataFrame([("a", 11), ("c", 5), ("d", 6)], "k string, size long")
    out = M.reconcile(old, scan.mapInArrow(count, scan.schema), ["k"], ["size"], 100)
    assert sorted((r.k, r["size"], r.is_present, min(r.id, 100)) for r in out.collect()) == [("a", 11, 1, 1), ("b", 10, 0, 2), ("c", 5, 1, 100), ("d", 6, 1, 100)]
    assert made.value == 3


# ---------------------------------------------------------------- subtitles


def test_subtitles_are_made_once(spark, tmp_path):
    cache = SU.SubtitleCache(V.Store(spark, f"file:{tmp_path}/store"))
    made = spark.sparkContext.accumulator(0)

    def make(missing):
        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        seen = missing.mapInArrow(count, missing.schema)
        return seen.withColumn("body", F.when(F.col("media_id") == 3, None).when(F.col("media_id") == 4, "").otherwise(F.concat(F.lit("vtt "), F.col("media_id").cast("string"), F.lit(" from "), F.col("start").cast("string"))))

    wanted = spark.createDataFrame([("movie", 1, 0, 0), ("movie", 1, 0, 0), ("movie", 2, 1, 30), ("movie", 3, 0, 0), ("movie", 4, 0, 0), ("episode", 1, 0, 0)], "kind string, media_id long, track int, start int")
    answer = lambda: sorted((r.kind, r.media_id, r.start, r.body, r.source) for r in cache.answer(wanted, make).collect())
    both = [("episode", 1, 0, "vtt 1 from 0"), ("movie", 1, 0, "vtt 1 from 0"), ("movie", 1, 0, "vtt 1 from 0")]
    rest = [("movie", 2, 30, "vtt 2 from 30", "made"), ("movie", 3, 0, None, "failed"), ("movie", 4, 0, "", "made")]
    assert answer() == [*[(*b, "made") for b in both], *rest] and made.value == 5
    assert answer() == [*[(*b, "kept") for b in both], *rest] and made.value == 8
    later = spark.createDataFrame([("movie", 1, 0, 99)], "kind string, media_id long, track int, start int")
    assert [tuple(r)[3:] for r in cache.answer(later, make).select("kind", "media_id", "track", "body", "source").collect()] == [("vtt 1 from 0", "kept")] and made.value == 8


# ---------------------------------------------------------------- search


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    words = ["blue", "Blues", "été", "The", "a", "re", "mkv", "xyz", "  "]
    items = spark.createDataFrame([(n, " ".join(rng.choice(words) for _ in range(rng.randrange(5))), f"p{n % 7}/f{n}.mkv") for n in range(500)] + [(900, None, None), (901, "", "")], "id long, title string, path string")
    index = SX.SearchIndex(V.Store(spark, f"file:{tmp_path}/store"))
    index.build(items, "title", "path")
    postings = index.store.read("postings").count()
    for text in ("blue", " BLUES ", "été", "e", "", "p3/f1", "mkv", "nothing here", "lue a", "s.mkv", "f499.m"):
        index.postings_read = 0
        assert sorted(r.id for r in index.search(items, text, "title", "path").collect()) == sorted(r.id for r in C.search(items, text, "title", "path").collect()), text
        assert index.postings_read < postings / 3 or text == "mkv"
    index.search(items, "f499.m", "title", "path")
    assert 0 < index.postings_read < 60


def test_index_writes_postings_once(spark, tmp_path):
    """The postings are written into their buckets at once; how many there are of a gram is counted from what was written."""
    store, held = V.Store(spark, f"file:{tmp_path}/store"), []
    before, V.Transaction.hold = V.Transaction.hold, lambda tx, df: held.append(df) or before(tx, df)
    try:
        SX.SearchIndex(store).build(spark.createDataFrame([(1, "abcabc"), (2, "bcab"), (3, None)], "id long, title string"), "title")
    finally:
        V.Transaction.hold = before
    assert held == []
    plans, before_deal = [], V.Transaction.deal
    V.Transaction.deal = lambda tx, path, df, *more, **named: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before_deal(tx, path, df, *more, **named)
    try:
        SX.SearchIndex(V.Store(spark, f"file:{tmp_path}/dealt")).build(spark.createDataFrame([(1, "abcabc")], "id long, title string"), "title")
    finally:
        V.Transaction.deal = before_deal
    assert "REPARTITION_BY_COL" in plans[0]  # texts are dealt to all tasks before their trigrams are taken
    assert sorted(map(tuple, store.read("grams").select("gram", "n").collect())) == [("abc", 1), ("bca", 2), ("cab", 2)] and store.read("postings").count() == 5


# ---------------------------------------------------------------- settings


@pytest.mark.parametrize(
    "body,want",
    [
        ('{"port": 8080, "x": {"port": 1}}', (True, 8080, "dflt", None)), ('{"port": 0, "tmdb_access_token": "t", "tmdb_proxy": "p"}', (True, 0, "t", "p")), ('{"port": "81", "tmdb_access_token": ""}', (True, 81, "dflt", None)), ('{"port": 65536}', (False, None, None, None)),
        ('{"port": 1.5}', (False, None, None, None)), ('{"tmdb_access_token": "t"}', (False, None, None, None)), ("{", (False, None, None, None)), (None, (False, None, None, None)), ('{"port": 1, "x": "' + "y" * (1 << 20) + '"}', (False, None, None, None)),
    ],
)
def test_settings(spark, body, want):
    row = files.configs(spark.createDataFrame([(body,)], "body string"), default_token="dflt").first()
    assert (row.sound, row.port, row.tmdb_access_token, row.tmdb_proxy) == want
