"""Properties of the catalog operators."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import catalog as C
from marquee.operators import mutations as M
from marquee.operators import playback as P
from marquee.operators import scan as SC
from marquee.operators.ranking import first_value, placed, running_max
from marquee.plans.queries import ORACLE, QUERIES
from marquee.sources import files
from marquee.sources import versions as V
from marquee.sources.domain import Catalog
from marquee.streaming import events as E
from marquee.streaming import watch as WT


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reconcile_is_idempotent_and_numbers_new_rows(spark, sf):
    c = Catalog(spark, sf)
    args = (["library_id", "file_path"], ["clean_name", "file_size"], 10_000)
    once = M.reconcile(c.movies, c.scan_movies, *args)
    new = [r.id for r in once.where("id >= 10000").collect()]
    assert sorted(new) == list(range(10_000, 10_000 + len(new))) and new
    assert rows(M.reconcile(once, c.scan_movies, *args)) == rows(once)
    assert once.count() == once.select("library_id", "file_path").distinct().count()
    assert once.where("is_present = 1").count() == c.scan_movies.count()


def test_upsert_is_a_replay_of_the_log(spark, sf):
    logs = Catalog(spark, sf).playback_logs.select("username", "movie_id", "ts", "id", "position")
    state = {}
    for r in sorted(logs.collect(), key=lambda r: (r.ts, r.id)):
        state[r.username, r.movie_id] = r.position
    got = M.latest(logs, ["username", "movie_id"], "ts", "id").collect()
    assert {(r.username, r.movie_id): r.position for r in got} == state


def test_monotonic_closed_form(spark):
    rng = random.Random(1)
    xs = [rng.randrange(50) for _ in range(300)]
    want, y = [], None
    for x in xs:
        y = x if y is None else max(x, y + 1)
        want.append(y)
    df = spark.createDataFrame([(1, n + 1, x) for n, x in enumerate(xs)], "k int, n int, x int")
    assert [r.y for r in P.monotonic(df, "k", "n", "x").orderBy("n").collect()] == want


def test_heartbeats(spark):
    df = spark.createDataFrame([(1, n, float(x)) for n, x in enumerate([0, 5, 11, 12, 3, 25, 14.9])], "k int, n int, v double")
    assert [(r.n, r.reported) for r in P.heartbeats(df, ["k"], ["n"], "v").orderBy("n").collect()] == [(1, 0.0), (2, 11.0), (3, 25.0), (4, 14.9)]


def test_streaming_equals_batch(spark, sf):
    assert rows(QUERIES["t01_watch_stream"](spark, sf)) == rows(QUERIES["w03_latest_progress"](spark, sf))


def test_stream_batches_and_rejects(spark, tmp_path):
    schema = "id long, movie_id long, event_type string, ts long, position double"
    for n, data in enumerate([[(1, 5, "start", 1, 0.0), (2, None, "stop", 2, 9.0)], [(3, 5, "progress", 3, 4.0), (4, 5, "bad", 9, 7.0)], [(None, None, "start", 1, 0.0)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = E.LatestState(spark, ["movie_id"], ("ts", "id"))
    E.run_available(E.valid_events(stream), state)
    assert {(r.movie_id, r.position) for r in state.read().collect()} == {(5, 4.0), (2, 9.0)}


def test_tri_state(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 9)], "id int, tmdb_id long")
    assert [[r.id for r in df.where(p).collect()] for p in (C.MATCHED, C.PENDING, C.UNMATCHED)] == [[3], [1], [1, 2]]


def test_file_tree(spark, tmp_path):
    for p in ("Show/S01E02.x.mkv", "Show/sub/2x3.mp4", "top.mkv", ".hid/a.mkv", "Show/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    tree = files.file_tree(spark, f"file:{tmp_path}")
    assert {r.file_path for r in files.movie_files(tree).collect()} >= {"top.mkv", "Show/S01E02.x.mkv", "Show/sub/2x3.mp4"}
    got = {(r.show, r.file_path, r.season, r.episode, r.file_size) for r in files.episode_files(tree).where("show = 'Show'").collect()}
    assert got == {("Show", "S01E02.x.mkv", 1, 2, 5), ("Show", "sub/2x3.mp4", 2, 3, 5)}
    assert [r.name for r in files.listing(tree).collect()] == ["Show", "top.mkv"]


def test_json_and_forms(spark):
    df = spark.createDataFrame([("q", '{"results":[{"id":7,"title":"A","x":1},{"id":8}],"page":1}'), ("none", '{"results":[]}')], "query string, body string")
    assert [(r.query, r.pos, r.id, r.title) for r in files.search_results(df).orderBy("pos").collect()] == [("q", 0, 7, "A"), ("q", 1, 8, None)]
    one = spark.createDataFrame([("name=a+b&x=1&name=c%21",)], "b string").select(files.form_value(F.col("b"), "name"), files.form_value(F.col("b"), "name", False), files.form_value(F.col("b"), "zz")).first()
    assert tuple(one) == ("c!", "a b", None)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_queries_match_duckdb(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    norm = lambda names, data: sorted((tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(names, r))) for r in data), key=repr)
    for name, f in QUERIES.items():
        got, want = f(spark, sf), con.sql(ORACLE[name])
        assert sorted(got.columns) == sorted(want.columns), name
        assert norm(got.columns, got.collect()) == norm(want.columns, want.fetchall()), name


def test_update_from_and_insert(spark):
    from pyspark.sql import functions as F

    from marquee.operators import mutations as M

    table = spark.createDataFrame([(1, "a", 1), (2, "b", None), (None, "c", 3)], "id int, name string, n int")
    rows = spark.createDataFrame([(1, None), (9, "z")], "id int, name string")
    got = {tuple(r) for r in M.update_from(table, rows, ["id"]).collect()}
    assert got == {(1, None, 1), (2, "b", None), (None, "c", 3)}
    got = {tuple(r) for r in M.insert(table, rows, {"n": F.lit(7), "name": F.lit("unused")}).collect()}
    assert got >= {(1, None, 7), (9, "z", 7), (2, "b", None)} and len(got) == 5


def test_repeated_keys_of_new_rows(spark):
    """Of new rows that repeat a key one is added, reconciled or taken over; twins of a whole row too."""
    table = spark.createDataFrame([(1, "a", 10, 1)], "id long, k string, size long, is_present int")
    new = spark.createDataFrame([(5, "b"), (6, "b"), (7, "a"), (8, "c"), (8, "c")], "id long, k string")
    assert sorted((r.id, r.k) for r in M.insert_ignore(table.select("id", "k"), new, ["k"], "id").collect()) == [(1, "a"), (5, "b"), (8, "c")]
    assert sorted((r.id, r.outcome) for r in M.insert_reported(table.select("id", "k"), new.where("id < 8"), ["k"], "id").collect()) == [(5, "added"), (6, "duplicate"), (7, "duplicate")]
    scan = spark.createDataFrame([("a", 1, 1), ("a", 2, 9), ("z", 1, 5), ("z", 2, 4)], "k string, n int, size long")
    got = M.reconcile(table, scan, ["k"], ["size"], 100, "n").collect()
    assert sorted((r.id, r.k, r["size"]) for r in got) == [(1, "a", 9), (100, "z", 4)]
    assert [(r.id, r["size"]) for r in M.update_from(table, scan.select("k", "size"), ["k"]).collect()] == [(1, 9)]


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """A second instance keeps what the first wrote, and a batch that is repeated changes nothing."""
    from marquee.streaming import events as E

    root = str(tmp_path / "state")
    batch = lambda rows: spark.createDataFrame(rows, "k string, ts long, v long")
    E.LatestState(spark, ["k"], ("ts",), root=root)(batch([("a", 1, 1), ("b", 1, 1)]), 0)
    again = E.LatestState(spark, ["k"], ("ts",), root=root)
    again(batch([("b", 2, 2), ("c", 1, 1)]), 1)
    again(batch([("b", 2, 2), ("c", 1, 1)]), 1)
    assert sorted(map(tuple, E.LatestState(spark, ["k"], ("ts",), root=root).read().collect())) == [("a", 1, 1), ("b", 2, 2), ("c", 1, 1)]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from marquee.streaming import events as E

    source, root, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    for k in range(2):
        spark.createDataFrame([("a", k, k), (f"n{k}", k, k)], "k string, ts long, v long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, ts long, v long").parquet(source)
        E.run_available(stream, E.LatestState(spark, ["k"], ("ts",), root=root), mark)
    assert sorted(map(tuple, E.LatestState(spark, ["k"], ("ts",), root=root).read().collect())) == [("a", 1, 1), ("n0", 0, 0), ("n1", 1, 1)]


def test_posted_events(spark):
    """The item is movie_id, else id, else episode_id; required fields must be there and of their kind."""
    rest = '"event": "stop", "position": 1, "duration": 2.5'
    bodies = [
        '{"movie_id": 3, "episode_id": 4, %s}', '{"id": 5, "episode_id": 4, "other": {"id": 1}, %s}', '{"episode_id": 4, "movie_id": null, %s}', "{%s}", '{"id": 3.0, %s}', '{"id": 3.5, %s}', '{"id": "x", %s}', '{"id": 9007199254740993, %s}',
        "{no", None, '{"id": 5, "position": 1, "duration": 2}', '{"id": 5, "event": "stop", "position": null, "duration": 2}', '{"id": 5, "event": "stop", "position": true, "duration": 2}', '{"id": 5, "event": "stop", "position": 1}',
    ]
    got = files.watch_events(spark.createDataFrame([(n, b and b.replace("%s", rest)) for n, b in enumerate(bodies)], "n int, body string")).orderBy("n").collect()
    ok = [(3, None), (5, None), (None, 4), "none", (3, None), "bad", "bad", (9007199254740993, None), *["bad"] * 6]
    for r, want in zip(got, ok):
        if want in ("none", "bad"):
            assert r.answer == (files.NO_ITEM if want == "none" else files.BAD) and (r.event_type, r.movie_id, r.episode_id, r.position) == (None,) * 4, r
        else:
            assert (r.answer, r.movie_id, r.episode_id, r.event_type, r.position, r.duration) == (files.OK, *want, "stop", 1.0, 2.5), r


def test_unmatched_items_only_of_their_kind_of_library(spark):
    libraries = spark.createDataFrame([(1, "M", "Movies"), (2, "S", "Shows"), (3, "O", "Other")], "id int, name string, type string")
    movies = spark.createDataFrame([(n, lib, f"m{n}", f"n{n}", None, t, 1, 5) for n, (lib, t) in enumerate([(1, None), (1, 0), (1, 7), (2, None), (3, 0), (9, None)])], "id int, library_id int, file_path string, clean_name string, title string, tmdb_id long, is_present int, file_size long")
    shows = spark.createDataFrame([(n, lib, f"s{n}", f"t{n}", t, 1) for n, (lib, t) in enumerate([(2, 0), (1, 0), (2, None), (2, 8), (3, None)])], "id int, library_id int, path string, title string, tmdb_id long, is_present int")
    got = [(r.item_type, r.id, r.title, r.path, r.library_name, r.library_type) for r in C.unmatched(movies, shows, libraries).collect()]
    assert got == [("movie", 0, "n0", "m0", "M", "Movies"), ("movie", 1, "n1", "m1", "M", "Movies"), ("show", 0, "t0", "s0", "S", "Shows"), ("show", 2, "t2", "s2", "S", "Shows")]
    none = spark.createDataFrame([], "is_present int, file_size long")
    assert C.dashboard(movies, shows, none, libraries, libraries).first().unmatched == 4


def test_inserts_of_rows_alike_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a")], "id int, k string")
    new = spark.createDataFrame([(5, "b"), (5, "b"), (6, "a"), (7, None), (7, None), (8, None)], "id int, k string")
    assert sorted(((r.id, r.k, r.outcome) for r in M.insert_reported(table, new, ["k"], "id").collect()), key=repr) == sorted([(5, "b", "added"), (5, "b", "duplicate"), (6, "a", "duplicate"), (7, None, "added"), (7, None, "added"), (8, None, "added")], key=repr)
    assert rows(M.insert_ignore(table, new, ["k"], "id")) == sorted([(1, "a"), (5, "b"), (7, None), (7, None), (8, None)], key=repr)


def test_places_in_large_groups(spark):
    """Groups that span tasks, one that holds nearly all rows, ties, a null group."""
    rng = random.Random(5)
    data = [(rng.choice(["a"] * 30 + ["b", None]), rng.randrange(200), n) for n in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(7)
    got = {(r.g, r.v, r.id): r.place for r in placed(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    want = {}
    for g in ("a", "b", None):
        for n, row in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[row] = n
    assert got == want
    assert placed(df.limit(0), ["g"], [F.col("id")]).collect() == []
    assert sorted(r.place for r in placed(df, [], [F.col("id")], first=0).collect()) == list(range(3000))


def slow_reports(values, last=P.BEFORE, step=P.HEARTBEAT):
    out = []
    for v in values:
        if v is not None and abs(v - last) >= step:
            last = v
            out.append(v)
    return out


def test_effect_of_a_slice_on_any_last_report():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        values = np.array([float(rng.choice([rng.randrange(60), rng.random() * 60])) for _ in range(rng.randrange(1, 40))])
        bounds, exits, counts = P.slice_effect(values, 10.0)
        for last in [-100.0, *bounds, *[rng.choice([float(rng.randrange(80)), rng.random() * 80]) for _ in range(20)]]:
            at = int(bounds.searchsorted(last))
            at = 2 * at + 1 if at < len(bounds) and bounds[at] == last else 2 * at
            want = slow_reports(values, last)
            assert (last if exits[at] is None else exits[at], counts[at]) == (want[-1] if want else last, len(want))


def test_heartbeats_of_a_hot_user(spark, monkeypatch):
    """One user has most events and many slices; others have one slice, only nulls, or values that never move; a null user."""
    monkeypatch.setattr(P, "SLICE", 32)
    rng = random.Random(2)
    data = [("hot", n, rng.random() * 100) for n in range(1500)] + [("up", n, n * 0.7) for n in range(400)] + [("still", n, 5.0) for n in range(100)] + [("none", 1, None), (None, 1, 50.0), (None, 2, 55.0), (None, 3, 61.0)]
    df = spark.createDataFrame(data, "u string, n int, v double").repartition(5)
    got = {}
    for r in P.heartbeats(df, ["u"], ["n"], "v").collect():
        got.setdefault(r.u, {})[r.n] = r.reported
    want = {u: dict(enumerate(found, 1)) for u in {r[0] for r in data} if (found := slow_reports([v for w, _, v in data if w == u]))}
    assert got == want


def test_running_values_of_a_hot_medium(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.9 else rng.choice(["b", None]), n, rng.choice([None, rng.randrange(1000)])) for n in range(2000)]
    df = spark.createDataFrame(data, "k string, n int, x long").repartition(6)
    high, first = {}, {}
    for k, n, x in sorted(data, key=lambda r: r[1]):
        seen = [v for v in (high.get((k, "now")), x) if v is not None]
        high[k, "now"] = max(seen) if seen else None
        high[k, n] = high[k, "now"]
        first.setdefault(k, x)
    got = running_max(df, ["k"], [F.col("n").asc()], F.col("x"), "m")
    assert {(r.k, r.n): r.m for r in got.collect()} == {k: v for k, v in high.items() if k[1] != "now"}
    assert all(r.f == first[r.k] for r in first_value(df, ["k"], [F.col("n").asc()], F.col("x"), "f").collect())
    assert got.where("k = 'hot'").count() == sum(r[0] == "hot" for r in data)


def test_store_copies_only_what_changes(spark, tmp_path):
    store = V.Store(spark, f"file:{tmp_path}/store")
    data = spark.createDataFrame([(n, f"v{n}") for n in range(1000)], "id long, v string")
    with store.begin() as tx:
        tx.create("t", data, ["id"], 32)
    before = store.manifest()["tables"]["t"]["parts"]
    replace = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    with store.begin() as tx:
        tx.upsert("t", spark.createDataFrame([(5, "new"), (2000, "added")], "id long, v string"), replace)
    after = store.manifest()["tables"]["t"]["parts"]
    assert 1 <= len(tx.rewritten["t"]) <= 2 and sorted(int(b) for b in after if after[b] != before.get(b)) == tx.rewritten["t"]
    got = dict(map(tuple, store.read("t").collect()))
    assert got == {n: f"v{n}" for n in range(1000)} | {5: "new", 2000: "added"}
    assert store.read("t", 1).where("id = 5").first().v == "v5" and store.versions() == [1, 2]
    with store.begin() as tx:
        tx.upsert("t", data.limit(0), replace)
    assert tx.rewritten["t"] == [] and store.read("t").count() == 1001
    with pytest.raises(ValueError):
        with store.begin() as tx:
            tx.upsert("t", spark.createDataFrame([(5, "x")], "id long, v string"), lambda old, new: old.withColumn("id", F.col("id") + 1))
    assert store.versions() == [1, 2, 3] and store.vacuum(1) >= 1 and store.versions() == [3] and store.read("t").count() == 1001


def test_store_readers_see_all_or_nothing(spark, tmp_path):
    store = V.Store(spark, f"file:{tmp_path}/store")
    one = lambda v: spark.createDataFrame([(1, v)], "id long, v string")
    with store.begin() as tx:
        tx.create("a", one("old"), ["id"])
        tx.create("log", one("first"))
    held = store.read("a")
    with pytest.raises(RuntimeError, match="half way"):
        with store.begin() as tx:
            tx.create("a", one("new"), ["id"])
            assert tx.read("a").first().v == "new"
            raise RuntimeError("half way")
    assert store.read("a").first().v == "old" and store.versions() == [1] and len(store.names("data")) == 1
    first, second = store.begin(), store.begin()
    first.append("log", one("second"))
    second.append("log", one("third"))
    first.commit()
    with pytest.raises(V.Conflict):
        second.commit()
    assert sorted(r.v for r in store.read("log").collect()) == ["first", "second"] and held.first().v == "old"
    with store.begin() as tx:
        tx.compact("log")
        tx.drop("a")
    assert store.tables() == ["log"] and len(store.manifest()["tables"]["log"]["parts"]) == 1 and store.read("log").count() == 2


def scan_input(spark, movies, shows, episodes):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    return dict(movies=make(movies, "library_id int, file_path string, clean_name string, file_size long"), shows=make(shows, "library_id int, path string"), episodes=make(episodes, "library_id int, show string, file_path string, season int, episode int, file_size long"))


def test_scan_is_one_transaction(spark, tmp_path):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    store = SC.catalog_store(
        V.Store(spark, f"file:{tmp_path}/store"),
        libraries=make([(1, "M", "Movies", 1, None), (2, "S", "Shows", 1, None), (3, "X", "Movies", 0, None)], "id int, name string, type string, is_enabled int, last_scanned_at long"),
        movies=make([(10, 1, "a.mkv", "a", 1, 5, 100), (11, 1, "b.mkv", "b", 1, None, 100), (12, 3, "c.mkv", "c", 1, None, 100)], "id long, library_id int, file_path string, clean_name string, is_present int, tmdb_id long, file_size long"),
        shows=make([(20, 2, "Old", "Old", 1, 7), (21, 2, "Gone", "Gone", 1, None)], "id long, library_id int, path string, title string, is_present int, tmdb_id long"),
        episodes=make([(30, 20, "S01E01.mkv", 1, 1, 1, None, 9)], "id long, show_id long, file_path string, season int, episode int, is_present int, tmdb_id long, file_size long"),
    )
    found = scan_input(spark, [(1, "a.mkv", "a", 101), (1, "n.mkv", "n", 1), (3, "zz.mkv", "zz", 1)], [(2, "Old"), (2, "New")], [(2, "Old", "S01E01.mkv", 1, 1, 9), (2, "Old", "S01E02.mkv", 1, 2, 8), (2, "New", "1x1.mkv", 1, 1, 7)])
    broken = dict(found, episodes=found["episodes"].withColumn("season", F.raise_error(F.lit("gone")).cast("int")))
    before = {t: rows(store.read(t)) for t in store.tables()}
    with pytest.raises(Exception, match="gone"):
        SC.scan_libraries(store, F.lit(True), now=F.lit(99).cast("long"), **broken)
    assert store.versions() == [1] and {t: rows(store.read(t)) for t in store.tables()} == before
    SC.scan_libraries(store, F.lit(True), now=F.lit(99).cast("long"), **found)
    assert rows(store.read("libraries").select("id", "last_scanned_at")) == [(1, 99), (2, 99), (3, None)]
    assert rows(store.read("movies")) == [(10, 1, "a.mkv", "a", 1, 5, 101), (11, 1, "b.mkv", "b", 0, None, 100), (12, 3, "c.mkv", "c", 1, None, 100), (13, 1, "n.mkv", "n", 1, None, 1)]
    assert rows(store.read("shows")) == [(20, 2, "Old", "Old", 1, 7), (21, 2, "Gone", "Gone", 0, None), (22, 2, "New", "New", 1, None)]
    assert sorted((r.show_id, r.file_path, r.is_present) for r in store.read("episodes").collect()) == [(20, "S01E01.mkv", 1), (20, "S01E02.mkv", 1), (22, "1x1.mkv", 1)]
    again = SC.scan_libraries(store, F.lit(True), now=F.lit(99).cast("long"), **found)
    assert all(not again.rewritten[t] for t in ("movies", "shows", "episodes")) and store.versions() == [1, 2, 3]


def test_lookups_that_fail_are_due_again(spark, tmp_path):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    store = V.Store(spark, f"file:{tmp_path}/store")
    with store.begin() as tx:
        tx.create("libraries", make([(1, "Movies", "/m"), (2, "Shows", "/s")], "id int, type string, path string"), ["id"])
        tx.create("movies", make([(n, 1, 1, None, 0) for n in (1, 2, 3)], "id long, library_id int, is_present int, tmdb_id long, attempts int"), ["id"])
        tx.create("shows", make([(n, 2, 1, None, 0) for n in (5, 6)], "id long, library_id int, is_present int, tmdb_id long, attempts int"), ["id"])
        tx.create("episodes", make([(50, 5, 1, 1, 1, None, 0), (60, 6, 1, 1, 1, None, 0)], "id long, show_id long, season int, episode int, is_present int, tmdb_id long, attempts int"), ["id"])
    answers = lambda rows: make(rows, "kind string, id long, tmdb_id long")
    SC.enrich(store, answers([("movie", 1, 100), ("movie", 2, 0), ("show", 5, 500), ("episode", 50, 5000), ("episode", 60, 6000)]))
    state = lambda: {(t, r.id): (r.tmdb_id, r.attempts) for t in ("movies", "shows", "episodes") for r in store.read(t).collect()}
    assert state() == {("movies", 1): (100, 0), ("movies", 2): (0, 0), ("movies", 3): (None, 1), ("shows", 5): (500, 0), ("shows", 6): (None, 1), ("episodes", 50): (5000, 0), ("episodes", 60): (None, 0)}
    SC.enrich(store, answers([("movie", 1, 1), ("movie", 2, 2), ("movie", 3, 300), ("show", 6, 600)]))
    assert state() == {("movies", 1): (100, 0), ("movies", 2): (0, 0), ("movies", 3): (300, 1), ("shows", 5): (500, 0), ("shows", 6): (600, 1), ("episodes", 50): (5000, 0), ("episodes", 60): (None, 1)}


def test_watch_events_are_taken_once(spark, tmp_path):
    """Posted bodies over several batches, a restart between them, and a batch that is repeated after its commit."""
    source, root, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    schema = "id long, username string, ts long, body string"
    body = lambda item, event, position: '{"%s":%d,"event":"%s","position":%s,"duration":100}' % (*item, event, position)
    batches = [[(1, "u", 1, body(("movie_id", 7), "start", 1)), (2, "u", 2, body(("episode_id", 7), "start", 2)), (3, "u", 3, "{"), (4, "u", 3, body(("id", 7), "dance", 9))], [(5, "u", 5, body(("id", 7), "seek", 50)), (6, "w", 6, body(("id", 8), "stop", 4))], [(7, "u", 4, body(("movie_id", 7), "stop", 3))]]
    for data in batches:
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        sink = WT.WatchSink(spark, f"file:{root}")
        E.run_available(WT.accepted(stream), sink, mark)
    repeated = WT.accepted(spark.createDataFrame(batches[2], schema))
    WT.WatchSink(spark, f"file:{root}")(repeated, sink.store.mark("watch"))
    assert [(r.id, r.movie_id, r.event_type) for r in sink.read("playback_logs").orderBy("id").collect()] == [(1, 7, "start"), (5, 7, "seek"), (6, 8, "stop"), (7, 7, "stop")]
    assert [(r.id, r.episode_id) for r in sink.read("episode_playback_logs").collect()] == [(2, 7)]
    assert rows(sink.read("playback_progress").select("username", "movie_id", "position", "duration")) == [("u", 7, 50.0, 100.0), ("w", 8, 4.0, 100.0)]
    assert rows(sink.read("episode_playback_progress").select("username", "episode_id", "position")) == [("u", 7, 2.0)]
    versions = sink.store.versions()
    sink(repeated, 99)
    assert len(sink.store.versions()) == len(versions) + 1 and sink.read("playback_logs").count() == 5


def test_latest_state_rewrites_touched_buckets(spark, tmp_path):
    state = E.LatestState(spark, ["k"], ("ts",), root=str(tmp_path / "s"), buckets=64)
    state(spark.createDataFrame([(f"k{n}", 1, n) for n in range(500)], "k string, ts long, v long"), 0)
    before = state.store.manifest()["tables"]["state"]["parts"]
    state(spark.createDataFrame([("k7", 2, 700), ("k7", 0, 1)], "k string, ts long, v long"), 1)
    after = state.store.manifest()["tables"]["state"]["parts"]
    assert sum(after[b] != before[b] for b in before) == 1 and state.read().where("k = 'k7'").first().v == 700 and state.read().count() == 500
