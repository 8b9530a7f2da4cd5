"""The registered queries over the media catalog, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.operators import catalog as C
from marquee.operators import mutations as M
from marquee.operators import playback as P
from marquee.operators import scan as SC
from marquee.operators import search_index as SX
from marquee.operators.ranking import placed
from marquee.sources import files as S
from marquee.sources import schema as SM
from marquee.sources import subtitles as SU
from marquee.sources import versions as V
from marquee.sources.domain import Catalog, oracle
from marquee.streaming import events as E
from marquee.streaming import sessions as SS
from marquee.streaming import watch as WT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Parameters of the registered queries.
NOW = "timestamp '2024-01-15 00:00:00'"
USER = "Customer#000000007"


def query(sql: str):
    """Register a function of a Catalog under its name."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def q(text: str):
    return F.expr(text)


KEY = r"translate(case when {0} ilike 'The %' then substr({0},5) when {0} ilike 'A %' then substr({0},3) when {0} ilike 'An %' then substr({0},4) else {0} end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---------------------------------------------------------------- reads


@query("SELECT id, name, path, type, CAST(row_number() OVER (ORDER BY CASE type WHEN 'Movies' THEN 1 WHEN 'Shows' THEN 2 ELSE 3 END, name, id) AS INTEGER) AS pos FROM libraries")
def q01_libraries(c):
    ordered = C.library_order(c.libraries)
    return ordered.select("id", "name", "path", "type", F.row_number().over(W.orderBy("type_rank", "name", "id")).alias("pos"))  # one row a library


@query("SELECT * FROM libraries WHERE id = 3")
def q02_library(c):
    return c.libraries.where("id = 3")


@query(f"SELECT username, CAST(coalesce(max(is_admin), 0) AS INTEGER) AS is_admin FROM users WHERE username = '{USER}' GROUP BY username")
def q04_is_admin(c):
    return c.users.where(F.col("username") == USER).groupBy("username").agg(F.coalesce(F.max("is_admin"), F.lit(0)).cast("int").alias("is_admin"))


@query("SELECT id, username, is_admin FROM users")
def q05_users(c):
    return c.users.orderBy("id")


@query(f"SELECT token, username, is_admin FROM sessions WHERE expires_at > {NOW}")
def q06_live_sessions(c):
    return E.live(c.sessions, q(NOW)).select("token", "username", "is_admin")


@query(f"SELECT m.id, coalesce(p.position, 0.0) AS position FROM movies m LEFT JOIN (SELECT * FROM playback_progress WHERE username = '{USER}') p ON m.id = p.movie_id")
def q07_resume(c):
    return C.with_progress(c.movies.select("id"), c.playback_progress, USER).select("id", "position")


@query(f"SELECT movie_id, position, duration FROM playback_progress WHERE username = '{USER}'")
def q08_user_progress(c):
    return c.playback_progress.where(F.col("username") == USER).select("movie_id", "position", "duration")


@query("SELECT library_id, file_path FROM movies WHERE id = 42")
def q11_movie_path(c):
    return c.movies.where("id = 42").select("library_id", "file_path")


@query("SELECT title FROM shows WHERE id = 5")
def q12_show_title(c):
    return c.shows.where("id = 5").select("title")


@query("SELECT id, tmdb_id, title FROM movies WHERE tmdb_id IS NOT NULL AND tmdb_id > 0")
def q13_matched_metadata(c):
    return c.movies.where(C.MATCHED).select("id", "tmdb_id", "title")


@query(f"SELECT id, library_id, title, {KEY.format('title')} AS sort_key FROM shows WHERE is_present = 1")
def q14_show_listing(c):
    return C.listing(c.shows, F.col("title")).select("id", "library_id", "title", "sort_key")


@query(f"SELECT id, library_id, coalesce(title, clean_name) AS shown, {KEY.format('coalesce(title, clean_name)')} AS sort_key, CAST(row_number() OVER (PARTITION BY library_id ORDER BY {KEY.format('coalesce(title, clean_name)')}, id) AS INTEGER) AS pos FROM movies WHERE is_present = 1")
def q15_library_listing(c):
    """A few libraries may hold all movies, so places come from one sort by range, not from a window over a library."""
    out = C.listing(c.movies, C.display_title()).select("id", "library_id", C.display_title().alias("shown"), "sort_key")
    return placed(out, ["library_id"], [F.col("sort_key"), F.col("id")], name="pos").withColumn("pos", F.col("pos").cast("int"))


@query("SELECT id, title, path, tmdb_id FROM shows WHERE id = 7")
def q16_show_header(c):
    return c.shows.where("id = 7").select("id", "title", "path", "tmdb_id")


@query("SELECT show_id, id, season, episode, CAST(row_number() OVER (PARTITION BY show_id ORDER BY season, episode, id) AS INTEGER) AS pos FROM episodes WHERE is_present = 1")
def q17_show_episodes(c):
    w = W.partitionBy("show_id").orderBy("season", "episode", "id")
    return c.episodes.where("is_present = 1").select("show_id", "id", "season", "episode", F.row_number().over(w).alias("pos"))


@query("SELECT s.id, coalesce(l.name, 'Library') AS library FROM shows s LEFT JOIN libraries l ON s.library_id = l.id")
def q18_library_name(c):
    s, l = c.shows, c.libraries
    return s.join(l, s["library_id"] == l["id"], "left").select(s["id"], F.coalesce(l["name"], F.lit("Library")).alias("library"))


@query("SELECT id, library_id, title, tmdb_id FROM shows WHERE tmdb_id IS NOT NULL")
def q19_resolved_shows(c):
    return c.shows.where("tmdb_id is not null").select("id", "library_id", "title", "tmdb_id")


@query("SELECT id, library_id, coalesce(title, clean_name) AS shown, tmdb_id FROM movies WHERE tmdb_id IS NOT NULL")
def q20_resolved_movies(c):
    return c.movies.where("tmdb_id is not null").select("id", "library_id", C.display_title().alias("shown"), "tmdb_id")


@query("SELECT id, library_id, file_path, clean_name, coalesce(title, '') AS title, coalesce(cast(tmdb_id as varchar), '') AS tmdb_id, file_size FROM movies WHERE is_present = 1")
def q21_movie_detail(c):
    empty = F.lit("")
    return c.movies.where("is_present = 1").select("id", "library_id", "file_path", "clean_name", F.coalesce("title", empty).alias("title"), F.coalesce(F.col("tmdb_id").cast("string"), empty).alias("tmdb_id"), "file_size")


@query("SELECT id, coalesce(title, clean_name, 'Movie') AS shown FROM movies")
def q22_player_title(c):
    return c.movies.select("id", F.coalesce("title", "clean_name", F.lit("Movie")).alias("shown"))


# ---------------------------------------------------------------- joins


@query("SELECT e.id, s.library_id, s.path || '/' || e.file_path AS file_path FROM episodes e JOIN shows s ON e.show_id = s.id")
def j01_episode_info(c):
    s = c.shows.select(F.col("id").alias("show_id"), "library_id", "path")
    return c.episodes.join(s, "show_id").select("id", "library_id", F.concat_ws("/", "path", "file_path").alias("file_path"))


@query("SELECT m.id, m.clean_name FROM movies m JOIN libraries l ON m.library_id = l.id WHERE m.tmdb_id IS NULL AND m.is_present = 1 AND l.type = 'Movies'")
def j02_movies_pending(c):
    return C.pending(c.movies, c.libraries, "Movies").select("id", "clean_name")


@query("SELECT s.id, s.title FROM shows s JOIN libraries l ON s.library_id = l.id WHERE s.tmdb_id IS NULL AND s.is_present = 1 AND l.type = 'Shows'")
def j03_shows_pending(c):
    return C.pending(c.shows, c.libraries, "Shows").select("id", "title")


@query("SELECT e.id, s.tmdb_id AS show_tmdb_id, e.season, e.episode FROM episodes e JOIN shows s ON e.show_id = s.id WHERE e.tmdb_id IS NULL AND e.is_present = 1 AND s.tmdb_id > 0")
def j04_episodes_pending(c):
    return C.pending_episodes(c.episodes, c.shows)


UNMATCHED_MOVIES = "SELECT m.id, m.clean_name AS name, coalesce(m.title, m.clean_name) AS title, m.file_path AS path, l.name AS library_name, l.type AS library_type FROM movies m JOIN libraries l ON m.library_id = l.id WHERE m.is_present = 1 AND l.type = 'Movies' AND (m.tmdb_id IS NULL OR m.tmdb_id = 0)"
UNMATCHED_SHOWS = "SELECT s.id, s.title AS name, s.title, s.path, l.name AS library_name, l.type AS library_type FROM shows s JOIN libraries l ON s.library_id = l.id WHERE s.is_present = 1 AND l.type = 'Shows' AND (s.tmdb_id IS NULL OR s.tmdb_id = 0)"


@query(UNMATCHED_MOVIES)
def j05_unmatched_movies(c):
    return C.unmatched(c.movies, c.shows, c.libraries).where("item_type = 'movie'").drop("item_type")


@query(UNMATCHED_SHOWS)
def j06_unmatched_shows(c):
    return C.unmatched(c.movies, c.shows, c.libraries).where("item_type = 'show'").drop("item_type")


@query(f"SELECT 'movie' AS item_type, * FROM ({UNMATCHED_MOVIES}) m UNION ALL SELECT 'show', * FROM ({UNMATCHED_SHOWS}) s")
def set1_unmatched_union(c):
    return C.unmatched(c.movies, c.shows, c.libraries)


@query("SELECT e.id, coalesce(e.title, s.title || ' S' || e.season || 'E' || e.episode) AS shown FROM episodes e JOIN shows s ON e.show_id = s.id")
def j07_episode_titles(c):
    s = c.shows.select(F.col("id").alias("show_id"), F.col("title").alias("show_title"))
    return c.episodes.join(s, "show_id").select("id", F.coalesce("title", F.concat("show_title", F.lit(" S"), F.col("season").cast("string"), F.lit("E"), F.col("episode").cast("string"))).alias("shown"))


@query("SELECT id, CASE WHEN show_id IN (SELECT id FROM shows WHERE library_id = 4) THEN 0 ELSE is_present END AS is_present FROM episodes")
def j08_semi_presence(c):
    touched = c.shows.where("library_id = 4").select(F.col("id").alias("show_id"), F.lit(True).alias("hit"))
    return c.episodes.join(touched, "show_id", "left").select("id", F.when(F.col("hit"), 0).otherwise(F.col("is_present")).alias("is_present"))


@query(f"SELECT m.id, coalesce(p.position, 0.0) AS position, CASE WHEN p.duration > 0 THEN p.position / p.duration * 100 END AS pct FROM movies m LEFT JOIN (SELECT * FROM playback_progress WHERE username = '{USER}') p ON m.id = p.movie_id WHERE m.is_present = 1")
def j09_listing_progress(c):
    return C.with_progress(c.movies.where("is_present = 1"), c.playback_progress, USER).select("id", "position", "pct")


@query("SELECT m.id, coalesce(nullif(m.title, ''), m.clean_name) AS title, coalesce(nullif(t.title, ''), 'No description available.') AS overview FROM movies m LEFT JOIN (SELECT * FROM tmdb_results WHERE pos = 0) t ON replace(regexp_replace(m.clean_name, '[.][0-9]{4}[.]1080p$', ''), '.', ' ') = t.query")
def j10_details(c):
    t = c.tmdb_results.where("pos = 0").select("query", F.col("title").alias("found"))
    m = c.movies.withColumn("query", T.clean_title(F.col("clean_name"))).join(t, "query", "left")
    return m.select("id", F.coalesce(F.nullif("title", F.lit("")), "clean_name").alias("title"), F.coalesce(F.nullif("found", F.lit("")), F.lit("No description available.")).alias("overview"))


@query("SELECT m.id, l.path || '/' || m.file_path AS full_path, starts_with(l.path || '/' || m.file_path, l.path) AS inside FROM movies m JOIN libraries l ON m.library_id = l.id")
def j11_media_paths(c):
    full = F.concat_ws("/", "library_path", "file_path")
    return C.in_libraries(c.movies, c.libraries).select("id", full.alias("full_path"), full.startswith(F.col("library_path")).alias("inside"))


@query("SELECT c.media_id, CAST(t.t AS DOUBLE) AS t, string_agg(c.text, chr(10) ORDER BY c.cue, c.text) AS texts FROM cues c JOIN (SELECT DISTINCT media_id, cue_start + 0.5E0 AS t FROM cues) t ON c.media_id = t.media_id AND c.cue_start <= t.t AND t.t <= c.cue_end GROUP BY 1, 2")
def j12_active_cues(c):
    cues = c.cues
    return C.active_cues(cues, cues.select("media_id", (F.col("cue_start") + 0.5).alias("t")).distinct())


@query("SELECT u.id, u.username FROM users u WHERE u.username NOT IN (SELECT username FROM sessions)")
def j13_orphans(c):
    return c.users.join(c.sessions.select("username"), "username", "left_anti").select("id", "username")


@query("SELECT m.id, coalesce(t.tmdb_id, 0) AS found_id, t.title AS found_title FROM movies m JOIN libraries l ON m.library_id = l.id LEFT JOIN (SELECT * FROM tmdb_results WHERE pos = 0) t ON replace(regexp_replace(m.clean_name, '[.][0-9]{4}[.]1080p$', ''), '.', ' ') = t.query WHERE m.tmdb_id IS NULL AND m.is_present = 1 AND l.type = 'Movies'")
def j14_enrich_top1(c):
    return C.top_result(C.pending(c.movies, c.libraries, "Movies"), T.clean_title(F.col("clean_name")), c.tmdb_results).select("id", "found_id", "found_title")


# ---------------------------------------------------------------- aggregates


def count_of(name: str):
    return lambda df: df.agg(F.count(F.lit(1)).alias(name))


@query("SELECT count(*) AS n FROM users")
def a01_users(c):
    return count_of("n")(c.users)


@query(f"SELECT (SELECT count(*) FROM ({UNMATCHED_MOVIES}) m) + (SELECT count(*) FROM ({UNMATCHED_SHOWS}) s) AS n")
def a02_unmatched_count(c):
    return count_of("n")(C.unmatched(c.movies, c.shows, c.libraries))


@query("SELECT count(*) AS n FROM movies m JOIN libraries l ON m.library_id = l.id WHERE l.type = 'Movies' AND m.is_present = 1")
def a03_movie_count(c):
    return count_of("n")(C.in_libraries(c.movies.where("is_present = 1"), c.libraries, "Movies"))


@query("SELECT count(*) AS n FROM shows WHERE is_present = 1")
def a04_show_count(c):
    return count_of("n")(c.shows.where("is_present = 1"))


@query("SELECT count(*) AS n FROM episodes WHERE is_present = 1")
def a05_episode_count(c):
    return count_of("n")(c.episodes.where("is_present = 1"))


@query("SELECT count(*) AS n FROM movies m JOIN libraries l ON m.library_id = l.id WHERE l.type = 'Other' AND m.is_present = 1")
def a06_other_count(c):
    return count_of("n")(C.in_libraries(c.movies.where("is_present = 1"), c.libraries, "Other"))


@query("SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM movies WHERE is_present = 1")
def a07_movie_bytes(c):
    return c.movies.where("is_present = 1").agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


@query("SELECT CAST(greatest(0, coalesce((SELECT sum(file_size) FROM movies WHERE is_present = 1), 0) + coalesce((SELECT sum(file_size) FROM episodes WHERE is_present = 1), 0)) AS BIGINT) AS bytes")
def a08_storage(c):
    sizes = c.movies.where("is_present = 1").select("file_size").unionAll(c.episodes.where("is_present = 1").select("file_size"))
    return sizes.agg(F.greatest(F.lit(0), F.coalesce(F.sum("file_size"), F.lit(0))).cast("long").alias("bytes"))


@query("SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM movies m JOIN libraries l ON m.library_id = l.id WHERE l.type = 'Movies' AND m.is_present = 1) AS movies, (SELECT count(*) FROM movies m JOIN libraries l ON m.library_id = l.id WHERE l.type = 'Other' AND m.is_present = 1) AS others, (SELECT count(*) FROM shows WHERE is_present = 1) AS shows, (SELECT count(*) FROM episodes WHERE is_present = 1) AS episodes, (SELECT count(*) FROM movies m JOIN libraries l ON m.library_id = l.id WHERE m.is_present = 1 AND l.type = 'Movies' AND (m.tmdb_id IS NULL OR m.tmdb_id = 0)) + (SELECT count(*) FROM shows s JOIN libraries l ON s.library_id = l.id WHERE s.is_present = 1 AND l.type = 'Shows' AND (s.tmdb_id IS NULL OR s.tmdb_id = 0)) AS unmatched, CAST((SELECT sum(file_size) FROM movies WHERE is_present = 1) + (SELECT sum(file_size) FROM episodes WHERE is_present = 1) AS BIGINT) AS bytes")
def a09_dashboard(c):
    return C.dashboard(c.movies, c.shows, c.episodes, c.libraries, c.users)


@query("SELECT library_id, count(*) AS n FROM shows WHERE tmdb_id IS NULL AND is_present = 1 GROUP BY library_id")
def a10_pending_shows(c):
    return c.shows.where(f"is_present = 1 and {C.PENDING}").groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT library_id, count(*) AS n FROM movies WHERE tmdb_id IS NULL AND is_present = 1 GROUP BY library_id")
def a11_pending_movies(c):
    return c.movies.where(f"is_present = 1 and {C.PENDING}").groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT show_id, season, count(*) AS n, CAST(min(episode) AS INTEGER) AS first_episode, CAST(max(episode) AS INTEGER) AS last_episode FROM episodes WHERE is_present = 1 GROUP BY 1, 2")
def a13_season_groups(c):
    return c.episodes.where("is_present = 1").groupBy("show_id", "season").agg(F.count(F.lit(1)).alias("n"), F.min("episode").alias("first_episode"), F.max("episode").alias("last_episode"))


@query("SELECT s.id AS show_id, e.season, e.episode, e.id, CAST(CASE WHEN e.id IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY s.id ORDER BY e.season, e.episode, e.id) - 1 END AS INTEGER) AS pos FROM shows s LEFT JOIN (SELECT * FROM episodes WHERE is_present = 1) e ON s.id = e.show_id")
def a14_show_nested(c):
    nested = C.nested_shows(c.shows.select("id"), c.episodes).withColumnRenamed("id", "show_id")
    return nested.select("show_id", F.posexplode_outer("episodes").alias("pos", "e")).select("show_id", "e.season", "e.episode", "e.id", "pos")


@query("SELECT media_id, min(dts) AS low FROM packets WHERE rn <= 50 GROUP BY media_id")
def a15_first_packets(c):
    return c.packets.where("rn <= 50").groupBy("media_id").agg(F.min("dts").alias("low"))


@query("SELECT query, tmdb_id, title FROM tmdb_results WHERE pos = 0")
def o06_first_result(c):
    return c.tmdb_results.groupBy("query").agg(F.min_by("tmdb_id", "pos").alias("tmdb_id"), F.min_by("title", "pos").alias("title"))


@query("SELECT user_id, min(event_id) FILTER (event_type = 'click') AS first_click, coalesce(min(event_id) FILTER (event_type = 'click'), min(event_id)) AS chosen FROM events GROUP BY user_id")
def o08_first_match(c):
    click = F.col("event_type") == "click"
    return c.events.groupBy("user_id").agg(F.min(F.when(click, F.col("event_id"))).alias("first_click"), F.min_by("event_id", F.struct(~click, "event_id")).alias("chosen"))


@query("SELECT media_id, rn, CAST(rn + max(dts - rn) OVER (PARTITION BY media_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y FROM packets")
def w01_monotonic_dts(c):
    return P.monotonic(c.packets, "media_id", "rn", "dts").select("media_id", F.col("rn").cast("long").alias("rn"), F.col("y").cast("long").alias("y"))


@query("SELECT media_id, rn, dts - first_value(dts) OVER (PARTITION BY media_id ORDER BY rn) AS y FROM packets")
def w02_zero_base(c):
    return P.zero_based(c.packets, "media_id", "rn", "dts").select("media_id", F.col("rn").cast("long").alias("rn"), "y")


@query("SELECT username, movie_id, position, duration FROM playback_progress")
def w03_latest_progress(c):
    logs = c.playback_logs.select("username", "movie_id", "ts", "id", "position", "duration")
    return M.latest(logs, ["username", "movie_id"], "ts", "id").select("username", "movie_id", "position", "duration")


@query("SELECT show_id, count(*) FILTER (changed) AS headers FROM (SELECT show_id, season <> coalesce(lag(season) OVER (PARTITION BY show_id ORDER BY season, episode, id), -1) AS changed FROM episodes WHERE is_present = 1) x GROUP BY show_id")
def w04_season_headers(c):
    w = W.partitionBy("show_id").orderBy("season", "episode", "id")
    e = c.episodes.where("is_present = 1").withColumn("changed", F.col("season") != F.coalesce(F.lag("season").over(w), F.lit(-1)))
    return e.groupBy("show_id").agg(F.count_if("changed").alias("headers"))


# ---------------------------------------------------------------- row functions

BASE = "regexp_extract(file_path, '[^/]*$')"
NUM = "coalesce(try_cast(nullif(regexp_extract({0}, '{1}', {2}), '') AS INTEGER), 0)"
SE = lambda n, k: f"CASE WHEN regexp_matches({n}, '{T.SEASON_EPISODE}') THEN {NUM.format(n, T.SEASON_EPISODE, k)} WHEN regexp_matches({n}, '{T.CROSS}') THEN {NUM.format(n, T.CROSS, k)} ELSE 0 END"


@query(f"SELECT id, regexp_matches(file_path, '[.](mkv|mp4|avi|ts|webm|mov)$') AS video, regexp_replace({BASE}, '^(.+)[.][^.]*$', '\\1') AS bare FROM movies")
def s01_video_filter(c):
    return c.movies.select("id", T.is_video(F.col("file_path")).alias("video"), T.without_extension(T.basename(F.col("file_path"))).alias("bare"))


@query(f"SELECT id, {SE('file_path', 1)} AS season, {SE('file_path', 2)} AS episode FROM episodes")
def s03_season_episode(c):
    return c.episodes.select("id", T.season(F.col("file_path")).alias("season"), T.episode(F.col("file_path")).alias("episode"))


CROSSED = "cast(season as varchar) || 'x' || cast(episode as varchar) || '.' || cast(id as varchar)"


@query(f"SELECT id, {SE(CROSSED, 1)} AS season, {SE(CROSSED, 2)} AS episode FROM episodes")
def s04_cross_form(c):
    name = F.concat(F.col("season").cast("string"), F.lit("x"), F.col("episode").cast("string"), F.lit("."), F.col("id").cast("string"))
    return c.episodes.select("id", T.season(name).alias("season"), T.episode(name).alias("episode"))


@query(f"SELECT id, try_cast(nullif(regexp_extract(clean_name, '{T.YEAR}', 1), '') AS INTEGER) AS year FROM movies")
def s05_year(c):
    return c.movies.select("id", T.year(F.col("clean_name")).alias("year"))


PRE = f"CASE WHEN regexp_extract(clean_name, '{T.YEAR}', 1) <> '' THEN regexp_replace(substr(clean_name, 1, instr(clean_name, regexp_extract(clean_name, '{T.YEAR}', 1)) - 1), '[ .(\\[\\-]+$', '') ELSE clean_name END"


@query(f"SELECT id, translate(regexp_replace(regexp_replace({PRE}, '^[ \\t\\r\\n.\\-_]+', ''), '[ \\t\\r\\n.\\-_]+$', ''), '._', '  ') AS title FROM movies")
def s06_clean_title(c):
    return c.movies.select("id", T.clean_title(F.col("clean_name")).alias("title"))


@query(f"SELECT id, {KEY.format('title')} AS sort_key FROM movies WHERE title IS NOT NULL")
def s07_sort_key(c):
    return c.movies.where("title is not null").select("id", T.title_key(F.col("title")).alias("sort_key"))


UNIT = "CASE WHEN file_size >= 1099511627776 THEN {0} WHEN file_size >= 1073741824 THEN {1} WHEN file_size >= 1048576 THEN {2} WHEN file_size >= 1024 THEN {3} ELSE {4} END"


@query("SELECT id, " + UNIT.format("'TB'", "'GB'", "'MB'", "'KB'", "'B'") + " AS unit, " + UNIT.format("floor(file_size / 1099511627776.0e0 * 10)", "floor(file_size / 1073741824.0e0 * 10)", "floor(file_size / 1048576.0e0 * 10)", "floor(file_size / 1024.0e0 * 10)", "floor(file_size * 10.0e0)") + "::BIGINT AS tenths FROM movies")
def s10_bytes(c):
    n = F.col("file_size")
    scale = F.lit(1.0)
    for _, bits, _ in reversed(T.BYTE_UNITS):
        scale = F.when(n >= 1 << bits, float(1 << bits)).otherwise(scale)
    return c.movies.select("id", T.byte_unit(n).alias("unit"), F.floor(n / scale * 10).cast("long").alias("tenths"))


MS = "CAST(floor(greatest(cue_end, 0.0E0) * 1000) AS BIGINT)"


@query(f"SELECT media_id, cue, lpad(cast({MS} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({MS} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({MS} // 1000 % 60 as varchar), 2, '0') || '.' || lpad(cast({MS} % 1000 as varchar), 3, '0') AS stamp FROM cues")
def s11_vtt_time(c):
    return c.cues.select("media_id", "cue", T.vtt_time(F.col("cue_end")).alias("stamp"))


@query("SELECT media_id, cue, cue_start AS back FROM cues")
def s12_parse_time(c):
    return c.cues.select("media_id", "cue", T.parse_vtt_time(T.vtt_time(F.col("cue_start"))).alias("back"))


@query("SELECT media_id, cue_start AS start_s, text FROM cues")
def s13_parse_vtt(c):
    """Cues written as one WebVTT text for each medium and read back."""
    block = F.concat(T.vtt_time(F.col("cue_start")), F.lit(" --> "), T.vtt_time(F.col("cue_end")), F.lit("\n"), F.col("text"))
    body = c.cues.groupBy("media_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.sort_array(F.collect_list(block)), "\n\n")).alias("body"))
    return body.select("media_id", F.explode(T.vtt_cues(F.col("body"))).alias("x")).select("media_id", F.col("x.start").alias("start_s"), "x.text")


@query("SELECT conv_id, turn, role || chr(10) || cast(turn as varchar) || ' ' AS text FROM conversations")
def s14_clean_ass(c):
    line = F.concat(F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\i1}"), "role", F.lit("{\\i0}\\N"), F.col("turn").cast("string"), F.lit("\\h"))
    return c.conversations.select("conv_id", "turn", T.clean_ass(line).alias("text"))


@query("SELECT media_id, cue, cue_start + CASE WHEN cue_end - cue_start - 1.5E0 <= 0 THEN 3.0E0 ELSE cue_end - cue_start - 1.5E0 END AS cue_to FROM cues")
def s15_cue_interval(c):
    return c.cues.select("media_id", "cue", T.cue_end(F.col("cue_start"), F.col("cue_end") - F.col("cue_start") - 1.5).alias("cue_to"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def s16_percent(c):
    return c.pages.select("page_id", T.percent_encode(F.col("url")).alias("encoded"))


@query("SELECT page_id, url_decode(url_encode(url)) AS decoded FROM pages")
def s18_decode(c):
    return c.pages.select("page_id", F.try_url_decode(T.percent_encode(F.col("url"))).alias("decoded"))


@query("SELECT id, '<a href=\"/details?id=' || cast(id as varchar) || '\">' || coalesce(title, clean_name) || '</a>__NONE__' AS html FROM movies")
def s19_template(c):
    return c.movies.select("id", T.render(F.lit('<a href="/details?id=__ID__">__TITLE__</a>__NONE__'), {"ID": F.col("id").cast("string"), "TITLE": C.display_title()}).alias("html"))


def nested(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, {a}, {b})"
    return column


@query("SELECT page_id, md5(" + nested("html", (("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'"), ("chr(39)", "'&#39;'"))) + ") AS h FROM pages")
def s20_html(c):
    return c.pages.select("page_id", F.md5(T.escape_html(F.col("html"))).alias("h"))


@query("SELECT page_id, md5(" + nested("html", (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(39)", "'\\' || chr(39)"), ("'<'", "'\\u003c'"), ("'>'", "'\\u003e'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"))) + ") AS h FROM pages")
def s21_js(c):
    return c.pages.select("page_id", F.md5(T.escape_js(F.col("html"))).alias("h"))


@query("SELECT doc_id, md5(" + nested("text", (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"))) + ") AS h FROM documents")
def s22_json(c):
    return c.documents.select("doc_id", F.md5(T.escape_json(F.col("text"))).alias("h"))


@query("SELECT page_id, try_cast(nullif(regexp_extract(url, '[?](?:[^#]*&)?page=([0-9]+)(?:&|$)', 1), '') AS BIGINT) AS page FROM pages")
def s23_query_param(c):
    return c.pages.select("page_id", T.query_int(F.col("url"), "page").alias("page"))


@query("SELECT id, cast(cast(floor(position) as bigint) // 60 as varchar) || ':' || lpad(cast(cast(floor(position) as bigint) % 60 as varchar), 2, '0') AS shown FROM playback_logs")
def s24_minutes(c):
    return c.playback_logs.select("id", T.minutes(F.col("position")).alias("shown"))


@query("SELECT id, CASE WHEN id % 1000 < file_size % 700 THEN id % 1000 END AS first, CASE WHEN id % 1000 < file_size % 700 THEN least(id % 1000 + 99, file_size % 700 - 1) END AS last FROM movies")
def s25_range(c):
    a, size = F.col("id") % 1000, F.col("file_size") % 700
    r = T.byte_range(F.concat(F.lit("bytes="), a.cast("string"), F.lit("-"), (a + 99).cast("string")), size)
    return c.movies.select("id", r["first"].alias("first"), r["last"].alias("last"))


@query("SELECT id, greatest(CASE WHEN a > 8912896 THEN 156 WHEN a > 2228224 THEN 150 WHEN a > 983040 THEN 120 ELSE 93 END, CAST(id % 160 AS INTEGER)) AS level FROM (SELECT id, (id % 41) * 100 * ((id % 23) * 100) AS a FROM movies) x")
def s29_level(c):
    return c.movies.select("id", T.hevc_level((F.col("id") % 41) * 100, (F.col("id") % 23) * 100, (F.col("id") % 160).cast("int")).alias("level"))


@query("SELECT id, CASE WHEN id % 4 = 0 AND lower(l) NOT LIKE '%forced%' THEN l || ' (Forced)' ELSE l END AS label FROM (SELECT id, coalesce(nullif(title, ''), nullif(clean_name, ''), 'Track') AS l FROM movies) x")
def s30_track_label(c):
    return c.movies.select("id", T.track_label(F.col("title"), F.col("clean_name"), F.lit("Track"), F.col("id") % 4 == 0).alias("label"))


@query(f"SELECT id, '{T.API_BASE}search/movie?query=' || url_encode(coalesce(title, clean_name)) || CASE WHEN id % 3 = 0 THEN '' ELSE '&primary_release_year=' || cast(1950 + id % 75 as varchar) END AS url FROM movies")
def s31_urls(c):
    return c.movies.select("id", T.search_url("movie", C.display_title(), F.when(F.col("id") % 3 != 0, 1950 + F.col("id") % 75)).alias("url"))


@query("SELECT token, token AS back, upper(substr(username, 1, 1)) AS initial FROM sessions")
def s32_cookie(c):
    return c.sessions.select("token", T.cookie(F.concat(F.lit("theme=dark; session="), "token", F.lit("; x=1"))).alias("back"), T.initial(F.col("username")).alias("initial"))


@query("SELECT u.id, CASE WHEN is_admin = 1 THEN 'Admin' ELSE 'User' END AS role, CASE WHEN is_admin = 1 THEN 'Revoke Admin' ELSE 'Make Admin' END AS action FROM users u")
def s34_labels(c):
    admin = F.col("is_admin") == 1
    return c.users.select("id", F.when(admin, "Admin").otherwise("User").alias("role"), F.when(admin, "Revoke Admin").otherwise("Make Admin").alias("action"))


# ---------------------------------------------------------------- search and progress


@query("SELECT id FROM movies WHERE contains(lower(coalesce(title, clean_name) || ' ' || file_path), 'blue')")
def f01_search(c):
    return C.search(c.movies.withColumn("shown", C.display_title()), "  Blue ", "shown", "file_path").select("id")


@query("SELECT id FROM episodes WHERE contains(lower(coalesce(title, '') || ' ' || file_path), 's02e1')")
def f02_episode_search(c):
    return C.search(c.episodes.withColumn("shown", F.coalesce("title", F.lit(""))), "S02E1", "shown", "file_path").select("id")


@query("SELECT username, movie_id, CASE WHEN pct >= 1 AND pct < 95 THEN floor(pct * 10 + 0.5e0) / 10 END AS bar, position > 0 AS resume FROM (SELECT *, position / duration * 100 AS pct FROM playback_progress) x")
def f04_progress_bar(c):
    return c.playback_progress.select("username", "movie_id", P.bar(F.col("position") / F.col("duration") * 100).alias("bar"), (F.col("position") > 0).alias("resume"))


# ---------------------------------------------------------------- writes


@query("SELECT username, movie_id, position, duration FROM playback_progress")
def d05_upsert_progress(c):
    """The log in two halves: a state from the first, merged with the second."""
    logs = c.playback_logs.select("username", "movie_id", "ts", "id", "position", "duration")
    keys = ["username", "movie_id"]
    state = M.latest(logs.where("id % 2 = 0"), keys, "ts", "id")
    return M.upsert_latest(state, logs.where("id % 2 = 1"), keys, "ts", "id").select(*keys, "position", "duration")


FULL = "SELECT coalesce(m.id, 0) AS id, coalesce(m.library_id, s.library_id) AS library_id, coalesce(m.file_path, s.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN m.clean_name ELSE s.clean_name END AS clean_name, CASE WHEN s.file_path IS NULL THEN 0 ELSE 1 END AS is_present, m.tmdb_id, m.title, CASE WHEN s.file_path IS NULL THEN m.file_size ELSE s.file_size END AS file_size FROM movies m FULL JOIN scan_movies s ON m.library_id = s.library_id AND m.file_path = s.file_path"


def reconciled(c):
    first = 10_000_000_000
    return M.reconcile(c.movies, c.scan_movies, ["library_id", "file_path"], ["clean_name", "file_size"], first)


@query(FULL)
def d14_reconcile(c):
    """Ids of new rows are checked by tests; here they show as 0."""
    out = reconciled(c)
    return out.withColumn("id", F.when(F.col("id") >= 10_000_000_000, 0).otherwise(F.col("id")).cast("long"))


@query("SELECT id, library_id, file_path, file_size FROM (" + FULL + ") x WHERE id > 0 AND is_present = 1")
def d07_upsert_movies(c):
    return reconciled(c).where("id < 10000000000 and is_present = 1").select("id", "library_id", "file_path", "file_size")


@query("SELECT id, CASE WHEN tmdb_id IS NULL THEN 0 ELSE tmdb_id END AS tmdb_id FROM movies")
def d11_mark_unmatched(c):
    return M.update(c.movies, F.col("tmdb_id").isNull(), tmdb_id=F.lit(0).cast("long")).select("id", "tmdb_id")


@query("SELECT id, CASE WHEN show_id % 3 = 0 THEN NULL ELSE tmdb_id END AS tmdb_id, CASE WHEN show_id % 3 = 0 THEN NULL ELSE title END AS title FROM episodes")
def d12_reset_metadata(c):
    return M.update(c.episodes, F.col("show_id") % 3 == 0, tmdb_id=F.lit(None).cast("long"), title=F.lit(None).cast("string")).select("id", "tmdb_id", "title")


@query("SELECT id, username, CASE WHEN id % 7 = 0 THEN CASE WHEN is_admin = 1 THEN 0 ELSE 1 END ELSE is_admin END AS is_admin FROM users")
def d16_toggle_admin(c):
    return M.update(c.users, F.col("id") % 7 == 0, is_admin=F.when(F.col("is_admin") == 1, 0).otherwise(1))


@query(f"SELECT token, username FROM sessions WHERE NOT (expires_at <= {NOW})")
def d17_purge_sessions(c):
    return M.delete(c.sessions, q(f"expires_at <= {NOW}")).select("token", "username")


@query("SELECT id, username FROM users UNION ALL SELECT 1000000 + s.s_suppkey, s.s_name FROM supplier s WHERE s.s_name NOT IN (SELECT username FROM users)")
def set2_insert_ignore(c):
    new = c.supplier.select((F.lit(1000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("username"))
    return M.insert_ignore(c.users.select("id", "username"), new, ["username"])


@query("SELECT id, CASE WHEN event_type NOT IN ('start', 'stop', 'seek', 'progress') THEN 'event_type' ELSE 'position' END AS broken FROM playback_logs WHERE event_type NOT IN ('start', 'stop', 'seek', 'progress') OR position > duration")
def d20_checks(c):
    checks = {"event_type": F.col("event_type").isin(*E.EVENT_TYPES), "position": F.col("position") <= F.col("duration")}
    return M.violations(c.playback_logs, checks).select("id", "broken")


@query("SELECT username, episode_id, position, duration FROM episode_playback_progress")
def d06_upsert_episode_progress(c):
    logs = c.episode_playback_logs.select("username", "episode_id", "ts", "id", "position", "duration")
    keys = ["username", "episode_id"]
    return M.upsert_latest(M.latest(logs.where("id % 3 = 0"), keys, "ts", "id"), logs.where("id % 3 <> 0"), keys, "ts", "id").select(*keys, "position", "duration")


@query(f"SELECT episode_id, position, duration FROM episode_playback_progress WHERE username = '{USER}'")
def q10_user_episode_progress(c):
    return c.episode_playback_progress.where(F.col("username") == USER).select("episode_id", "position", "duration")


@query("SELECT coalesce(o.id, 0) AS id, coalesce(o.library_id, s.library_id) AS library_id, coalesce(o.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'Matched ' || o.title ELSE s.path END AS title, CASE WHEN s.path IS NULL THEN 0 ELSE 1 END AS is_present, o.tmdb_id FROM shows o FULL JOIN scan_shows s ON o.library_id = s.library_id AND o.path = s.path")
def d08_upsert_shows(c):
    """A rescan puts the folder's name back in place of a matched title; ids of new rows show as 0."""
    old = c.shows.withColumn("title", F.concat(F.lit("Matched "), "title"))
    out = M.reconcile(old, c.scan_shows.withColumn("title", F.col("path")), ["library_id", "path"], ["title"], 10_000_000_000)
    return out.withColumn("id", F.when(F.col("id") >= 10_000_000_000, 0).otherwise(F.col("id")).cast("long"))


@query("SELECT coalesce(o.id, 0) AS id, coalesce(o.show_id, s.show_id) AS show_id, coalesce(o.file_path, s.file_path) AS file_path, CAST(CASE WHEN s.file_path IS NULL THEN o.season ELSE s.season END AS BIGINT) AS season, CAST(CASE WHEN s.file_path IS NULL THEN o.episode ELSE s.episode END AS BIGINT) AS episode, CASE WHEN s.file_path IS NULL THEN 0 ELSE 1 END AS is_present, o.title, CASE WHEN s.file_path IS NULL THEN o.file_size ELSE s.file_size END AS file_size FROM episodes o FULL JOIN scan_episodes s ON o.show_id = s.show_id AND o.file_path = s.file_path")
def d09_upsert_episodes(c):
    c = c.written("episodes")
    out = M.reconcile(c.episodes, c.scan_episodes, ["show_id", "file_path"], ["season", "episode", "file_size"], 10_000_000_000)
    number = F.when(F.col("id") >= 10_000_000_000, 0).otherwise(F.col("id")).cast("long")
    return out.select(number.alias("id"), "show_id", "file_path", F.col("season").cast("long").alias("season"), F.col("episode").cast("long").alias("episode"), "is_present", "title", "file_size")


@query("SELECT m.id, CASE WHEN r.tmdb_id IS NOT NULL THEN r.tmdb_id ELSE m.tmdb_id END AS tmdb_id, CASE WHEN r.tmdb_id IS NOT NULL THEN r.title ELSE m.title END AS title FROM movies m LEFT JOIN tmdb_results r ON m.tmdb_id IS NULL AND r.pos = 0 AND r.query = replace(substr(m.clean_name, 1, length(m.clean_name) - 11), '.', ' ')")
def d10_save_metadata(c):
    """Pending movies take id and title of the first result for their clean title."""
    pending = c.movies.where("tmdb_id is null").select("id", T.clean_title(F.col("clean_name")).alias("clean"))
    found = C.top_result(pending, F.col("clean"), c.tmdb_results).where("found_id > 0").select("id", F.col("found_id").alias("tmdb_id"), F.col("found_title").alias("title"))
    return M.update_from(c.movies.select("id", "tmdb_id", "title"), found, ["id"])


@query("SELECT id, CASE WHEN show_id IN (SELECT id FROM shows WHERE library_id = 4) THEN 0 ELSE is_present END AS is_present FROM episodes")
def d13_clear_presence(c):
    """Before a scan, the episodes of one library count as absent."""
    shows = c.shows.where("library_id = 4").select(F.col("id").alias("show_id"), F.lit(0).alias("is_present"))
    return M.update_from(c.episodes.select("id", "show_id", "is_present"), shows, ["show_id"]).select("id", "is_present")


@query("SELECT id, name, path, type, CAST(NULL AS INTEGER) AS is_enabled, CAST(NULL AS INTEGER) AS depth_limit, CAST(NULL AS VARCHAR) AS metadata_language FROM libraries UNION ALL SELECT 1000000 + s_suppkey, s_name, '/media/' || s_name, 'Shows', 1, -1, 'en' FROM supplier")
def d01_insert_libraries(c):
    new = c.supplier.select((F.lit(1000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("/media/"), "s_name").alias("path"), F.lit("Shows").alias("type"))
    return M.insert(c.libraries, new, M.library_defaults()).select("id", "name", "path", "type", "is_enabled", "depth_limit", "metadata_language")


@query(f"SELECT id, CASE WHEN type <> 'Other' THEN {NOW} END AS last_scanned_at FROM libraries")
def d15_last_scanned(c):
    known = c.libraries.withColumn("last_scanned_at", q("cast(null as timestamp_ntz)"))
    return M.update(known, F.col("type") != "Other", last_scanned_at=F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "last_scanned_at")


# ---------------------------------------------------------------- more names, paths and headers


@query(r"SELECT id, regexp_replace(split_part(file_path, '/', 3), '^(.+)[.][^.]*$', '\1') AS clean FROM movies")
def s02_clean_name(c):
    return c.movies.select("id", T.without_extension(T.basename(F.col("file_path"))).alias("clean"))


@query("SELECT id, coalesce(title, split_part(file_path, '/', 3)) AS shown, coalesce(nullif(title, ''), clean_name) AS details FROM movies")
def s09_fallbacks(c):
    return c.movies.select("id", F.coalesce("title", T.basename(F.col("file_path"))).alias("shown"), F.coalesce(F.nullif("title", F.lit("")), "clean_name").alias("details"))


@query("SELECT page_id, " + nested("url", (("'%'", "'%25'"), ("' '", "'%20'"), ("'#'", "'%23'"), ("'?'", "'%3F'"), ("'&'", "'%26'"), ("'\"'", "'%22'"), ("'<'", "'%3C'"), ("'>'", "'%3E'"), ("chr(39)", "'%27'"))) + " AS href FROM pages")
def s17_path_href(c):
    return c.pages.select("page_id", T.encode_path(F.col("url")).alias("href"))


@query("""SELECT id, '{"id":' || cast(id as varchar) || ',"tmdb_id":' || coalesce(cast(tmdb_id as varchar), 'null') || '}' AS body FROM movies""")
def s27_nulls(c):
    return c.movies.select("id", F.to_json(F.struct("id", "tmdb_id"), {"ignoreNullFields": "false"}).alias("body"))


@query("SELECT id, printf('hev1.%d.%d.L%d.%02X', p, CASE p WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 1 END, id % 187, file_size % 256) AS codec FROM (SELECT id, file_size, CASE WHEN id % 6 BETWEEN 1 AND 3 THEN id % 6 ELSE 2 END AS p FROM movies) x")
def s28_codec(c):
    return c.movies.select("id", T.hevc_codec(F.col("id") % 6, F.col("id") % 187, F.col("file_size") % 256).alias("codec"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN ip_address WHEN 1 THEN '127.0.0.1' ELSE '192.168.0.1' END AS ip FROM login_logs")
def s36_client_ip(c):
    header = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    own, other = header("X-Forwarded-For", F.col("ip_address")), header("x-real-ip", F.lit("192.168.0.1"))
    host = header("Host", F.lit("media"))
    headers = F.when(F.col("id") % 3 == 0, F.array(host, own, other)).when(F.col("id") % 3 == 1, F.array(host)).otherwise(F.array(host, other, own))
    return c.login_logs.select("id", T.client_ip(headers).alias("ip"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'socks5h' ELSE 'http' END AS kind, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host, CAST(CASE WHEN page_id % 3 = 0 THEN 1080 WHEN url LIKE 'https://%' THEN 443 ELSE 80 END AS INTEGER) AS port FROM pages")
def s37_proxy(c):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "socks5://")).otherwise(F.col("url"))
    return c.pages.select("page_id", T.proxy_kind(url).alias("kind"), T.proxy_host(url).alias("host"), T.proxy_port(url).alias("port"))


@query("SELECT media_id, rn, dts * (1001.0e0 / 30000.0e0) AS seconds FROM packets")
def s38_rescale(c):
    return c.packets.select("media_id", "rn", T.rescale(F.col("dts"), 1001, 30000).alias("seconds"))


@query("SELECT library_id, min(id) AS track FROM movies WHERE id % 4 = 0 OR lower(coalesce(nullif(title, ''), 'Track')) LIKE '%forced%' GROUP BY library_id")
def o09_forced_track(c):
    """The first track of each library whose label says forced."""
    label = T.track_label(F.col("title"), F.lit(None).cast("string"), F.lit("Track"), F.col("id") % 4 == 0)
    return c.movies.where(F.lower(label).contains("forced")).groupBy("library_id").agg(F.min("id").alias("track"))


@query(f"SELECT item_type, library_name, count(*) AS n FROM (SELECT 'movie' AS item_type, library_name FROM ({UNMATCHED_MOVIES}) m UNION ALL SELECT 'show', library_name FROM ({UNMATCHED_SHOWS}) s) x GROUP BY item_type, library_name")
def a16_unmatched_lists(c):
    return C.unmatched(c.movies, c.shows, c.libraries).groupBy("item_type", "library_name").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- request bodies and answers


@query("SELECT id, username AS first_value, 'x y' AS last_value FROM users")
def src12_form_body(c):
    """A field that a form-encoded body repeats: its first and its last value."""
    body = F.concat(F.lit("name="), T.percent_encode(F.col("username")), F.lit("&admin="), F.col("is_admin").cast("string"), F.lit("&name=x+y"))
    return c.users.select("id", S.form_value(body, "name", last=False).alias("first_value"), S.form_value(body, "name").alias("last_value"))


@query("SELECT id AS movie, CAST(0 AS INTEGER) AS pos, 500000 + id AS found, coalesce(title, clean_name) AS title FROM movies UNION ALL SELECT id, 1, 700000 + id, clean_name FROM movies")
def src05_search_answers(c):
    """JSON answers of a title search, read into one row for each result."""
    result = lambda base, title: F.struct((F.lit(base) + F.col("id")).alias("id"), title.alias("title"), F.lit(1.5).alias("popularity"))
    answers = c.movies.select(F.col("id").alias("movie"), F.to_json(F.struct(F.array(result(500000, C.display_title()), result(700000, F.col("clean_name"))).alias("results"))).alias("body"))
    return S.search_results(answers).select("movie", "pos", F.col("id").alias("found"), "title")


# ---------------------------------------------------------------- lookups, scans and answers


@query(f"SELECT a.episode_id, coalesce(p.position, 0.0) AS position FROM (SELECT DISTINCT episode_id FROM episode_playback_logs) a LEFT JOIN (SELECT * FROM episode_playback_progress WHERE username = '{USER}') p ON a.episode_id = p.episode_id")
def q09_episode_resume(c):
    own = c.episode_playback_progress.where(F.col("username") == USER).select("episode_id", "position")
    return c.episode_playback_logs.select("episode_id").distinct().join(own, "episode_id", "left").select("episode_id", F.coalesce("position", F.lit(0.0)).alias("position"))


VIDEO = "regexp_matches(lower({0}), '[.](mkv|mp4|avi|ts|webm|mov)$')"


@query("SELECT file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', '') AS clean_name, file_size FROM movies WHERE " + VIDEO.format("file_path"))
def src02_walk(c):
    return S.movie_files(S.path_tree(c.movies))


@query("SELECT split_part(p, '/', 1) AS show_name, substr(p, length(split_part(p, '/', 1)) + 2) AS file_path, CAST(regexp_extract(p, 'S([0-9]+)E', 1) AS INTEGER) AS season, CAST(regexp_extract(p, 'E([0-9]+)', 1) AS INTEGER) AS episode, file_size FROM (SELECT CASE WHEN id % 5 = 0 THEN file_path ELSE 'Show ' || show_id || '/' || file_path END AS p, file_size FROM episodes) x WHERE contains(p, '/')")
def src03_two_level_walk(c):
    """Folders are shows; a file at the top is ignored."""
    path = F.when(F.col("id") % 5 == 0, F.col("file_path")).otherwise(F.concat(F.lit("Show "), F.col("show_id").cast("string"), F.lit("/"), "file_path"))
    found = S.episode_files(S.path_tree(c.episodes.withColumn("file_path", path)))
    return found.withColumnRenamed("show", "show_name").withColumns({"season": F.col("season").cast("int"), "episode": F.col("episode").cast("int")})


@query("SELECT DISTINCT n AS name FROM (SELECT split_part(CASE WHEN id % 9 = 0 THEN '.' || file_path ELSE file_path END, '/', 1) AS n FROM movies) x WHERE n NOT LIKE '.%'")
def src04_listing(c):
    hidden = F.when(F.col("id") % 9 == 0, F.concat(F.lit("."), "file_path")).otherwise(F.col("file_path"))
    return S.listing(S.path_tree(c.movies.withColumn("file_path", hidden)))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'NotFound' ELSE 'ok' END AS status, CASE WHEN id % 4 <> 0 THEN coalesce(title, clean_name) END AS title, CASE WHEN id % 4 <> 0 THEN id % 90 END AS runtime FROM movies")
def src06_movie_detail(c):
    """Answers by id; a missing one is NotFound."""
    answers = c.movies.where("id % 4 <> 0").select("id", F.to_json(F.struct(C.display_title().alias("title"), (F.col("id") % 90).alias("runtime"), F.lit("x").alias("unknown"))).alias("body"))
    return S.detail(c.movies.select("id"), answers, ["id"], "struct<title:string,runtime:bigint>")


@query("SELECT id AS show_id, CAST(0 AS INTEGER) AS pos, 700000 + id AS found, title AS name, '2001-02-03' AS first_air_date FROM shows")
def src07_show_answers(c):
    result = F.struct((F.lit(700000) + F.col("id")).alias("id"), F.col("title").alias("name"), F.lit("2001-02-03").alias("first_air_date"))
    answers = c.shows.select(F.col("id").alias("show_id"), F.to_json(F.struct(F.array(result).alias("results"))).alias("body"))
    return S.search_results(answers).select("show_id", "pos", F.col("id").alias("found"), "name", "first_air_date")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'NotFound' ELSE 'ok' END AS status, CASE WHEN id % 3 <> 0 THEN title END AS name FROM shows")
def src08_show_detail(c):
    answers = c.shows.where("id % 3 <> 0").select("id", F.to_json(F.struct(F.col("title").alias("name"))).alias("body"))
    return S.detail(c.shows.select("id"), answers, ["id"], "struct<name:string>")


@query("SELECT e.id, CASE WHEN a.show_id IS NULL THEN 'NotFound' ELSE 'ok' END AS status, 'E' || a.n AS name FROM episodes e LEFT JOIN (SELECT show_id, season, episode, min(id) AS n FROM episodes WHERE season % 2 = 0 GROUP BY show_id, season, episode) a ON e.show_id = a.show_id AND e.season = a.season AND e.episode = a.episode")
def src09_episode_detail(c):
    """Answers by show, season and episode."""
    keys = ["show_id", "season", "episode"]
    answers = c.episodes.where("season % 2 = 0").groupBy(*keys).agg(F.min("id").alias("n")).select(*keys, F.to_json(F.struct(F.concat(F.lit("E"), F.col("n").cast("string")).alias("name"))).alias("body"))
    return S.detail(c.episodes.select("id", *keys), answers, keys, "struct<name:string>").select("id", "status", "name")


#: Watch events as players post them, with every way in which a body may be refused; the same text in both engines.
NAMED = "case event_type when 'view' then 'start' when 'click' then 'progress' when 'purchase' then 'stop' else 'seek' end"
BODIES = (
    "select event_id as id, user_id, ts, chr(123) || case when event_id%17 = 0 then '' else '\"event\":\"' || " + NAMED + " || '\",' end"
    " || case when event_id%19 = 0 then '' else '\"duration\":' || cast(100+10*(event_id%30) as string) || ',' end"
    " || case event_id%6 when 0 then '\"movie_id\":' || cast(event_id%200 as string) || ',\"episode_id\":7,' when 1 then '\"id\":' || cast(event_id%200 as string) || ',\"episode_id\":8,'"
    " when 2 then '\"movie_id\":null,\"episode_id\":' || cast(event_id%300 as string) || ',' when 3 then '\"episode_id\":' || cast(event_id%300 as string) || ',\"id\":null,' when 4 then '\"id\":' || cast(event_id%200 as string) || ',\"unknown\":[1],' else '' end"
    " || case when event_id%23 = 0 then '\"position\":true' else '\"position\":' || cast(cast(round(value*100) as bigint) as string) || 'e-2' end || case when event_id%29 = 0 then '' else chr(125) end as body from events"
)
REFUSED = "id%17 = 0 OR id%19 = 0 OR id%23 = 0 OR id%29 = 0"
POSTED = (
    f"SELECT id, user_id, ts, CASE WHEN {REFUSED} THEN 'Bad Request' WHEN id%6 = 5 THEN 'Missing movie_id or episode_id' ELSE 'OK' END AS answer, kind AS event_type, CASE WHEN id%6 IN (0, 1, 4) THEN id%200 END AS movie_id,"
    f" CASE WHEN id%6 IN (2, 3) THEN id%300 END AS episode_id, CAST(CAST(round(value*100) AS BIGINT) || 'e-2' AS DOUBLE) AS position, CAST(100+10*(id%30) AS DOUBLE) AS duration FROM (SELECT event_id AS id, user_id, ts, value, {NAMED} AS kind FROM events) e"
)


@query(f"SELECT id, answer, CASE WHEN answer = 'OK' THEN event_type END AS event_type, CASE WHEN answer = 'OK' THEN movie_id END AS movie_id, CASE WHEN answer = 'OK' THEN episode_id END AS episode_id, CASE WHEN answer = 'OK' THEN position END AS position, CASE WHEN answer = 'OK' THEN duration END AS duration FROM ({POSTED}) p")
def src11_json_body(c):
    """Posted watch events: movies before episodes, and bodies that are refused: no JSON, a field missing or of the wrong kind, no item."""
    return S.watch_events(c.sql(BODIES).select("id", "body"))


ABOUT = "case when {0}tmdb_id > 0 then 'About \"' || {0}title || '\"' end"
QUOTED = "replace(coalesce({0}, ''), '\"', '\\\"')"


@query(
    f"SELECT s.id, '{{\"success\":true,\"show\":{{\"id\":' || s.id || ',\"library_id\":' || s.library_id || ',\"title\":\"' || s.title || '\",\"overview\":\"' || {QUOTED.format(ABOUT.format('s.'))} || '\",\"poster_path\":\"' || coalesce(CASE WHEN s.tmdb_id > 0 THEN '/s' || s.id || '.jpg' END, '')"
    " || '\",\"backdrop_path\":\"\",\"tmdb_id\":\"' || coalesce(cast(s.tmdb_id as varchar), '') || '\",\"episodes\":[' || coalesce(e.body, '') || ']}}' AS body FROM shows s"
    f" LEFT JOIN (SELECT show_id, string_agg('{{\"id\":' || id || ',\"season\":' || season || ',\"episode\":' || episode || ',\"title\":\"' || coalesce(title, file_path) || '\",\"overview\":\"' || {QUOTED.format(ABOUT.format(''))} || '\",\"still_path\":\"\"}}', ',' ORDER BY season, episode, id) AS body FROM episodes WHERE is_present = 1 GROUP BY show_id) e ON s.id = e.show_id"
)
def snk2_show_json(c):
    none = F.lit(None).cast("string")
    shows = c.shows.withColumns({"overview": q(ABOUT.format("")), "poster_path": q(SHOW_POSTER), "backdrop_path": none})
    return C.shows_as_json(shows, c.episodes.withColumns({"overview": q(ABOUT.format("")), "still_path": none}))


CONFIG_PORT = "case id % 7 when 0 then '8080' when 1 then '70000' when 2 then '\"9000\"' when 3 then 'null' when 4 then '80.5' when 5 then '-1' else '65535' end"
CONFIG_BODY = f"chr(123) || '\"port\":' || {CONFIG_PORT} || case id % 3 when 0 then ',\"tmdb_access_token\":\"t' || cast(id as string) || '\"' when 1 then ',\"tmdb_access_token\":\"\"' else ',\"other\":[1]' end || case when id % 2 = 0 then ',\"tmdb_proxy\":\"http://p\"' else '' end || case when id % 11 = 0 then '' else chr(125) end"


@query("SELECT id, sound, CASE WHEN sound THEN CASE id % 7 WHEN 0 THEN 8080 WHEN 2 THEN 9000 ELSE 65535 END END AS port, CASE WHEN sound THEN CASE id % 3 WHEN 0 THEN 't' || id ELSE 'default' END END AS tmdb_access_token, CASE WHEN sound AND id % 2 = 0 THEN 'http://p' END AS tmdb_proxy FROM (SELECT id, (id % 7 IN (0, 2, 6) AND id % 11 <> 0) AS sound FROM users) u")
def src10_config(c):
    return S.configs(c.users.select("id", q(CONFIG_BODY).alias("body")), default_token="default")


@query("SELECT file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', '') AS clean_name, file_size FROM (SELECT substr(file_path, 1, length(file_path) - 4) || CASE id % 9 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MKV' WHEN 2 THEN '.mp4' WHEN 3 THEN '.txt' WHEN 4 THEN '.webm' WHEN 5 THEN '' WHEN 6 THEN '.mkv.part' WHEN 7 THEN '.ts' ELSE '.mov' END AS file_path, file_size, id FROM movies) m WHERE id % 9 IN (0, 2, 4, 7, 8)")
def src02_walk_suffixes(c):
    """Files of many kinds: suffixes count as they are written, in lower case."""
    other = F.element_at(F.array(*[F.lit(x) for x in (".mkv", ".MKV", ".mp4", ".txt", ".webm", "", ".mkv.part", ".ts", ".mov")]), (F.col("id") % 9 + 1).cast("int"))
    return S.movie_files(S.path_tree(c.movies.withColumn("file_path", F.concat(F.substring("file_path", F.lit(1), F.length("file_path") - 4), other))))


@query("SELECT 'Show ' || e.show_id || '/' || e.file_path AS file_path, s.title AS show_title, e.season, e.episode FROM episodes e JOIN shows s ON e.show_id = s.id WHERE e.is_present = 1")
def src03_stored_paths(c):
    """Episodes as a scan stores them, below their show's folder, and found again by it."""
    folder = F.concat(F.lit("Show "), F.col("show_id").cast("string"))
    tree = S.path_tree(c.episodes.where("is_present = 1").withColumn("file_path", F.concat_ws("/", folder, "file_path")))
    found = S.episode_files(tree).select(F.concat_ws("/", "show", "file_path").alias("file_path"), "show", F.col("season").cast("int").alias("season"), F.col("episode").cast("int").alias("episode"))
    shows = c.shows.select(F.concat(F.lit("Show "), F.col("id").cast("string")).alias("show"), F.col("title").alias("show_title"))
    return found.join(shows, "show").drop("show")




@query("SELECT show_id, season, string_agg(cast(episode as varchar), ',' ORDER BY episode, id) AS episodes FROM episodes WHERE is_present = 1 GROUP BY show_id, season")
def a13_season_lists(c):
    """The ordered episodes of each season, of which a header and its cards are made."""
    listed = F.array_sort(F.collect_list(F.struct("episode", "id")))
    return c.episodes.where("is_present = 1").groupBy("show_id", "season").agg(F.array_join(F.transform(listed, lambda e: e["episode"].cast("string")), ",").alias("episodes"))


@query("SELECT 'filled' AS state, count(*) AS n, count(*) FILTER (username = 'admin') AS admins FROM users UNION ALL SELECT 'empty', 1, 1")
def a12_first_user(c):
    """An admin is added to an empty table of users, and to no other."""
    users = c.users.select("username")
    admin = users.limit(1).select(F.lit("admin").alias("username"))
    count = lambda df, state: df.agg(F.lit(state).alias("state"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("username") == "admin", 1)).alias("admins"))
    return count(M.insert_if_empty(users, admin), "filled").union(count(M.insert_if_empty(users.where("username is null"), admin), "empty"))


NEW_USERS = "select s_suppkey as id, s_name as username from supplier union all select 1000000 + s_suppkey, s_name from supplier where s_suppkey % 5 = 0 union all select 2000000 + c_custkey, c_name from customer where c_custkey % 9 = 0"


@query(f"SELECT n.id, n.username, CASE WHEN u.username IS NOT NULL OR row_number() OVER (PARTITION BY n.username ORDER BY n.id) > 1 THEN 'duplicate' ELSE 'added' END AS outcome FROM ({NEW_USERS}) n LEFT JOIN users u ON n.username = u.username")
def d02_insert_users(c):
    """New users, some of whose names are taken by the table or by each other: those are reported."""
    return M.insert_reported(c.users.select("id", "username"), c.sql(NEW_USERS), ["username"], "id")


@query(f"SELECT username, min(id) AS id FROM (SELECT id, username FROM users UNION ALL SELECT n.id, n.username FROM ({NEW_USERS}) n WHERE n.username NOT IN (SELECT username FROM users)) x GROUP BY username")
def set2_repeated_keys(c):
    """Of new rows that repeat a key the first is added."""
    return M.insert_ignore(c.users.select("username", "id"), c.sql(NEW_USERS).select("username", "id"), ["username"], "id")


@query("SELECT id, username FROM users u WHERE NOT (id % 2 = 0) OR username IN (SELECT username FROM sessions)")
def d17_delete_users(c):
    """A user who still has sessions stays."""
    return M.delete_unreferenced(c.users.select("id", "username"), F.col("id") % 2 == 0, "username", c.sessions).select("id", "username")


@query("SELECT username, movie_id, position FROM playback_progress WHERE NOT (movie_id % 10 = 3)")
def d17_delete_progress(c):
    return M.delete(c.playback_progress, F.col("movie_id") % 10 == 3).select("username", "movie_id", "position")


@query("SELECT 'unique' AS broken, username AS who, count(*) AS n FROM login_logs GROUP BY username HAVING count(*) > 1 UNION ALL SELECT 'reference', l.username, count(*) FROM login_logs l WHERE l.username NOT IN (SELECT username FROM users) GROUP BY l.username UNION ALL SELECT 'not null', cast(id as varchar), 1 FROM movies WHERE tmdb_id IS NULL")
def d20_keys(c):
    """UNIQUE, foreign key and NOT NULL as queries for the rows that break them."""
    repeated = M.repeated_keys(c.login_logs, ["username"]).select(F.lit("unique").alias("broken"), F.col("username").alias("who"), "n")
    lost = M.dangling(c.login_logs, "username", c.users, "username").groupBy("username").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reference"), "username", "n")
    empty = M.violations(c.movies, {"not null": F.col("tmdb_id").isNotNull()}).select("broken", F.col("id").cast("string"), F.lit(1).cast("long"))
    return repeated.union(lost).union(empty)


@query("SELECT id, username, status FROM login_logs UNION ALL SELECT 90000000 + id, username, 'success' FROM users WHERE is_admin = 1")
def d04_append_logs(c):
    new = c.users.where("is_admin = 1").select((F.lit(90000000) + F.col("id")).alias("id"), "username", F.lit("success").alias("status"))
    return M.insert(c.login_logs.select("id", "username", "status"), new, {})


SHOW_POSTER, MOVIE_POSTER = "case when tmdb_id > 0 then '/s' || cast(id as string) || '.jpg' end", "case when tmdb_id > 0 and id % 2 = 0 then '/m' || cast(id as string) || '.jpg' end"


@query(
    "SELECT l.id AS library_id, (SELECT count(*) FROM shows p WHERE p.library_id = l.id AND p.is_present = 1 AND p.tmdb_id IS NULL) AS remaining_pending, s.id, s.tmdb_id, s.title, s.poster_path FROM libraries l"
    f" LEFT JOIN (SELECT library_id, id, tmdb_id, coalesce(title, '') AS title, {SHOW_POSTER} AS poster_path FROM shows WHERE is_present = 1 AND tmdb_id IS NOT NULL) s ON s.library_id = l.id WHERE l.type = 'Shows'"
    " UNION ALL SELECT l.id, (SELECT count(*) FROM movies p WHERE p.library_id = l.id AND p.is_present = 1 AND p.tmdb_id IS NULL), m.id, m.tmdb_id, m.title, m.poster_path FROM libraries l"
    f" LEFT JOIN (SELECT library_id, id, tmdb_id, coalesce(title, clean_name, '') AS title, {MOVIE_POSTER} AS poster_path FROM movies WHERE is_present = 1 AND tmdb_id IS NOT NULL) m ON m.library_id = l.id WHERE l.type <> 'Shows'"
)
def t06_update_snapshot(c):
    """What a client that polls gets of each library: the shows or the movies that are resolved, 0 included, and how many it still waits for."""
    shows = C.updates(c.shows, c.libraries, True, F.col("title"), q(SHOW_POSTER))
    return shows.unionByName(C.updates(c.movies, c.libraries, False, C.display_title(), q(MOVIE_POSTER)))


#: Answers of the lookup service: a match, 0 where it knows nothing; no row where the lookup failed.
FOUND = "select 'movie' as kind, id, case when id % 3 = 0 then 800000 + id else 0 end as tmdb_id from movies where id % 4 <> 1 union all select 'show', id, case when id % 5 = 0 then 0 else 900000 + id end from shows where id % 3 <> 0 union all select 'episode', id, case when id % 2 = 0 then 1000000 + id else 0 end from episodes where id % 7 <> 0"


@query(f"SELECT * FROM (WITH found AS ({FOUND}), m AS (SELECT 'movie' AS kind, m.id FROM movies m JOIN libraries l ON m.library_id = l.id WHERE m.is_present = 1 AND m.tmdb_id IS NULL AND l.type = 'Movies'), s AS (SELECT 'show' AS kind, s.id FROM shows s JOIN libraries l ON s.library_id = l.id WHERE s.is_present = 1 AND s.tmdb_id IS NULL AND l.type = 'Shows'), e AS (SELECT 'episode' AS kind, e.id FROM episodes e JOIN shows s ON e.show_id = s.id LEFT JOIN s n ON s.id = n.id LEFT JOIN found f ON f.kind = 'show' AND f.id = s.id WHERE e.is_present = 1 AND e.tmdb_id IS NULL AND CASE WHEN n.id IS NOT NULL THEN f.tmdb_id ELSE s.tmdb_id END > 0) SELECT a.kind, a.id, f.tmdb_id FROM (SELECT * FROM m UNION ALL SELECT * FROM s UNION ALL SELECT * FROM e) a LEFT JOIN found f ON a.kind = f.kind AND a.id = f.id) t")
def t05_enrichment_pass(c):
    """Movies, shows, then episodes: a show that this pass matches frees its episodes; what failed stays null."""
    return C.enrichment_pass(c.movies, c.shows, c.episodes, c.libraries, c.sql(FOUND))


@query("SELECT id, username || ' x+%' AS form, username || '+x' AS login FROM users")
def s18_variants(c):
    name = T.percent_encode(F.col("username"))
    return c.users.select("id", T.decode_form(F.concat(name, F.lit("+x%2B%"))).alias("form"), T.decode_login(F.concat(name, F.lit("+x"))).alias("login"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE id / 4.0e0 END AS t FROM movies")
def s23_query_float(c):
    url = F.concat(F.lit("/stream?id="), F.col("id").cast("string"), F.lit("&t="), F.when(F.col("id") % 5 == 0, "1.5x").otherwise((F.col("id") / 4).cast("string")), F.lit("&t=7"))
    return c.movies.select("id", T.query_float(url, "t").alias("t"))


@query(f"SELECT id, '{T.API_BASE}tv/' || show_id || '/season/' || season || '/episode/' || episode AS episode, '{T.API_BASE}tv/' || show_id AS show_url, '{T.IMAGE_BASE}w500/' || file_path AS image FROM episodes")
def s31_detail_urls(c):
    return c.episodes.select("id", T.episode_url(F.col("show_id"), F.col("season"), F.col("episode")).alias("episode"), T.detail_url("tv", F.col("show_id")).alias("show_url"), T.image_url(F.concat(F.lit("/"), "file_path")).alias("image"))


@query("SELECT id, CASE type WHEN 'Movies' THEN '/assets/movies.png' WHEN 'Shows' THEN '/assets/shows.png' ELSE '/assets/other.png' END AS image FROM libraries")
def s34_artwork(c):
    return c.libraries.select("id", T.artwork(F.col("type")).alias("image"))


@query("SELECT id, CASE WHEN file_path LIKE '%.mkv' AND id % 2 = 0 THEN 'video/mp4' ELSE 'video/x-matroska' END AS kind FROM movies")
def s34_content_type(c):
    """By the suffix, whatever its case."""
    return c.movies.select("id", T.content_type(F.when(F.col("id") % 2 == 0, F.replace("file_path", F.lit(".mkv"), F.lit(".MP4"))).otherwise(F.upper("file_path"))).alias("kind"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'Forced ' || id ELSE coalesce(title, clean_name) || ' (Forced)' END ELSE coalesce(title, clean_name) END AS label FROM movies WHERE id % 3 <> 0")
def s30_text_tracks(c):
    """Picture subtitles are left out; a label that says so already gets no second mark."""
    codec = F.when(F.col("id") % 3 == 0, F.element_at(F.array(*map(F.lit, T.BITMAP_CODECS)), (F.col("id") % len(T.BITMAP_CODECS) + 1).cast("int"))).otherwise("subrip")
    title = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Forced "), F.col("id").cast("string"))).otherwise(C.display_title())
    tracks = c.movies.withColumn("codec", codec).where(~F.col("codec").isin(*T.BITMAP_CODECS))
    return tracks.select("id", T.track_label(title, F.lit(None).cast("string"), F.lit("Track"), F.col("id") % 2 == 0).alias("label"))


# ---------------------------------------------------------------- more branches of row functions


@query("SELECT s.id AS show_id, CAST(k AS INTEGER) AS pos, 700000 + 10 * s.id + k AS found, CASE WHEN k = 1 THEN NULL ELSE s.title || ' ' || k END AS name, CASE WHEN k = 2 THEN '' ELSE '2001-02-0' || (k + 1) END AS first_air_date FROM shows s, range(0, 4) r(k) WHERE k < s.id % 4")
def src07_show_results(c):
    """Answers of none to three results, of which some lack a name or a date."""
    k = lambda i: F.struct((F.lit(700000) + 10 * F.col("id") + i).alias("id"), F.when(i != 1, F.concat("title", F.lit(" "), i.cast("string"))).alias("name"), F.when(i == 2, "").otherwise(F.concat(F.lit("2001-02-0"), (i + 1).cast("string"))).alias("first_air_date"))
    results = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("id") % 4), k)
    answers = c.shows.select(F.col("id").alias("show_id"), F.to_json(F.struct(F.lit(1).alias("page"), results.alias("results"))).alias("body"))
    return S.search_results(answers).select("show_id", "pos", F.col("id").alias("found"), "name", "first_air_date")


@query("SELECT event_id AS id, event_type FROM events WHERE event_type NOT IN ('start', 'stop', 'seek', 'progress')")
def d20_event_types(c):
    """Events as they come have names that the log's constraint refuses."""
    return M.violations(c.base("events"), {"event_type": F.col("event_type").isin(*E.EVENT_TYPES)}).select(F.col("event_id").alias("id"), "event_type")


@query(
    "SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN '0,a,b,' || role || ',x' WHEN 1 THEN role || ', and more' WHEN 2 THEN role WHEN 3 THEN '1,2,3,4,5,6,7,8,' || role WHEN 4 THEN role ELSE role || chr(10) || 'next x' || chr(10) END AS text FROM conversations"
)
def s14_variants(c):
    """Events with too few commas, comments, bare event fields with and without a mark, an open override block, escapes of both cases."""
    at, role = F.col("conv_id") % 6, F.col("role")
    line = (
        F.when(at == 0, F.concat(F.lit("Dialogue: 0,a,b,"), role, F.lit(",x"))).when(at == 1, F.concat(F.lit("\t comment:\t0,1,2,3,4,5,6,7,8,"), role, F.lit(", and {\\b1}more"))).when(at == 2, F.concat(F.lit("0,0:00:01.00,0:00:02.00,Style,,0,0,0,"), role))
        .when(at == 3, F.concat(F.lit("1,2,3,4,5,6,7,8,"), role)).when(at == 4, F.concat(role, F.lit("{\\i1 open"))).otherwise(F.concat(F.lit("  "), role, F.lit("\\nnext\\Hx\\N \r\n")))
    )
    return c.conversations.select("conv_id", "turn", T.clean_ass(line).alias("text"))


@query("SELECT token, CASE WHEN is_admin = 1 THEN '' WHEN length(username) % 2 = 0 AND substr(token, 4)::BIGINT % 3 = 0 THEN NULL WHEN substr(token, 4)::BIGINT % 3 = 1 THEN token || '=c==' ELSE token END AS back FROM sessions")
def s32_variants(c):
    """Headers with the name as the end of another, twice, empty, with more signs of equality, and without the blank that separates cookies."""
    n, own = F.substring("token", 4, 20).cast("long") % 3, F.concat(F.lit("session="), "token")
    none = (F.length("username") % 2 == 0) & (n == 0)
    header = F.when(F.col("is_admin") == 1, "a=b; session=; session=x").when(none, F.concat(F.lit("theme=x;"), own)).when(n == 1, F.concat(F.lit("mysession=no; "), own, F.lit("=c=="))).otherwise(F.concat(own, F.lit("; session=other")))
    return c.sessions.select("token", T.cookie(header).alias("back"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN ip_address || ', 10.9.9.9' WHEN 1 THEN '' WHEN 2 THEN '127.0.0.1' ELSE ip_address END AS ip FROM login_logs")
def s36_variants(c):
    """Names in any case, a list of addresses as it is, an empty value, no header at all."""
    header = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    ip, kinds = F.col("ip_address"), "array<struct<name:string,value:string>>"
    at = F.col("id") % 4
    headers = (
        F.when(at == 0, F.array(header("X-FORWARDED-FOR", F.concat(ip, F.lit(", 10.9.9.9"))))).when(at == 1, F.array(header("x-real-IP", F.lit("")), header("x-forwarded-for", ip))).when(at == 2, F.array().cast(kinds)).otherwise(F.array(header("x-real", F.lit("1.1.1.1")), header("X-Real-Ip", ip)))
    )
    return c.login_logs.select("id", T.client_ip(headers).alias("ip"))


# ---------------------------------------------------------------- transactions

#: What a scan of all Movies and Other libraries, and of all Shows libraries, finds: new shows have one episode each.
SCANNED_EPISODES = "select scan_shows.library_id, scan_shows.path as show, scan_episodes.file_path, scan_episodes.season, scan_episodes.episode, scan_episodes.file_size from scan_episodes join shows on scan_episodes.show_id = shows.id join scan_shows on scan_shows.library_id = shows.library_id and scan_shows.path = shows.path union all select library_id, path, 'S01E02.first.mkv', 1, 2, 7 from scan_shows where path like 'new/%'"
STORED = "SELECT 'library' AS kind, name AS parent, path, 1 AS is_present, id AS known_id, CAST(NULL AS BIGINT) AS file_size FROM libraries UNION ALL SELECT 'movie', CAST(library_id AS VARCHAR), file_path, is_present, id, file_size FROM movies UNION ALL SELECT 'show', CAST(library_id AS VARCHAR), path, is_present, id, NULL FROM shows UNION ALL SELECT 'episode', CAST(show_id AS VARCHAR), file_path, is_present, id, file_size FROM episodes"


def stored(store, known: str = "id"):
    """The four tables of a store in one."""
    row = lambda t, kind, parent, path, size=F.lit(None).cast("long"), present=F.col("is_present"): store.read(t).select(F.lit(kind).alias("kind"), F.col(parent).cast("string").alias("parent"), F.col(path).alias("path"), present.alias("is_present"), q(known).cast("long").alias("known_id"), size.alias("file_size"))
    return row("libraries", "library", "name", "path", present=F.lit(1)).unionAll(row("movies", "movie", "library_id", "file_path", F.col("file_size"))).unionAll(row("shows", "show", "library_id", "path")).unionAll(row("episodes", "episode", "show_id", "file_path", F.col("file_size")))


def scannable(c):
    """A store of the catalog as it is, and the arguments of a scan of all its libraries, as views over the store's first version."""
    store = SC.catalog_store(V.Store(c.spark), libraries=c.libraries.withColumn("last_scanned_at", F.lit(None).cast("timestamp")), movies=c.movies, shows=c.shows, episodes=c.episodes)
    c = c.over(**{name: store.read(name, 1) for name in ("movies", "shows", "episodes")})
    return store, dict(wanted=F.lit(True), movies=c.scan_movies, shows=c.scan_shows, episodes=c.sql(SCANNED_EPISODES), now=q(NOW))


@query(STORED)
def d19_scan_aborted(c):
    """A scan that fails at its last episodes, when movies and shows are written already: readers go on seeing the version before."""
    store, scan = scannable(c)
    scan["episodes"] = scan["episodes"].withColumn("file_size", F.when(F.col("file_path").isNull() | F.col("file_path").endswith(".mkv"), F.raise_error(F.lit("the disk is gone"))).otherwise(F.col("file_size")))
    try:
        SC.scan_libraries(store, **scan)
    except Exception as broken:
        if "the disk is gone" not in str(broken):
            raise
    return stored(store)


@query(
    "SELECT 'library' AS kind, name AS parent, path, 1 AS is_present, id AS known_id, CAST(NULL AS BIGINT) AS file_size FROM libraries"
    " UNION ALL SELECT 'movie', CAST(coalesce(o.library_id, n.library_id) AS VARCHAR), coalesce(o.file_path, n.file_path), CASE WHEN n.file_path IS NULL THEN 0 ELSE 1 END, coalesce(o.id, -1), coalesce(n.file_size, o.file_size) FROM (SELECT * FROM movies WHERE library_id % 3 <> 1) o FULL JOIN (SELECT * FROM scan_movies WHERE library_id % 3 <> 1) n ON o.library_id = n.library_id AND o.file_path = n.file_path"
    " UNION ALL SELECT 'show', CAST(coalesce(o.library_id, n.library_id) AS VARCHAR), coalesce(o.path, n.path), CASE WHEN n.path IS NULL THEN 0 ELSE 1 END, coalesce(o.id, -1), NULL FROM (SELECT * FROM shows WHERE library_id % 3 = 1) o FULL JOIN (SELECT * FROM scan_shows WHERE library_id % 3 = 1) n ON o.library_id = n.library_id AND o.path = n.path"
    " UNION ALL SELECT 'show', CAST(library_id AS VARCHAR), path, is_present, id, NULL FROM shows WHERE library_id % 3 <> 1"
    " UNION ALL SELECT 'episode', coalesce(o.path, n.show), coalesce(o.file_path, n.file_path), CASE WHEN n.file_path IS NULL THEN 0 ELSE 1 END, coalesce(o.id, -1), coalesce(n.file_size, o.file_size) FROM (SELECT e.*, s.library_id, s.path FROM episodes e JOIN shows s ON e.show_id = s.id WHERE s.library_id % 3 = 1) o"
    f" FULL JOIN (SELECT * FROM ({SCANNED_EPISODES}) f WHERE library_id % 3 = 1) n ON o.library_id = n.library_id AND o.path = n.show AND o.file_path = n.file_path"
    " UNION ALL SELECT 'episode', s.path, e.file_path, e.is_present, e.id, e.file_size FROM episodes e JOIN shows s ON e.show_id = s.id WHERE s.library_id % 3 <> 1"
)
def d19_scan_committed(c):
    """A whole scan; items of a kind that a library does not hold are left alone. Ids of new rows show as -1, episodes stand under their show's path."""
    store, scan = scannable(c)
    SC.scan_libraries(store, **scan)
    old = {name: store.read(name, 1).agg(F.max("id")).first()[0] or 0 for name in ("movies", "shows", "episodes")}  # ids beyond are the scan's
    out = stored(store).where("kind <> 'episode'")
    limit = F.when(F.col("kind") == "movie", old["movies"]).when(F.col("kind") == "show", old["shows"])
    out = out.withColumn("known_id", F.when((F.col("kind") == "library") | (F.col("known_id") <= limit), F.col("known_id")).otherwise(-1))
    paths = store.read("shows").select(F.col("id").alias("show_id"), F.col("path").alias("parent"))
    e = store.read("episodes").select("show_id", F.col("file_path").alias("path"), "is_present", F.when(F.col("id") <= old["episodes"], F.col("id")).otherwise(-1).cast("long").alias("known_id"), F.col("file_size").cast("long").alias("file_size"))
    episodes = e.join(paths, "show_id", "left").select(F.lit("episode").alias("kind"), F.coalesce("parent", F.col("show_id").cast("string")).alias("parent"), "path", "is_present", "known_id", "file_size")
    return out.unionByName(episodes)


@query("SELECT id, CASE WHEN id % 50 = 3 THEN 0 ELSE is_present END AS is_present, CASE WHEN id % 50 = 3 THEN 'Changed ' || coalesce(title, '') ELSE title END AS title FROM movies WHERE id % 50 <> 7 UNION ALL SELECT 1000000 + id, 1, 'New' FROM movies WHERE id % 50 = 7")
def snk3_copy_on_write(c):
    """Rows changed, removed and added by key: only the buckets that they fall in are written anew."""
    store = V.Store(c.spark)
    with store.begin() as tx:
        tx.create("movies", c.movies.select("id", "is_present", "title"), ["id"])
    hit = c.movies.where("id % 50 in (3, 7)").select("id", F.lit(0).alias("is_present"), F.concat(F.lit("Changed "), F.coalesce("title", F.lit(""))).alias("title"), (F.col("id") % 50 == 7).alias("gone"))
    new = c.movies.where("id % 50 = 7").select((F.lit(1000000) + F.col("id")).cast(c.movies.schema["id"].dataType).alias("id"), F.lit(1).alias("is_present"), F.lit("New").alias("title"), F.lit(False).alias("gone"))
    with store.begin() as tx:
        tx.upsert("movies", hit.unionAll(new), lambda old, more: old.join(more.select("id"), "id", "left_anti").unionAll(more.where("not gone").drop("gone")))
    return store.read("movies")


SECOND = "select kind, id, case when tmdb_id > 0 then tmdb_id when id % 2 = 0 then 700000 + id else 0 end as tmdb_id from (select 'movie' as kind, id, 0 as tmdb_id from movies union all select 'show', id, 900000 + id from shows union all select 'episode', id, 0 from episodes where id % 3 <> 0) x"


@query(
    f"SELECT * FROM (WITH f1 AS ({FOUND}), f2 AS ({SECOND}),"
    " m0 AS (SELECT m.id, m.tmdb_id, (m.is_present = 1 AND m.tmdb_id IS NULL AND coalesce(l.type, '') = 'Movies') AS due FROM movies m LEFT JOIN libraries l ON m.library_id = l.id),"
    " s0 AS (SELECT s.id, s.tmdb_id, (s.is_present = 1 AND s.tmdb_id IS NULL AND coalesce(l.type, '') = 'Shows') AS due FROM shows s LEFT JOIN libraries l ON s.library_id = l.id),"
    " m1 AS (SELECT m0.id, due, CASE WHEN due THEN f.tmdb_id ELSE m0.tmdb_id END AS t1, CASE WHEN due AND f.id IS NULL THEN 1 ELSE 0 END AS a1 FROM m0 LEFT JOIN f1 f ON f.kind = 'movie' AND f.id = m0.id),"
    " s1 AS (SELECT s0.id, due, CASE WHEN due THEN f.tmdb_id ELSE s0.tmdb_id END AS t1, CASE WHEN due AND f.id IS NULL THEN 1 ELSE 0 END AS a1 FROM s0 LEFT JOIN f1 f ON f.kind = 'show' AND f.id = s0.id),"
    " e1 AS (SELECT e.id, e.show_id, e.is_present, CASE WHEN e.is_present = 1 AND e.tmdb_id IS NULL AND coalesce(s1.t1, 0) > 0 THEN f.tmdb_id ELSE e.tmdb_id END AS t1, CASE WHEN e.is_present = 1 AND e.tmdb_id IS NULL AND coalesce(s1.t1, 0) > 0 AND f.id IS NULL THEN 1 ELSE 0 END AS a1 FROM episodes e LEFT JOIN s1 ON s1.id = e.show_id LEFT JOIN f1 f ON f.kind = 'episode' AND f.id = e.id),"
    " m2 AS (SELECT m1.id, CASE WHEN due AND t1 IS NULL THEN f.tmdb_id ELSE t1 END AS t2, a1 + CASE WHEN due AND t1 IS NULL AND f.id IS NULL THEN 1 ELSE 0 END AS a2 FROM m1 LEFT JOIN f2 f ON f.kind = 'movie' AND f.id = m1.id),"
    " s2 AS (SELECT s1.id, CASE WHEN due AND t1 IS NULL THEN f.tmdb_id ELSE t1 END AS t2, a1 + CASE WHEN due AND t1 IS NULL AND f.id IS NULL THEN 1 ELSE 0 END AS a2 FROM s1 LEFT JOIN f2 f ON f.kind = 'show' AND f.id = s1.id),"
    " e2 AS (SELECT e1.id, CASE WHEN e1.is_present = 1 AND t1 IS NULL AND coalesce(s2.t2, 0) > 0 THEN f.tmdb_id ELSE t1 END AS t2, a1 + CASE WHEN e1.is_present = 1 AND t1 IS NULL AND coalesce(s2.t2, 0) > 0 AND f.id IS NULL THEN 1 ELSE 0 END AS a2 FROM e1 LEFT JOIN s2 ON s2.id = e1.show_id LEFT JOIN f2 f ON f.kind = 'episode' AND f.id = e1.id)"
    " SELECT 'movie' AS kind, id, CAST(t2 AS BIGINT) AS tmdb_id, a2 AS attempts FROM m2 UNION ALL SELECT 'show', id, t2, a2 FROM s2 UNION ALL SELECT 'episode', id, t2, a2 FROM e2) t"
)
def t05_enrichment_loop(c):
    """Two passes over a store: what failed in the first is asked again in the second, and a show matched at last frees its episodes."""
    store = V.Store(c.spark)
    with store.begin() as tx:
        tx.create("libraries", c.libraries, ["id"])
        for kind in ("movies", "shows", "episodes"):
            df = getattr(c, kind).withColumns({"attempts": F.lit(0), "tmdb_id": F.col("tmdb_id").cast("long")})
            tx.create(kind, df, ["id"])
    c = c.over(**{kind: store.read(kind, 1) for kind in ("movies", "shows", "episodes")})
    for answers in (FOUND, SECOND):
        SC.enrich(store, c.sql(answers))
    whole = None
    for kind in ("movie", "show", "episode"):
        part = store.read(f"{kind}s").select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "tmdb_id", "attempts")
        whole = part if whole is None else whole.unionAll(part)
    return whole


@query(
    f"SELECT token, username, is_admin, created_at, expires_at FROM sessions WHERE expires_at > {NOW} UNION ALL SELECT 'new' || id, username, is_admin, {NOW}, {NOW} + interval '24' hour FROM users WHERE id % 40 = 0"
)
def d03_insert_sessions(c):
    """A login removes sessions that are over and adds its own, which lasts a day; a name that no user has opens none."""
    logins = c.users.where("id % 40 = 0").select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("token"), "username", "is_admin")
    strangers = c.users.where("id % 40 = 1").select(F.concat(F.lit("bad"), F.col("id").cast("string")).alias("token"), F.concat(F.lit("no "), "username").alias("username"), "is_admin")
    return M.open_sessions(c.sessions, logins.unionAll(strangers), c.users, q(NOW))


SHOW_FOUND = "select id, 900000 + id as tmdb_id, 'Show ' || cast(id as string) as title, case when id % 2 = 0 then 'Text' end as overview, '/p' || cast(id as string) as poster_path, cast(null as string) as backdrop_path from shows where id % 3 = 1"
EPISODE_FOUND = "select id, 800000 + id as tmdb_id, 'Episode ' || cast(id as string) as title, case when id % 4 = 0 then 'Text' end as overview, '/e' || cast(id as string) as still_path from episodes where id % 5 = 2"


@query(f"SELECT s.id, s.path, coalesce(f.tmdb_id, s.tmdb_id) AS tmdb_id, coalesce(f.title, s.title) AS title, CASE WHEN f.id IS NULL THEN 'old' ELSE f.overview END AS overview, coalesce(f.poster_path, 'old') AS poster_path, CASE WHEN f.id IS NULL THEN 'old' END AS backdrop_path FROM shows s LEFT JOIN ({SHOW_FOUND}) f ON s.id = f.id")
def d10_save_show_metadata(c):
    """A match writes all fields, nulls too; the date it was first shown on has no column."""
    old = F.lit("old")
    shows = c.shows.select("id", "path", F.col("tmdb_id").cast("long").alias("tmdb_id"), "title").withColumns({"overview": old, "poster_path": old, "backdrop_path": old})
    return M.update_from(shows, c.sql(SHOW_FOUND), ["id"])


@query(f"SELECT e.id, coalesce(f.tmdb_id, e.tmdb_id) AS tmdb_id, coalesce(f.title, e.title) AS title, CASE WHEN f.id IS NULL THEN 'old' ELSE f.overview END AS overview, coalesce(f.still_path, 'old') AS still_path FROM episodes e LEFT JOIN ({EPISODE_FOUND}) f ON e.id = f.id")
def d10_save_episode_metadata(c):
    old = F.lit("old")
    episodes = c.episodes.select("id", F.col("tmdb_id").cast("long").alias("tmdb_id"), "title").withColumns({"overview": old, "still_path": old})
    return M.update_from(episodes, c.sql(EPISODE_FOUND), ["id"])


@query("SELECT id, clean_name, CASE WHEN id <> 7 THEN tmdb_id END AS tmdb_id, CASE WHEN id <> 7 THEN title END AS title, CASE WHEN id <> 7 THEN 'text' END AS overview FROM movies")
def d12_reset_movie(c):
    """One movie loses what was looked up; its file stays."""
    none = F.lit(None)
    movies = c.movies.select("id", "clean_name", "tmdb_id", "title", F.lit("text").alias("overview"))
    return M.update(movies, F.col("id") == 7, tmdb_id=none.cast(movies.schema["tmdb_id"].dataType), title=none.cast("string"), overview=none.cast("string"))


OLD_METADATA = "select library_id, case when id % 2 = 0 then file_path else 'old/' || file_path end as file_path, cast(tmdb_id as bigint) as tmdb_id, title, cast(null as string) as overview, '/p' as poster_path, cast(null as string) as backdrop_path, '1999' as release_date from movies where id % 20 < 2"


def old_store(c):
    """A store of an early time: movies without ids and sizes, logs without movies, metadata in a table of their own, a list of files."""
    store = V.Store(c.spark)
    with store.begin() as tx:
        tx.create("movies", c.movies.select("library_id", "file_path", "clean_name", "is_present", F.col("tmdb_id").cast("long").alias("tmdb_id"), "title"), ["library_id", "file_path"])
        tx.create("episodes", c.episodes.select(F.col("id").cast("long"), F.col("show_id").cast("long"), "file_path", F.col("season").cast("int"), F.col("episode").cast("int"), "is_present"), ["show_id", "file_path"])
        tx.create("playback_logs", c.playback_logs.select("id", "username", "event_type", "position"))
        tx.create("movie_metadata", c.sql(OLD_METADATA))
        tx.create("library_files", c.movies.select("file_path"))
    SM.migrate(store)
    return store


NEW_MOVIES = "select library_id, 'old/' || file_path as file_path, '' as clean_name, 1 as is_present, tmdb_id, title, '/p' as poster_path, '1999' as release_date from movies where id % 20 = 1"


@query(
    "SELECT 'movie' AS kind, row_number() OVER (ORDER BY library_id, file_path) AS id, CAST(library_id AS BIGINT) AS parent, file_path, clean_name, is_present, CAST(tmdb_id AS BIGINT) AS tmdb_id, title, CAST(NULL AS VARCHAR) AS poster_path, CAST(NULL AS VARCHAR) AS release_date, CAST(0 AS BIGINT) AS file_size FROM movies"
    f" UNION ALL SELECT 'movie', (SELECT count(*) FROM movies) + row_number() OVER (ORDER BY library_id, file_path), library_id, file_path, clean_name, is_present, tmdb_id, title, poster_path, release_date, 0 FROM ({NEW_MOVIES}) n"
    " UNION ALL SELECT 'episode', id, show_id, file_path, NULL, is_present, NULL, NULL, NULL, NULL, 0 FROM episodes"
)
def d18_migrated(c):
    """An old store brought up to date: ids in the order of the keys, new columns with their defaults, old metadata taken over where the key is new."""
    store = old_store(c)
    none = lambda name: F.lit(None).cast("string").alias(name)
    movies = store.read("movies").select(F.lit("movie").alias("kind"), "id", F.col("library_id").alias("parent"), "file_path", "clean_name", "is_present", "tmdb_id", "title", "poster_path", "release_date", "file_size")
    return movies.unionAll(store.read("episodes").select(F.lit("episode"), "id", "show_id", "file_path", none("clean_name"), "is_present", "tmdb_id", "title", none("poster_path"), none("release_date"), "file_size"))


@query(
    "SELECT * FROM (VALUES ('movies', 'id', true, true), ('movies', 'file_size', true, true), ('episodes', 'still_path', true, true), ('playback_logs', 'movie_id', true, true), ('movie_metadata', 'title', false, false), ('library_files', 'file_path', false, false), ('shows', 'first_air_date', true, false)) v(table_name, column_name, has_table, has_column), (SELECT count(*) AS movies FROM movies) m"
)
def q23_lookups(c):
    """Which tables and columns a store that was brought up to date has."""
    store = old_store(c)
    asked = [("movies", "id"), ("movies", "file_size"), ("episodes", "still_path"), ("playback_logs", "movie_id"), ("movie_metadata", "title"), ("library_files", "file_path"), ("shows", "first_air_date")]
    found = c.spark.createDataFrame([(t, k, SM.table_exists(store, t), SM.column_exists(store, t, k)) for t, k in asked], "table_name string, column_name string, has_table boolean, has_column boolean")
    return found.join(store.read("movies").where("file_path not like 'old/%'").agg(F.count(F.lit(1)).alias("movies")))


@query(
    "SELECT media_id, start, CASE WHEN media_id % 5 = 0 THEN NULL WHEN media_id % 7 = 0 THEN '' ELSE body END AS body, CASE WHEN media_id % 5 = 0 THEN 'failed' WHEN media_id % 7 = 0 OR media_id % 3 = 1 THEN 'made' ELSE 'kept' END AS source FROM"
    " (SELECT media_id, CASE WHEN media_id % 3 = 1 THEN 30 ELSE 0 END AS start, string_agg(text, chr(10) ORDER BY cue, text) AS body FROM cues GROUP BY media_id) x"
)
def snk5_subtitle_cache(c):
    """Subtitles asked for twice: kept are those made whole, from the start on and without a failure; of the others each is made again."""
    cache, wanted, make = subtitles(c)
    cache.answer(wanted, make)
    return cache.answer(wanted, make).select("media_id", "start", "body", "source")


@query(
    "SELECT 'answer' AS sink, media_id, CASE WHEN media_id % 5 = 0 THEN NULL WHEN media_id % 7 = 0 THEN '' ELSE body END AS body FROM (SELECT media_id, string_agg(text, chr(10) ORDER BY cue, text) AS body FROM cues GROUP BY media_id) x"
    " UNION ALL SELECT 'table', media_id, body FROM (SELECT media_id, string_agg(text, chr(10) ORDER BY cue, text) AS body FROM cues GROUP BY media_id) x WHERE media_id % 5 <> 0 AND media_id % 7 <> 0 AND media_id % 3 <> 1"
)
def t08_subtitle_tee(c):
    """What is made once goes to two places: all of it to the answer, and what may be kept to the table."""
    cache, wanted, make = subtitles(c)
    answer = cache.answer(wanted, make).select(F.lit("answer").alias("sink"), "media_id", "body")
    return answer.unionAll(cache.store.read("subtitles").select(F.lit("table"), "media_id", "body"))


def subtitles(c):
    """An empty cache, what is asked for, and what makes it."""
    bodies = c.cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("cue", "text"))).alias("l")).select(F.col("media_id").cast("long").alias("media_id"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    wanted = bodies.select(F.lit("movie").alias("kind"), "media_id", F.lit(0).alias("track"), F.when(F.col("media_id") % 3 == 1, 30).otherwise(0).alias("start"))

    def make(missing):
        return missing.join(bodies, "media_id").select("kind", "media_id", "track", "start", F.when(F.col("media_id") % 5 == 0, None).when(F.col("media_id") % 7 == 0, "").otherwise(F.col("text")).alias("body"))

    return SU.SubtitleCache(V.Store(c.spark)), wanted, make


@query("SELECT id FROM movies WHERE contains(lower(coalesce(title, clean_name) || ' ' || file_path), 'blue')")
def f01_indexed_search(c):
    """The same search by an index of trigrams."""
    items, index = c.movies.withColumn("shown", C.display_title()), SX.SearchIndex(V.Store(c.spark))
    index.build(items, "shown", "file_path")
    return index.search(items, "  Blue ", "shown", "file_path").select("id")


# ---------------------------------------------------------------- streams


@query("WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT user_id, n, value AS last, 1 AS k FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, CASE WHEN abs(o.value - r.last) >= 10 THEN o.value ELSE r.last END, r.k + CASE WHEN abs(o.value - r.last) >= 10 THEN 1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, CAST(max(k) AS INTEGER) AS reports, arg_max(last, n) AS last FROM r GROUP BY user_id")
def t02_heartbeat(c):
    found = P.heartbeats(c.events, ["user_id"], ["ts", "event_id"], "value")
    return found.groupBy("user_id").agg(F.count("*").cast("int").alias("reports"), F.max_by("reported", "n").alias("last"))


@query("SELECT username, movie_id, position, duration FROM playback_progress")
def t01_watch_stream(c):
    """Events as a stream into the latest-state table; equals the batch query."""
    events = c.base("events")
    stream = E.table_stream(c.spark, c.sf_dir, "events", events)
    logs = stream.where("event_type in ('view','click','purchase')").selectExpr(
        "'Customer#'||lpad(cast(user_id as string),9,'0') as username", "event_id%200 as movie_id", "case event_type when 'view' then 'start' when 'click' then 'progress' else 'stop' end as event_type", "ts", "event_id as id", "value as position", "cast(100+10*(event_id%200%30) as double) as duration"
    )
    state = E.LatestState(c.spark, ["username", "movie_id"], ("ts", "id"), "progress")
    E.run_available(E.valid_events(logs.withColumnRenamed("id", "event")).withColumnRenamed("event", "id").drop("event_type"), state)
    return state.read().select("username", "movie_id", "position", "duration")


EVENTS = f"SELECT id, 'Customer#' || lpad(cast(user_id as varchar), 9, '0') AS username, event_type, movie_id, episode_id, position, duration, ts FROM ({POSTED}) p WHERE answer = 'OK'"


def watched(c):
    """Posted bodies as a stream into the sink of watch events."""
    raw = E.table_stream(c.spark, c.sf_dir, "events", c.base("events"))
    posts = raw.selectExpr("event_id as id", "'Customer#'||lpad(cast(user_id as string),9,'0') as username", "ts", BODIES.split(", ts, ", 1)[1].removesuffix(" from events"))
    sink = WT.WatchSink(c.spark)
    E.run_available(WT.accepted(posts), sink)
    return sink


@query(f"SELECT 'movie' AS kind, id, username, movie_id AS item, event_type, position, ts FROM ({EVENTS}) e WHERE movie_id IS NOT NULL UNION ALL SELECT 'episode', id, username, episode_id, event_type, position, ts FROM ({EVENTS}) e WHERE episode_id IS NOT NULL")
def t01_watch_logs(c):
    """Both logs that a stream of posted watch events leaves; refused bodies are in none."""
    sink = watched(c)
    part = lambda kind: sink.read(WT.KINDS[kind][1]).select(F.lit(kind).alias("kind"), "id", "username", F.col(WT.KINDS[kind][0]).alias("item"), "event_type", "position", "ts")
    return part("movie").unionAll(part("episode"))


@query(f"SELECT kind, username, item, position, duration, ts AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY kind, username, item ORDER BY ts DESC, id DESC) AS rn FROM (SELECT CASE WHEN movie_id IS NOT NULL THEN 'movie' ELSE 'episode' END AS kind, coalesce(movie_id, episode_id) AS item, * FROM ({EVENTS}) e) x) y WHERE rn = 1")
def t01_watch_progress(c):
    """Both tables of progress of the same stream: the last event of each user and item."""
    sink = watched(c)
    part = lambda kind: sink.read(WT.KINDS[kind][2]).select(F.lit(kind).alias("kind"), "username", F.col(WT.KINDS[kind][0]).alias("item"), "position", "duration", F.col("ts").alias("updated_at"))
    return part("movie").unionAll(part("episode"))


@query(f"SELECT token, username, is_admin, created_at, expires_at FROM sessions WHERE expires_at > {NOW} AND created_at <= {NOW} AND NOT (CAST(substr(token, 4) AS BIGINT) % 4 = 0 AND created_at + interval '1' hour <= {NOW})")
def t04_session_expiry(c):
    """Logins and logouts as a stream whose state holds live sessions only; those open at a time, from the changes that the stream gives."""
    raw = E.table_stream(c.spark, c.sf_dir, "events", c.base("events")).where("event_type = 'signup'")
    kinds = F.when(F.col("event_id") % 4 == 0, F.array(F.struct(F.lit("login").alias("kind"), F.col("ts")), F.struct(F.lit("logout").alias("kind"), (F.col("ts") + q("interval '1' hour")).alias("ts")))).otherwise(F.array(F.struct(F.lit("login").alias("kind"), F.col("ts"))))
    events = raw.select(q("'tok' || cast(event_id as string)").alias("token"), q("'Customer#' || lpad(cast(user_id as string), 9, '0')").alias("username"), q("case when event_id % 10 = 0 then 1 else 0 end").alias("is_admin"), F.inline(kinds))
    log = SS.ChangeLog(V.Store(c.spark), "sessions")
    E.run_available(SS.session_changes(events), log)
    return SS.live_sessions(log.read(), q(NOW)).select("token", "username", "is_admin", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("SELECT id, username, status, ip_address, ts FROM login_logs")
def d04_login_log(c):
    """Login attempts as a stream into their log, each batch once."""
    raw = E.table_stream(c.spark, c.sf_dir, "events", c.base("events")).where("event_type in ('signup', 'error')")
    log = SS.ChangeLog(V.Store(c.spark), "login_logs")
    E.run_available(raw.selectExpr("event_id as id", "'Customer#'||lpad(cast(user_id as string),9,'0') as username", "case event_type when 'signup' then 'success' else 'failed' end as status", "'10.0.0.'||cast(event_id%250 as string) as ip_address", "ts"), log)
    return log.read()


@query(f"SELECT token, username FROM sessions WHERE expires_at > {NOW}")
def t04_session_stream(c):
    """Logins as a stream into sessions that expire after a day; equals the batch query."""
    stream = E.table_stream(c.spark, c.sf_dir, "events", c.base("events")).where("event_type = 'signup'")
    logins = stream.selectExpr("'tok'||cast(event_id as string) as token", "'Customer#'||lpad(cast(user_id as string),9,'0') as username", "ts as created_at", "ts + interval '24' hour as expires_at")
    state = E.LatestState(c.spark, ["token"], ("created_at",), "sessions")
    E.run_available(logins, state)
    return E.live(state.read(), q(NOW)).select("token", "username")
