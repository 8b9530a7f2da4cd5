"""Listings, lookups, joins and dashboard figures over the media catalog: DataFrame -> DataFrame.

Nothing here broadcasts by hint: libraries is small, and Catalyst sends it to all tasks by its measured size.
tmdb_id has three states: null = never looked up, 0 = looked up without a match, above 0 = matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as T

MATCHED, PENDING, UNMATCHED = "tmdb_id > 0", "tmdb_id is null", "tmdb_id is null or tmdb_id = 0"


def library_order(libraries: DataFrame) -> DataFrame:
    """Movies, then Shows, then the rest; by name inside a type."""
    rank = F.when(F.col("type") == "Movies", 1).when(F.col("type") == "Shows", 2).otherwise(3)
    return libraries.withColumn("type_rank", rank).orderBy("type_rank", "name", "id")


def listing(items: DataFrame, title: Column) -> DataFrame:
    """Present items with their article-free sort key; the caller sorts, if it shows them."""
    return items.where("is_present = 1").withColumn("sort_key", T.title_key(title))


def display_title() -> Column:
    return F.coalesce("title", "clean_name")


def in_libraries(items: DataFrame, libraries: DataFrame, kind: str | None = None) -> DataFrame:
    """Items with their library's type and path."""
    side = libraries.select(F.col("id").alias("library_id"), "type", F.col("path").alias("library_path"))
    return items.join(side if kind is None else side.where(F.col("type") == kind), "library_id")


def pending(items: DataFrame, libraries: DataFrame, kind: str) -> DataFrame:
    return in_libraries(items.where(f"is_present = 1 and {PENDING}"), libraries, kind)


def pending_episodes(episodes: DataFrame, shows: DataFrame) -> DataFrame:
    """Episodes never looked up whose show is matched."""
    matched = shows.where(MATCHED).select(F.col("id").alias("show_id"), F.col("tmdb_id").alias("show_tmdb_id"))
    return episodes.where(f"is_present = 1 and {PENDING}").join(matched, "show_id").select("id", "show_tmdb_id", "season", "episode")


def unmatched(movies: DataFrame, shows: DataFrame, libraries: DataFrame) -> DataFrame:
    """Unmatched movies of Movies libraries by file name, then unmatched shows of Shows libraries by title; items in a library of another type are not asked for."""
    known = libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name"), F.col("type").alias("library_type"))

    def part(items: DataFrame, kind: str, type_: str, title: Column, path: str, order: str) -> DataFrame:
        found = items.where(f"is_present = 1 and ({UNMATCHED})").join(known.where(F.col("library_type") == type_), "library_id")
        return found.select(F.lit(kind).alias("item_type"), "id", F.col(order).alias("name"), title.alias("title"), F.col(path).alias("path"), "library_name", "library_type")

    both = part(movies, "movie", "Movies", display_title(), "file_path", "clean_name").unionAll(part(shows, "show", "Shows", F.col("title"), "path", "title"))
    return both.orderBy("item_type", "name", "id")


def with_progress(movies: DataFrame, progress: DataFrame, username: str) -> DataFrame:
    """Movies with a user's position and percentage, which is null without a duration."""
    own = progress.where(F.col("username") == username).select("movie_id", "position", "duration")
    pct = F.when(F.col("duration") > 0, F.col("position") / F.col("duration") * 100)
    return movies.join(own, movies["id"] == own["movie_id"], "left").drop("movie_id").withColumn("position", F.coalesce("position", F.lit(0.0))).withColumn("pct", pct)


def top_result(items: DataFrame, query: Column, results: DataFrame) -> DataFrame:
    """Items with the first result of their query; 0 where there is none."""
    first = results.groupBy("query").agg(F.min_by("tmdb_id", "pos").alias("found_id"), F.min_by("title", "pos").alias("found_title"))
    return items.withColumn("query", query).join(first, "query", "left").withColumn("found_id", F.coalesce("found_id", F.lit(0).cast("long")))


def nested_shows(shows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Shows with an array of their present episodes in order; empty where there are none."""
    e = episodes.where("is_present = 1").groupBy("show_id").agg(F.array_sort(F.collect_list(F.struct("season", "episode", "id", "title"))).alias("episodes"))
    joined = shows.join(e, shows["id"] == e["show_id"], "left").drop("show_id")
    return joined.withColumn("episodes", F.coalesce("episodes", F.array().cast(e.schema["episodes"].dataType)))


def active_cues(cues: DataFrame, times: DataFrame, bucket: float = 60.0) -> DataFrame:
    """For each (media_id, t): texts of the cues with cue_start <= t <= cue_end, joined by line feeds.

    A cue goes to every bucket of time it touches, so the range join is an equality join on (media, bucket).
    """
    spread = cues.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("cue_start") / bucket), F.floor(F.col("cue_end") / bucket))))
    at = times.withColumn("bucket", F.floor(F.col("t") / bucket))
    hit = spread.join(at, ["media_id", "bucket"]).where("cue_start <= t and t <= cue_end")
    return hit.groupBy("media_id", "t").agg(F.array_sort(F.collect_list(F.struct("cue", "text"))).alias("c")).select("media_id", "t", F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("texts"))


def search(items: DataFrame, words: str, *columns: str) -> DataFrame:
    """Items whose columns, joined by spaces, contain the trimmed words, without regard to case."""
    return items.where(F.lower(F.concat_ws(" ", *columns)).contains(words.strip().lower()))


def dashboard(movies: DataFrame, shows: DataFrame, episodes: DataFrame, libraries: DataFrame, users: DataFrame) -> DataFrame:
    """One row of counts and stored bytes. Each table is read once and adds one row of partial figures."""
    zero = {k: F.lit(0).cast("long") for k in ("users", "movies", "others", "shows", "episodes", "unmatched", "bytes")}

    def figures(df: DataFrame, **own: Column) -> DataFrame:
        return df.agg(*[F.coalesce(F.sum(own.get(k, z)), F.lit(0)).cast("long").alias(k) for k, z in zero.items()])

    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    known = libraries.select(F.col("id").alias("library_id"), "type")
    with_type = lambda items: items.where("is_present = 1").join(known, "library_id", "left")  # noqa: E731  items of no library keep a null type
    open_ = lambda kind: flag(F.expr(UNMATCHED) & (F.col("type") == kind))
    parts = [
        figures(users, users=F.lit(1).cast("long")),
        figures(with_type(movies), movies=flag(F.col("type") == "Movies"), others=flag(F.col("type") == "Other"), unmatched=open_("Movies"), bytes=F.col("file_size")),
        figures(with_type(shows), shows=F.lit(1).cast("long"), unmatched=open_("Shows")),
        figures(episodes.where("is_present = 1"), episodes=F.lit(1).cast("long"), bytes=F.col("file_size")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.agg(*[F.sum(k).cast("long").alias(k) for k in zero])


def shows_as_json(shows: DataFrame, episodes: DataFrame) -> DataFrame:
    """id and body: the answer for each show, with its present episodes in order. What is not known is an empty text; an episode without a title shows its file's name.

    shows: id, library_id, title, overview, poster_path, backdrop_path, tmdb_id; episodes: show_id, is_present, id, season, episode, file_path, title, overview, still_path.
    """
    or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = F.struct("id", "season", "episode", F.coalesce("title", T.basename(F.col("file_path"))).alias("title"), or_empty("overview"), or_empty("still_path"))
    of_show = episodes.where("is_present = 1").groupBy("show_id").agg(F.array_sort(F.collect_list(F.struct("season", "episode", "id", own.alias("e")))).alias("_sorted"))
    listed = F.coalesce(F.transform("_sorted", lambda x: x["e"]), F.array().cast(of_show.select(F.transform("_sorted", lambda x: x["e"])).schema[0].dataType))
    show = F.struct("id", "library_id", "title", or_empty("overview"), or_empty("poster_path"), or_empty("backdrop_path"), or_empty("tmdb_id"), listed.alias("episodes"))
    joined = shows.join(of_show.withColumnRenamed("show_id", "_show"), F.col("id") == F.col("_show"), "left")
    return joined.select("id", F.to_json(F.struct(F.lit(True).alias("success"), show.alias("show"))).alias("body"))


def enrichment_pass(movies: DataFrame, shows: DataFrame, episodes: DataFrame, libraries: DataFrame, found: DataFrame) -> DataFrame:
    """kind, id and tmdb_id of what one pass asks for, in its order: pending movies, pending shows, then episodes of shows matched by now, this pass
    included. found: kind, id, tmdb_id of the answers that came: a match, or 0 where the service knows nothing. An item without an answer, because its
    lookup failed, has a null tmdb_id: it stays pending."""
    answer = lambda items, kind: items.join(found.where(F.col("kind") == kind).select("id", F.col("tmdb_id").cast("long").alias("tmdb_id")), "id", "left").select(F.lit(kind).alias("kind"), "id", "tmdb_id")
    m = answer(pending(movies, libraries, "Movies").select("id"), "movie")
    s = answer(pending(shows, libraries, "Shows").select("id"), "show")
    now = shows.select("id", "tmdb_id").join(s.select("id", F.col("tmdb_id").alias("new")), "id", "left").withColumn("tmdb_id", F.coalesce("new", "tmdb_id"))
    return m.union(s).union(answer(pending_episodes(episodes, now).select("id"), "episode"))


def updates(items: DataFrame, libraries: DataFrame, kind_is_shows: bool, title: Column, poster: Column) -> DataFrame:
    """What a client that polls gets of libraries of one kind: each resolved item (looked up, with or without a match) and how many are still waiting.

    Rows: library_id, remaining_pending, id, tmdb_id, title, poster_path; a library without resolved items has one row with a null id.
    """
    asked = libraries.where((F.col("type") == "Shows") if kind_is_shows else (F.col("type") != "Shows")).select(F.col("id").alias("library_id"))
    present = items.where("is_present = 1")
    waiting = present.where(PENDING).groupBy("library_id").agg(F.count(F.lit(1)).alias("_n"))
    resolved = present.where("tmdb_id is not null").select("library_id", "id", "tmdb_id", F.coalesce(title, F.lit("")).alias("title"), poster.alias("poster_path"))
    heads = asked.join(waiting, "library_id", "left").select("library_id", F.coalesce("_n", F.lit(0)).alias("remaining_pending"))  # one row a library
    return heads.join(resolved, "library_id", "left")
