"""A library scan as one transaction over libraries, shows, movies and episodes; and metadata passes that can be taken up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators import catalog as C
from marquee.operators import mutations as M
from marquee.sources.versions import Store, Transaction

#: Keys of the catalog tables in a store: what a scan finds an item by.
KEYS = {"libraries": ["id"], "movies": ["library_id", "file_path"], "shows": ["library_id", "path"], "episodes": ["show_id", "file_path"]}


def catalog_store(store: Store, **tables: DataFrame) -> Store:
    """A store whose first version holds the given catalog tables."""
    with store.begin() as tx:
        for name, df in tables.items():
            tx.create(name, df, KEYS[name])
    return store


def _taken_over(tx: Transaction, name: str, found: DataFrame, part: DataFrame, facts: list[str]) -> None:
    """The table after a scan of those rows whose first key is in part (one column of its name), new rows with the next free ids. Buckets
    in which all rows stay as they are keep their folders."""
    keys, old = KEYS[name], tx.read(name)
    first = (old.agg(F.max("id")).first()[0] or 0) + 1
    marked = old.join(part.distinct().withColumn("_part", F.lit(True)), keys[0], "left").select(*old.columns, "_part")
    rows = M.scanned_over(marked, found, keys, facts, within=F.col("_part"), dealt=tx.keyed(name))
    tx.rewrite(name, rows, lambda new: M.number_new(new, keys, first))


def scan_libraries(store: Store, wanted: Column, movies: DataFrame, shows: DataFrame, episodes: DataFrame, now: Column) -> Transaction:
    """Scans the enabled libraries for which `wanted` holds; all tables change together, or none if anything fails on the way.

    movies: library_id, file_path, clean_name, file_size; shows: library_id, path; episodes: library_id, show (its path), file_path, season, episode, file_size.
    Shows libraries have shows, all others movies. What the scan does not find is absent, with its metadata kept.
    """
    with store.begin() as tx:
        libraries = tx.read("libraries")
        chosen = tx.hold(libraries.where(wanted & (F.col("is_enabled") == 1) if "is_enabled" in libraries.columns else wanted).select(F.col("id").alias("library_id"), "type"))
        of_shows, of_movies = chosen.where("type = 'Shows'").select("library_id"), chosen.where("type <> 'Shows'").select("library_id")
        _taken_over(tx, "movies", movies.join(of_movies, "library_id"), of_movies, ["clean_name", "file_size"])
        _taken_over(tx, "shows", shows.join(of_shows, "library_id").withColumn("title", F.col("path")), of_shows, ["title"])
        known = tx.read("shows").join(of_shows, "library_id", "left_semi").select(F.col("id").alias("show_id"), "library_id", F.col("path").alias("show"))
        found = episodes.join(known, ["library_id", "show"]).select("show_id", "file_path", "season", "episode", "file_size")
        _taken_over(tx, "episodes", found, known.select("show_id"), ["season", "episode", "file_size"])
        scanned = chosen.select(F.col("library_id").alias("id"), now.alias("last_scanned_at"))
        tx.upsert("libraries", scanned, lambda old, new: M.update_from(old, new, ["id"]))
    return tx


def enrich(store: Store, found: DataFrame) -> Transaction:
    """One pass over all that has never been looked up, in its order: movies, shows, then episodes of shows matched by now, this pass included.

    The store holds libraries, and movies, shows and episodes by id with tmdb_id and attempts. found: kind, id, tmdb_id of the answers that came: a match, or
    0 where the service knows nothing. What got no answer stays pending with one more attempt, and is due again in the next pass.
    """
    with store.begin() as tx:
        libraries = tx.read("libraries")
        due = {
            "movie": lambda: C.pending(tx.read("movies"), libraries, "Movies"),
            "show": lambda: C.pending(tx.read("shows"), libraries, "Shows"),
            "episode": lambda: C.pending_episodes(tx.read("episodes"), tx.read("shows")),
        }
        for kind, items in due.items():
            asked = items().select("id").join(found.where(F.col("kind") == kind).select("id", F.col("tmdb_id").cast("long").alias("tmdb_id")), "id", "left")
            tx.upsert(f"{kind}s", asked, _answered, by_keys=True, stay=~F.expr(C.PENDING))  # what is looked up already is due no more
    return tx


def _answered(items: DataFrame, answers: DataFrame) -> DataFrame:
    marked = items.join(answers.select("id", F.col("tmdb_id").alias("_answer"), F.lit(True).alias("_asked")), "id", "left")
    failed = F.col("_asked") & F.col("_answer").isNull()
    return marked.withColumn("tmdb_id", F.coalesce("_answer", "tmdb_id")).withColumn("attempts", F.col("attempts") + F.when(failed, 1).otherwise(0)).select(*items.columns)
