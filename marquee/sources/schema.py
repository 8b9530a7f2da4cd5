"""The tables of the server as schemas, look-ups in a store's catalog, and the chain of migrations that brings an old store up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.operators import mutations as M
from marquee.operators.ranking import placed
from marquee.sources.versions import Store, Transaction

#: Columns of the tables and what a table is found by; "" stands for a log, which has no key.
TABLES = {
    "users": ("id long, username string, password_hash string, salt string, is_admin int", "id"),
    "sessions": ("token string, username string, is_admin int, created_at long, expires_at long", "token"),
    "libraries": ("id long, name string, path string, type string, is_enabled int, depth_limit int, scan_interval int, metadata_language string, ignore_patterns string, include_in_dashboard int, created_at long, updated_at long, last_scanned_at long", "id"),
    "movies": ("id long, library_id long, file_path string, clean_name string, is_present int, tmdb_id long, title string, overview string, poster_path string, backdrop_path string, release_date string, file_size long", "library_id file_path"),
    "shows": ("id long, library_id long, path string, title string, is_present int, tmdb_id long, overview string, poster_path string, backdrop_path string", "library_id path"),
    "episodes": ("id long, show_id long, file_path string, season int, episode int, is_present int, tmdb_id long, title string, overview string, still_path string, file_size long", "show_id file_path"),
    "login_logs": ("id long, username string, status string, ip_address string, timestamp long", ""),
    "playback_logs": ("id long, username string, movie_id long, event_type string, position double, timestamp long", ""),
    "playback_progress": ("username string, movie_id long, position double, duration double, updated_at long", "username movie_id"),
    "episode_playback_logs": ("id long, username string, episode_id long, event_type string, position double, timestamp long", ""),
    "episode_playback_progress": ("username string, episode_id long, position double, duration double, updated_at long", "username episode_id"),
}
#: What a column holds that a row does not give; all others are null.
DEFAULTS = {
    "users": {"is_admin": 0}, "sessions": {"is_admin": 0}, "movies": {"is_present": 1, "file_size": 0}, "shows": {"is_present": 1}, "episodes": {"season": 0, "episode": 0, "is_present": 1, "file_size": 0},
    "libraries": {"is_enabled": 1, "depth_limit": -1, "scan_interval": 0, "metadata_language": "en", "include_in_dashboard": 1},
}
#: Columns that must not be null.
REQUIRED = {
    "users": "username password_hash salt is_admin", "sessions": "username is_admin created_at expires_at", "libraries": "name path type is_enabled depth_limit scan_interval metadata_language include_in_dashboard created_at updated_at",
    "movies": "library_id file_path clean_name is_present file_size", "shows": "library_id path title is_present", "episodes": "show_id file_path season episode is_present file_size", "login_logs": "username status ip_address timestamp",
    "playback_logs": "username movie_id event_type position timestamp", "playback_progress": "username movie_id position duration updated_at", "episode_playback_logs": "username episode_id event_type position timestamp", "episode_playback_progress": "username episode_id position duration updated_at",
}


def schema(name: str) -> StructType:
    """The schema of a table; columns that must not be null are marked so."""
    kind = StructType.fromDDL(TABLES[name][0])
    required = REQUIRED[name].split()
    for f in kind.fields:
        f.nullable = f.name not in required
    return kind


def keys(name: str) -> list[str]:
    return TABLES[name][1].split()


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a table, in their order and kinds; missing ones take their default, others go."""
    given = {c: F.col(c) for c in df.columns}
    default = DEFAULTS.get(name, {})
    return df.select(*[given.get(f.name, F.lit(default.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(name).fields])


def table_exists(store: Store, name: str) -> bool:
    return name in store.tables()


def column_exists(store: Store, table: str, column: str) -> bool:
    return table_exists(store, table) and column in store.schema(table).fieldNames()


def missing_values(df: DataFrame, name: str) -> DataFrame:
    """Rows that lack a value they must have, with the column's name."""
    return M.violations(df, {c: F.col(c).isNotNull() for c in REQUIRED[name].split() if c in df.columns})


def _rebuild_movies(tx: Transaction) -> None:
    """Movies of a time before ids: numbered by their key, every other column kept."""
    old = tx.read("movies")
    if "id" not in old.columns:
        tx.create("movies", placed(old, [], [F.col(k) for k in keys("movies")], name="id"), keys("movies"))


def _drop_old_logs(tx: Transaction) -> None:
    """Logs of a time before movie ids say nothing of a movie; they and their progress start anew."""
    if "movie_id" not in tx.read("playback_logs").columns:
        tx.drop("playback_logs")
        tx.drop("playback_progress")


def _take_old_metadata(tx: Transaction) -> None:
    """Metadata of a time before movies had a table: rows whose key is new become movies."""
    old, now = tx.read("movie_metadata"), tx.read("movies")
    first = (now.agg(F.max("id")).first()[0] or 0) + 1
    new = M.first_of(conformed(old.withColumns({"clean_name": F.lit(""), "is_present": F.lit(1)}), "movies").drop("id"), keys("movies")).join(now.select(*keys("movies")), keys("movies"), "left_anti")
    numbered = placed(new, [], [F.col(k) for k in keys("movies")], name="id", first=first).select(*now.columns)
    tx.upsert("movies", numbered, lambda rows, more: rows.unionByName(more))
    tx.drop("movie_metadata")


def _conform(name: str) -> Callable[[Transaction], None]:
    def add_columns(tx: Transaction) -> None:
        df = tx.read(name)
        if df.columns != schema(name).fieldNames():
            tx.create(name, conformed(df, name), keys(name))

    return add_columns


#: Steps in their order: the table whose presence a step asks for, and what it does.
MIGRATIONS: list[tuple[str, Callable[[Transaction], None]]] = [("movies", _rebuild_movies), ("playback_logs", _drop_old_logs), *[(name, _conform(name)) for name in TABLES]]


def migrate(store: Store) -> bool:
    """Brings a store up to date in one transaction; whether it changed anything. A store that is up to date gets no new version."""
    tx = store.begin()
    before = str(tx.next["tables"])
    for name, step in MIGRATIONS:
        if name in tx.next["tables"]:
            step(tx)
    for name in TABLES:
        if name not in tx.next["tables"]:
            tx.create(name, store.spark.createDataFrame([], schema(name)), keys(name))
    if "movie_metadata" in tx.next["tables"]:
        _take_old_metadata(tx)
    tx.drop("library_files")
    if str(tx.next["tables"]) == before:
        tx.abort()
        return False
    tx.commit()
    return True
