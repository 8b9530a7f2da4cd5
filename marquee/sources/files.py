"""File trees and JSON documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import text as T

#: The lookup service's answers; unknown fields are ignored.
SEARCH = "struct<results:array<struct<id:bigint,title:string,name:string,overview:string,poster_path:string,backdrop_path:string,release_date:string,first_air_date:string>>>"
#: A watch event as a player posts it; read as text first, so that a value of the wrong kind can be told from a missing one.
WATCH_EVENT = "struct<id:string,movie_id:string,episode_id:string,event:string,position:string,duration:string>"
#: What events may be called, and the answers to a posted body.
EVENT_TYPES = ("start", "stop", "seek", "progress")
OK, BAD, NO_ITEM = "OK", "Bad Request", "Missing movie_id or episode_id"


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, basename and size of every file below root; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    folder = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.substring("path", F.instr("path", folder) + len(folder), F.length("path"))
    return files.select(rel.alias("rel_path"), T.basename(F.col("path")).alias("basename"), "size")


def movie_files(tree: DataFrame) -> DataFrame:
    """Video files at any depth: file_path, clean_name, file_size."""
    return tree.where(T.is_video(F.col("basename"))).select(F.col("rel_path").alias("file_path"), T.without_extension(F.col("basename")).alias("clean_name"), F.col("size").alias("file_size"))


def episode_files(tree: DataFrame) -> DataFrame:
    """Video files below a first-level folder, which is the show; files at the top are ignored."""
    parts = F.split("rel_path", "/")
    below = tree.where(T.is_video(F.col("basename")) & (F.size(parts) > 1))
    return below.select(F.get(parts, F.lit(0)).alias("show"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("file_path"), T.season(F.col("basename")).alias("season"), T.episode(F.col("basename")).alias("episode"), F.col("size").alias("file_size"))


def listing(tree: DataFrame) -> DataFrame:
    """First-level names without hidden ones, in byte order."""
    return tree.select(F.substring_index("rel_path", "/", 1).alias("name")).where(~F.col("name").startswith(".")).distinct().orderBy("name")


def search_results(answers: DataFrame, body: str = "body") -> DataFrame:
    """One row for each result with its place in the answer."""
    return answers.withColumn("_r", F.from_json(body, SEARCH)).select(*[c for c in answers.columns if c != body], F.posexplode(F.col("_r.results")).alias("pos", "result")).select("*", "result.*").drop("result")


def form_value(body: Column, name: str, last: bool = True) -> Column:
    """A field of a form-encoded body; the last or the first of repeated names; null if absent."""
    hits = F.filter(F.split(body, "&"), lambda p: p.startswith(name + "="))
    return F.try_url_decode(F.substring(F.try_element_at(hits, F.lit(-1 if last else 1)), len(name) + 2, 1 << 30))


def path_tree(items: DataFrame, path: str = "file_path", size: str = "file_size") -> DataFrame:
    """A table of relative paths in the shape of file_tree()."""
    return items.select(F.col(path).alias("rel_path"), T.basename(F.col(path)).alias("basename"), F.col(size).alias("size"))


def detail(items: DataFrame, answers: DataFrame, keys: list[str], fields: str, body: str = "body") -> DataFrame:
    """Items with the fields of the answer of their keys, and `status`: NotFound where there is none or it cannot be read."""
    read = answers.select(*keys, F.from_json(body, fields).alias("_d"))
    return items.join(read, keys, "left").select(*items.columns, F.when(F.col("_d").isNull(), "NotFound").otherwise("ok").alias("status"), "_d.*")


def _whole(text: Column) -> Column:
    """A JSON number as a long, if it is whole."""
    number = text.try_cast("double")
    return F.when(F.rlike(text, F.lit("^-?[0-9]+$")), text.try_cast("long")).when(number == F.floor(number), number.try_cast("long"))


#: The settings of a server, and how large their file may be.
CONFIG, CONFIG_BYTES = "struct<port:string,tmdb_access_token:string,tmdb_proxy:string>", 1 << 20


def configs(files: DataFrame, body: str = "body", default_token: str | None = None) -> DataFrame:
    """Settings files (JSON) as `sound`, port, tmdb_access_token and tmdb_proxy. Fields that are not known are passed over; the port must be there and fit 16 bits; a file that is
    no JSON or beyond 1 MiB is not sound and gives nothing. A token that is missing or empty becomes default_token."""
    read = files.withColumn("_c", F.when(F.octet_length(body) <= CONFIG_BYTES, F.from_json(body, CONFIG)))
    port = _whole(F.col("_c.port"))
    sound = F.coalesce(port.between(0, 65535), F.lit(False))
    token = F.coalesce(F.nullif(F.col("_c.tmdb_access_token"), F.lit("")), F.lit(default_token))
    return read.select(*[c for c in files.columns if c != body], sound.alias("sound"), F.when(sound, port).cast("int").alias("port"), F.when(sound, token).alias("tmdb_access_token"), F.when(sound, F.col("_c.tmdb_proxy")).alias("tmdb_proxy"))


def watch_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Posted JSON bodies as events: answer, event_type, movie_id, episode_id, position and duration.

    event, position and duration must be there, with values of their kind, and ids must be whole numbers or null: else the body is refused whole. The item
    is movie_id, else id, else episode_id: a body that names a movie is never an episode's. Only accepted bodies have fields.
    """
    e = F.col("_e")
    read = bodies.withColumn("_e", F.from_json(body, WATCH_EVENT))
    ids = {k: _whole(e[k]) for k in ("id", "movie_id", "episode_id")}
    numbers = {k: e[k].try_cast("double") for k in ("position", "duration")}
    sound = e["event"].isNotNull() & numbers["position"].isNotNull() & numbers["duration"].isNotNull()
    for k, v in ids.items():
        sound = sound & (e[k].isNull() | v.isNotNull())
    movie = F.coalesce(ids["movie_id"], ids["id"])
    answer = F.when(~F.coalesce(sound, F.lit(False)), BAD).when(F.coalesce(movie, ids["episode_id"]).isNull(), NO_ITEM).otherwise(OK)
    good = lambda v: F.when(F.col("answer") == OK, v)
    return read.withColumn("answer", answer).select(
        *[c for c in bodies.columns if c != body], "answer", good(e["event"]).alias("event_type"), good(movie).alias("movie_id"), good(F.when(movie.isNull(), ids["episode_id"])).alias("episode_id"),
        good(numbers["position"]).alias("position"), good(numbers["duration"]).alias("duration"),
    )
