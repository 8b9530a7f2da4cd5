"""The media-catalog tables as views over the given parquet tables: one SQL text each, valid in Spark and in DuckDB.

Every view is lazy, so that Catalyst prunes columns and pushes filters through it to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.scratch import scratch_path

BASE = ("nation", "supplier", "customer", "part", "lineitem", "events", "conversations", "pages", "documents")

VIEWS = {
    "libraries": "select n_nationkey as id, n_name as name, '/media/'||n_name as path, case n_nationkey%3 when 0 then 'Movies' when 1 then 'Shows' else 'Other' end as type from nation",
    "movies": "select p_partkey as id, cast(3*(p_partkey%8)+case when p_partkey%4=0 then 2 else 0 end as int) as library_id, p_brand||'/'||cast(p_partkey as string)||'/'||replace(p_name,' ','.')||'.'||cast(1950+p_partkey%75 as string)||'.1080p.mkv' as file_path, replace(p_name,' ','.')||'.'||cast(1950+p_partkey%75 as string)||'.1080p' as clean_name, case when p_size%10=0 then 0 else 1 end as is_present, case p_partkey%5 when 0 then null when 1 then 0 else 100000+p_partkey end as tmdb_id, case when p_partkey%5<2 then null else case p_partkey%4 when 0 then 'The ' when 1 then 'A ' when 2 then 'An ' else '' end||p_name end as title, cast(round(p_retailprice*1000000) as bigint) as file_size from part",
    "shows": "select s_suppkey as id, cast(case when s_suppkey%11=0 then 3*(s_suppkey%8) else 1+3*(s_suppkey%8) end as int) as library_id, s_name as path, s_name as title, case when s_suppkey%10=9 then 0 else 1 end as is_present, case s_suppkey%4 when 0 then null when 1 then 0 else 200000+s_suppkey end as tmdb_id from supplier",
    # ids are numbered inside an order, so no row number runs over the whole table
    "episodes": "select id, show_id, 'S'||lpad(cast(season as string),2,'0')||'E'||lpad(cast(episode as string),2,'0')||'.'||cast(id as string)||'.mkv' as file_path, season, episode, is_present, tmdb_id, title, file_size from (select l_orderkey*1000+row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as id, l_suppkey as show_id, l_linenumber as season, cast(l_quantity as int) as episode, case when l_returnflag='R' then 0 else 1 end as is_present, case l_orderkey%3 when 0 then null when 1 then 0 else 300000+l_orderkey end as tmdb_id, case when l_orderkey%3=2 then 'Ep '||cast(l_orderkey as string) else null end as title, cast(round(l_extendedprice) as bigint) as file_size from lineitem) x",
    "users": "select c_custkey as id, c_name as username, case when c_custkey%50=0 then 1 else 0 end as is_admin from customer",
    "login_logs": "select event_id as id, 'Customer#'||lpad(cast(user_id as string),9,'0') as username, case event_type when 'signup' then 'success' else 'failed' end as status, '10.0.0.'||cast(event_id%250 as string) as ip_address, ts from events where event_type in ('signup','error')",
    "sessions": "select 'tok'||cast(id as string) as token, username, case when id%10=0 then 1 else 0 end as is_admin, ts as created_at, ts + interval '24' hour as expires_at from login_logs where status='success'",
    "playback_logs": "select event_id as id, 'Customer#'||lpad(cast(user_id as string),9,'0') as username, event_id%200 as movie_id, case event_type when 'view' then 'start' when 'click' then 'progress' else 'stop' end as event_type, value as position, cast(100+10*(event_id%200%30) as double) as duration, ts from events where event_type in ('view','click','purchase')",
    "playback_progress": "select username,movie_id,position,duration,ts as updated_at from (select *, row_number() over (partition by username,movie_id order by ts desc,id desc) rn from playback_logs) x where rn=1",
    "episode_playback_logs": "select event_id as id, 'Customer#'||lpad(cast(user_id as string),9,'0') as username, event_id%300 as episode_id, case event_type when 'view' then 'start' else 'progress' end as event_type, value as position, cast(100+10*(event_id%300%30) as double) as duration, ts from events where event_type in ('view','error')",
    "episode_playback_progress": "select username,episode_id,position,duration,ts as updated_at from (select *, row_number() over (partition by username,episode_id order by ts desc,id desc) rn from episode_playback_logs) x where rn=1",
    "scan_shows": "select library_id,path from shows where id%5<>0 union all select library_id,'new/'||path as path from shows where id%13=0",
    "scan_episodes": "select show_id,file_path,season+1 as season,episode,file_size+1 as file_size from episodes where id%7<>0 union all select show_id,'new/'||file_path as file_path,season,episode,file_size from episodes where id%11=0",
    "cues": "select conv_id as media_id, turn as cue, turn*4.0E0 as cue_start, turn*4.0E0+1.0E0+(length(text)%50)/10.0E0 as cue_end, role as text from conversations",
    "tmdb_results": "select p_name as query, row_number() over (partition by p_name order by p_partkey)-1 as pos, 500000+p_partkey as tmdb_id, p_brand as title from part where p_name not like '%ring'",
    "packets": "select user_id as media_id, row_number() over (partition by user_id order by ts,event_id) as rn, cast(floor(value) as bigint) as dts from events",
    "scan_movies": "select library_id,file_path,clean_name,file_size+1 as file_size from movies where id%7<>0 union all select library_id,'new/'||file_path,clean_name,file_size from movies where id%11=0",
}


class Catalog:
    """Views of one data folder as attributes: Catalog(spark, sf_dir).movies."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def over(self, **tables: DataFrame) -> Catalog:
        """The catalog with written tables in place of views; all views that use these read them."""
        other = Catalog(self.spark, self.sf_dir)
        other.__dict__.update(tables)
        return other

    def written(self, *names: str) -> Catalog:
        """The catalog with these views written to the shared folder, so that what uses them several times computes them once."""
        tables = {}
        for name in names:
            df, path = getattr(self, name), scratch_path(self.spark, name)
            df.write.parquet(path)
            tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.over(**tables)

    def sql(self, text: str) -> DataFrame:
        """SQL over the views and base tables; each name is bound here, so nothing is left in the session."""
        import re

        names = sorted(set(re.findall(r"[a-z_]+", text)) & (set(VIEWS) | set(BASE)))
        return self.spark.sql(re.sub(rf"(?<=from )({'|'.join(names)})\b|(?<=join )({'|'.join(names)})\b", lambda m: "{" + m[0] + "} as " + m[0], text), **{n: getattr(self, n) for n in names if re.search(rf"(from|join) {n}\b", text)})

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """A DuckDB statement: the views that sql uses, directly or through others, as common table expressions."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"[a-z_]+", text):
            if name in VIEWS and name not in need:
                add(VIEWS[name])
                if name not in need:
                    need.append(name)

    add(sql)
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + " " if need else "") + sql
