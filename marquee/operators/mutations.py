"""Writes as functions: each takes the table as it is and returns the table as it will be.

Parquet tables have no UPDATE; marquee.sources.versions writes such results as a new version and moves the pointer to it last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.sources.scratch import scratch_path
from marquee.sources.versions import CHANGED, NEW, SAME, STATE


def latest(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last event of each key: the state that replaying upserts leaves. A struct maximum, so it combines before the shuffle."""
    rest = [c for c in events.columns if c not in keys and c not in order]
    best = events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in [*order, *rest]])


def upsert_latest(state: DataFrame, events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return latest(state.unionByName(events.select(*state.columns)), keys, *order)


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the first by `order`, then by all other columns. A struct minimum, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *rest)).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest]).select(*rows.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows whose key is new are added; of new rows that repeat a key the first by `order`. A key with a null repeats no other: all such rows are added."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    added = first_of(rows.where(known), keys, *order).join(table.select(*keys), keys, "left_anti").unionByName(rows.where(~known))
    return table.unionByName(added, allowMissingColumns=True)


def insert_reported(table: DataFrame, rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The new rows with `outcome`: added, or duplicate where the table or an earlier new row has the key; also of rows that are alike in all columns one is added.

    Rows alike in all columns are counted first, so one row of each kind goes through the join; a key with a null repeats no other.
    """
    kinds = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    chosen = first_of(kinds.where(known).drop("_n"), keys, *order).join(table.select(*keys), keys, "left_anti")
    chosen = chosen.select(*[F.col(c).alias("_c_" + c) for c in rows.columns], F.lit(1).alias("_first"))
    same = F.lit(True)
    for c in rows.columns:
        same = same & F.col(c).eqNullSafe(F.col("_c_" + c))
    added = F.when(~known, F.col("_n")).otherwise(F.coalesce("_first", F.lit(0)))
    marked = kinds.join(chosen, same, "left").withColumn("_added", added)
    outcomes = F.concat(F.array_repeat(F.lit("added"), F.col("_added").cast("int")), F.array_repeat(F.lit("duplicate"), (F.col("_n") - F.col("_added")).cast("int")))
    return marked.select(*rows.columns, F.explode(outcomes).alias("outcome"))


#: Fixed value: hours that a session lasts.
SESSION_HOURS = 24


def open_sessions(sessions: DataFrame, logins: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions after logins (token, username, is_admin) at `now`: those that are over are gone, new ones last a day. A token that is taken and a name that no
    user has open none; of new rows that repeat a token one is added."""
    known = logins.join(users.select("username").distinct(), "username", "left_semi")
    new = known.select("token", "username", "is_admin", now.alias("created_at"), (now + F.expr(f"interval '{SESSION_HOURS}' hour")).alias("expires_at"))
    return insert_ignore(sessions.where(F.col("expires_at") > now), new.select(*sessions.columns), ["token"])


def insert_if_empty(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows are added if the table has none; one row of it is enough to tell."""
    any_row = table.limit(1).select(F.lit(1).alias("_one"))
    return table.unionByName(rows.withColumn("_one", F.lit(1)).join(any_row, "_one", "left_anti").drop("_one"), allowMissingColumns=True)


def delete_unreferenced(table: DataFrame, where: Column, key: str, *references: DataFrame) -> DataFrame:
    """The table after a delete that refuses rows which a reference (one column of the same name) still names."""
    named = references[0].select(key)
    for r in references[1:]:
        named = named.union(r.select(key))
    marked = table.join(named.distinct().withColumn("_named", F.lit(True)), key, "left")
    return marked.where(~F.coalesce(where, F.lit(False)) | F.col("_named").isNotNull()).drop("_named")


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(table: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key refers to nothing."""
    return table.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in rows take its other columns; the rest stay. Of rows that repeat a key the greatest counts."""
    new = [c for c in rows.columns if c not in keys]
    given = latest(rows, keys, *new).select(*keys, *[F.col(c).alias("_new_" + c) for c in new], F.lit(True).alias("_hit"))
    joined = table.join(given, keys, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col("_new_" + c)).otherwise(F.col(c)) for c in new}).select(*table.columns)


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Appends rows; columns they lack take their default, or null."""
    filled = rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})
    return table.unionByName(filled, allowMissingColumns=True)


def library_defaults() -> dict[str, Column]:
    """What a new library has unless it says otherwise."""
    return {"is_enabled": F.lit(1), "depth_limit": F.lit(-1), "scan_interval": F.lit(0), "metadata_language": F.lit("en"), "include_in_dashboard": F.lit(1)}


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def reconcile(old: DataFrame, scan: DataFrame, keys: list[str], facts: list[str], first_new_id: int, *order: str) -> DataFrame:
    """The table after a scan: what the scan saw is present with the scan's facts, what it missed is absent; ids and metadata stay.

    A key that the scan repeats counts once, with its last facts by `order`, or the greatest.
    New rows get ids from first_new_id on, by the order of their keys: new keys are counted by slices of their hash, so the
    numbering runs in parallel. The joined rows are written to the shared folder, since that reads them three times.
    """
    joined = scanned_over(old, scan, keys, facts, *order)
    path = scratch_path(old.sparkSession, "reconciled")
    joined.write.parquet(path)
    joined = old.sparkSession.read.schema(joined.schema).parquet(path)
    new = number_new(joined.where(F.col(STATE) == NEW), keys, first_new_id)
    return joined.where(F.col(STATE) != NEW).select(*old.columns).unionByName(new.select(*old.columns))


def scanned_over(old: DataFrame, scan: DataFrame, keys: list[str], facts: list[str], *order: str, within: Column | None = None, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The columns of old and STATE (SAME, CHANGED or NEW, the latter without ids) of the rows after a scan; see reconcile(). within: the rows of old that
    the scan is about, all others stay as they are. dealt: deals the rows of either side by their keys, if these are not to be shuffled as the join likes."""
    o = dealt(old.withColumns({"_old": F.lit(True), "_within": F.lit(True) if within is None else F.coalesce(within, F.lit(False))}))
    s = latest(dealt(scan.select(*dict.fromkeys([*keys, *order, *facts]))), keys, *order, *[c for c in facts if c not in order]).select(*keys, *[F.col(c).alias("_new_" + c) for c in facts]).withColumn("_seen", F.lit(True))
    both = o.join(s, keys, "full_outer")
    seen, known, about = F.coalesce("_seen", F.lit(False)), F.coalesce("_old", F.lit(False)), F.coalesce("_within", F.lit(True))
    after = {c: F.when(seen & about, F.col("_new_" + c)).otherwise(F.col(c)) for c in facts} | {"is_present": F.when(about, seen.cast("int")).otherwise(F.col("is_present"))}
    same = known
    for c, value in after.items():
        same = same & F.col(c).eqNullSafe(value)
    state = F.when(same, SAME).when(known, CHANGED).otherwise(NEW)
    return both.select(*[after[c].alias(c) if c in after else F.col(c) for c in old.columns], state.alias(STATE))


def number_new(rows: DataFrame, keys: list[str], first: int) -> DataFrame:
    """rows (written ones: they are read twice) with ids."""
    from pyspark.sql import Window as W

    rows = rows.withColumn("_slice", F.substring(F.md5(F.concat_ws("|", *keys)), 1, 2))
    sizes = rows.groupBy("_slice").count()
    bases = sizes.select("_slice", F.coalesce(F.sum("count").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # 256 rows
    return rows.join(bases, "_slice").withColumn("id", (F.lit(first - 1) + F.col("_base") + F.row_number().over(W.partitionBy("_slice").orderBy(*keys))).cast("long")).drop("_slice", "_base")


def violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with its name."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return table.withColumn("broken", F.explode(broken))
