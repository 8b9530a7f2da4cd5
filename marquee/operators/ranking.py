"""Places, running maxima and first values inside groups, also where a few groups hold nearly all rows: no window runs over a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.sources.scratch import scratch_path


def dealt(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """df sorted by range of (groups, order) and written to the shared folder, with `_at`, which ascends in this order, and `_task`, the run of rows that one task sorted.

    A large group is spread over as many tasks as it needs. Being written, the order holds when a task is lost. Columns of `order` should tell rows
    apart and be the same when they are computed again; rows that agree in all of them stand in any order.
    """
    spark = df.sparkSession
    keys = [*[F.col(g).asc_nulls_first() for g in groups], *order]
    path = scratch_path(spark, "dealt")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))


def with_earlier(rows: DataFrame, groups: list[str], carry: dict[str, Callable[[W], Column]], **own: Column) -> DataFrame:
    """Rows of dealt() with columns that sum up their group's rows in earlier tasks.

    own: aggregates of the rows of (group, task); carry: of each new column the expression over these, given a window over the group's tasks in their order, and one
    over the earlier ones of them. There are no more (group, task) than groups and tasks together, so that table is small and its windows are short.
    """
    names = [f"_group_{k}" for k in range(len(groups))]
    parts = rows.groupBy(*[F.col(g).alias(o) for g, o in zip(groups, names)], F.col("_task").alias("_by")).agg(*[c.alias(k) for k, c in own.items()])
    whole = W.partitionBy(*names).orderBy("_by")
    facts = parts.select(*names, "_by", *[f(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), whole.rowsBetween(W.unboundedPreceding, -1)).alias(k) for k, f in carry.items()])
    same = rows["_task"] == facts["_by"]
    for g, o in zip(groups, names):
        same = same & rows[g].eqNullSafe(facts[o])
    return rows.join(facts, same).drop(*names, "_by")


def placed(df: DataFrame, groups: list[str], order: list[Column], name: str = "place", first: int = 1) -> DataFrame:
    """df with one more column: the place of each row inside its group, counted from `first`. Nulls form a group, the first."""
    base = lambda whole, earlier: F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")
    rows = with_earlier(dealt(df, groups, order), groups, {"_base": base}, _start=F.min("_at"), _n=F.count(F.lit(1)))
    return rows.select(*df.columns, (F.col("_at") + F.col("_base") + first).cast("long").alias(name))


def running_max(df: DataFrame, groups: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the greatest value among the rows of its group up to each row."""
    rows = with_earlier(dealt(df.withColumn("_value", value), groups, order), groups, {"_before": lambda whole, earlier: F.max("_most").over(earlier)}, _most=F.max("_value"))
    own = F.max("_value").over(W.partitionBy(*groups, "_task").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(*df.columns, F.greatest(own, "_before").alias(name))


def first_value(df: DataFrame, groups: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the value of the first row of its group."""
    rows = dealt(df.withColumn("_value", value), groups, order)
    return with_earlier(rows, groups, {name: lambda whole, earlier: F.first("_lead").over(whole)}, _lead=F.min_by("_value", "_at")).select(*df.columns, name)
