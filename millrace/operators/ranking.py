"""Deduplication, ranks and top-k over rows of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import staged


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least ``order`` of each ``key``. Rows of a key are reduced before they move, so a hot key costs one row a task; NULL keys are dropped."""
    others = [c for c in df.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    best = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__k")).agg(F.min_by(row, F.col(f"`{order}`")).alias("__r"))
    return best.select("__r.*")


def global_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Dense rank 1..n over all rows, without moving them to one task.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes of the partitions
    before, of which there are as many rows as partitions. Order must be total for a result that doesn't vary.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = staged(sorted_, "ranked")
    part, place = F.shiftright("__at", 33).alias("__p"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return kept.withColumns({"__p": part, "__i": place}).join(F.broadcast(before), "__p").withColumn(out, (F.col("__before") + F.col("__i") + 1).cast("bigint")).drop("__p", "__i", "__at", "__before")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows: a per-task heap and a merge, no full sort."""
    return df.orderBy(*order).limit(k)


def group_rank(df: DataFrame, group: str, *order: Column, out: str = "rank_in_group") -> DataFrame:
    """Rank 1..n within each value of ``group`` (NULL is one too), without moving a group to one task.

    Rows are range-partitioned by group and order, so a hot group spans many partitions; a row's rank is its place among its
    group's rows in its partition plus what the group has in the partitions before. Only group and partition counts move further.
    """
    g = F.col(f"`{group}`")
    kept = staged(df.repartitionByRange(g, *order).sortWithinPartitions(g, *order).withColumn("__at", F.monotonically_increasing_id()), "group-ranked")
    part = F.shiftright("__at", 33)
    runs = kept.groupBy(g.alias("__g"), part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__g", "__p", (before - F.col("__first") + 1).alias("__shift"))
    joined = kept.withColumn("__p", part).join(runs.withColumnRenamed("__p", "__q"), (F.col("__p") == F.col("__q")) & g.eqNullSafe(F.col("__g")))
    return joined.withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__p", "__q", "__g", "__shift")
