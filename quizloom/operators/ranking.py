"""Ranking, keyed selection and window-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; an aggregate rather than a window, so a hot key is combined before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(first).select(*keys, "_row.*")


def top_k(rows: DataFrame, keys: list[str], order: list[str | Column], k: int, name: str = "place") -> DataFrame:
    """Each key's first k rows with their places from 1; Spark limits the window's groups before the exchange."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def longest_run(rows: DataFrame, keys: list[str], order: list[str], flag: str, name: str = "longest") -> DataFrame:
    """The longest run of rows with flag in each key's order; 0 for keys without."""
    every, own = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, flag).orderBy(*order)
    island = rows.withColumn("_island", F.row_number().over(every) - F.row_number().over(own))
    runs = island.groupBy(*keys, "_island", flag).agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("_n"))), F.lit(0)).cast("long").alias(name))


def newest_first_exclusion(in_sets: DataFrame, singles: DataFrame, entry: str, item: str) -> DataFrame:
    """An entry's items from sets, without those that a newer entry names singly, and its own singles."""
    newest = singles.groupBy(item).agg(F.max(entry).alias("_newest"))
    kept = in_sets.join(newest, item, "left").where(F.col("_newest").isNull() | (F.col("_newest") <= F.col(entry)))
    return kept.select(entry, item).unionByName(singles.select(entry, item)).distinct()


def floor_tier(count: Column, tiers: list[int]) -> Column:
    """The largest tier that the count reaches, else 0: an as-of lookup in a fixed table, without a join."""
    out = F.lit(0)
    for t in sorted(tiers):
        out = F.when(count >= t, F.lit(t)).otherwise(out)
    return out.cast("long")


def dense_position(rows: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Positions from 0 over all rows in order, without gathering them in one task.

    Rows are range-sorted, the sizes of the ranges are added up, and each range counts on from there.
    """
    from quizloom.session import cut

    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_dense_range", F.spark_partition_id()).withColumn("_dense_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_dense_range").agg(F.count("*").alias("_n"), F.min("_dense_at").alias("_dense_first"))
    before = sizes.select("_dense_range", "_dense_first", (F.sum("_n").over(Window.orderBy("_dense_range")) - F.col("_n")).alias("_dense_before"))
    out = dealt.join(F.broadcast(before), "_dense_range")  # one row a partition
    return out.withColumn(name, F.col("_dense_at") - F.col("_dense_first") + F.col("_dense_before")).drop("_dense_range", "_dense_at", "_dense_first", "_dense_before")
