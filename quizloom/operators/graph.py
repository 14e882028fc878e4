"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.session import cut, look_up, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of the undirected edges (two long columns).

    Each round points every node at the smallest of itself and its neighbours and follows these pointers to their ends by
    doubling. The ends are at most half of the nodes, and the edges between them, each once, are the next round's. Then the
    rounds' ends are put together from the last one back. So each edge crosses the network a few times in the first round, and
    what is left after it is small. Edges with a null end and loops link nothing. Every round's tables are in the checkpoint
    folder, so plans do not grow. Hubs and large components are looked up by counted keys, so none of them fills one task.
    """
    one = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    left, rounds = cut(one.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), []
    while True:
        n = left.count()
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = cut(both.groupBy(F.col("u").alias("node")).agg(F.count_if(F.col("v") > F.col("u")).alias("lows"), F.count_if(F.col("v") < F.col("u")).alias("highs"), F.least(F.col("u"), F.min("v")).alias("label")))
        rounds.append(ends)
        if not n:
            break
        ends = rounds[-1] = _followed(ends)
        known = lambda end: ends.select(F.col("node").alias(end), "lows", "highs", "label")
        moved = look_up(left, known("u"), "u", "lows", ["label"], n).select(F.col("label").alias("u"), "v")
        moved = look_up(moved, known("v"), "v", "highs", ["label"], n).select("u", F.col("label").alias("v")).where("u <> v")
        moved = cut(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        release(left)
        left = moved
    release(left)
    found = rounds.pop().select("node", "label")
    for ends in reversed(rounds):
        found = cut(_above(ends, found, "label").select("node", F.coalesce("above", "label").alias("label")))
    return found.select("node", F.col("label").alias("component"))


def _above(ends: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """ends with above: the label in labels (node, label) of each row's name, null where it has none."""
    sizes = ends.groupBy(F.col(name).alias("_node")).agg(F.count("*").alias("_size"))
    above = sizes.join(labels.select(F.col("node").alias("_node"), F.col("label").alias("above")), "_node").withColumnRenamed("_node", name)
    return look_up(ends, above, name, "_size", ["above"], ends.count())


def _followed(ends: DataFrame) -> DataFrame:
    """ends with each label replaced by the last one that its pointers lead to."""
    while True:
        further = cut(_above(ends, ends, "label").select("node", "lows", "highs", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("_moved")))
        release(ends)
        ends = further
        if ends.where("_moved").isEmpty():
            return ends
