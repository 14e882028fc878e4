"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; none gets more than CAP
times its size, and what is over goes to the others by weight (the level is found among the sorted caps).
Taking: a source's documents stand in an order fixed by a digest of doc_id. Its target is so many whole passes and a part
of one; each document is taken once a pass, and in the last pass up to the word at which the target is met.
Positions: each source's weight over training time t in [0, 1] is a straight line around its target (SLOPES, repeating), so
its cumulative demand is target * (t + slope * (t * t - t)). A take's position is where that demand, inverted, meets the middle
of the words its source has given before and with it. mix tells the first take's; sequence has a row for every take. Both are
range-sorted by position.

Scale: a running sum over a source would put a third of all rows into one task. Each source is dealt into ranges of
the digest (16**BUCKET_DIGITS of them); sums of the ranges are added up, and within a range the running sum is exact.

Contract of the cases: a null or wordless text has size 0 and is taken 0 times; what is not taken has no position; a
null source is a source; rows that share a doc_id are ordered by size and digest of the text, so reruns agree; very long
texts count whole; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.session import cut

WEIGHTS, CAP = (1, 2, 3), 3
#: How a source's weight changes from the beginning (1 - slope) to the end (1 + slope), repeating by its place in order.
SLOPES = (-0.5, 0.0, 0.5)
#: Hexadecimal digits of the digest that name a range of a source's order.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with place, weight and target; one row a source, so windows over all of them are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = F.row_number().over(order) - 1
    out = sizes.withColumn("place", place)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    out = out.withColumn("limit", F.col("source_size") * CAP)
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if the sources before this one are full and this and the rest are not
    free = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    out = out.withColumn("level", free / F.sum("weight").over(after))
    out = out.withColumns({"rank": F.row_number().over(filled), "fits": F.col("level") <= F.col("limit") / F.col("weight")})
    out = out.withColumn("level", F.min(F.when(F.col("fits"), F.struct("rank", "level"))).over(every)["level"])
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return out.select("source", "source_size", "place", "weight", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """mix_rows, range-sorted by position."""
    return mix_rows(docs).drop("goal", "before", "slope", "tie").orderBy("position", "doc_id")


def mix_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position (of the first take) and their terms for every row of docs."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie"))
    rows = cut(rows.withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS)))
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goals = cut(targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size"))))
    offsets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("words").over(offsets), F.lit(0)).alias("offset")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranges = buckets.select("source", "bucket", offset)
    ranges = ranges.join(goals, same(ranges, goals)).select(ranges["source"].alias("_source"), ranges["bucket"].alias("_bucket"), "offset", "source_size", "place", "target")
    placed = rows.join(ranges, rows["source"].eqNullSafe(ranges["_source"]) & (rows["bucket"] == ranges["_bucket"]))
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    goal = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumns({"before": before, "goal": goal, "passes": passes})
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("passes") * F.col("source_size") - F.col("before")))
    placed = placed.withColumn("taken", (F.col("passes") * F.col("size") + rest).cast("long"))
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("place") % len(SLOPES) + 1).cast("int"))
    placed = placed.withColumn("slope", slope)
    given = F.when(F.col("taken") > 0, F.col("before") + F.col("size") / 2)
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", position_of(given).alias("position"), "goal", "before", "slope", "tie")


def position_of(given: Column) -> Column:
    """The t at which a source has given so many of its goal's words: slope * t * t + (1 - slope) * t = given / goal."""
    slope = F.col("slope")
    share = F.least(F.lit(1.0), given / F.col("goal"))
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope)
    return F.when(given.isNull(), F.lit(None).cast("double")).when(slope == 0, share).otherwise(root)


def sequence(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs, each row as often as the mix takes it, range-sorted by the positions of the takes.

    A part of half a document or more counts as a whole one. Texts without words have no part in the mix and are left out.
    """
    takes = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = mix_rows(docs).where("size > 0").withColumn("_takes", takes).where("_takes > 0")
    # rows that share an id and a text are one entry of the plan, as they are taken alike; each meets its own row of docs
    plan = plan.groupBy("doc_id", "tie").agg(F.max(F.struct("_takes", "goal", "before", "slope", "size", "source_size")).alias("_p")).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "_p.*")
    own = docs.select(*columns).withColumn("_own_tie", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    met = own.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own_tie") == F.col("_tie")))
    met = met.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_takes") - 1)))
    met = met.withColumn("_position", position_of(F.col("_pass") * F.col("source_size") + F.col("before") + F.col("size") / 2))
    return met.orderBy("_position", "doc_id").select(*columns)


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS turn, text FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, (p % 3) + 1 AS weight, source_size * 3 AS lim FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM sizes)),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW f AS (ORDER BY lim / weight, p)),
goals AS (
  SELECT source, source_size, p, least(CAST(lim AS DOUBLE), coalesce((SELECT level FROM levels WHERE level <= lim / weight ORDER BY lim / weight, p LIMIT 1), 0.0) * weight) AS target FROM levels),
placed AS (
  SELECT doc_id, d.source, size, source_size, p, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes,
    least(1.0, (before + size / 2) / nullif(goal, 0)) AS share, [-0.5, 0.0, 0.5][p % 3 + 1] AS slope FROM placed),
taken AS (SELECT *, CAST(passes * size + greatest(0, least(size, goal - passes * source_size - before)) AS BIGINT) AS taken FROM shares)
SELECT doc_id, source, size, source_size, target, taken,
  CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END AS position
FROM taken"""
