"""Exact dedup by deterministic block naming, in DataFrame expressions only.

Every normalised text is cut into blocks of BLOCK bytes. Equal blocks meet in one sorted run, and the run takes an integer
name, so names are equal exactly when blocks are: no digest decides. Then adjacent pairs of names are named in the same
way, level by level, until each document has one integer: its identity. A document of n blocks needs log2(n) levels.

Skew: what more than one HOT_SHARE-th of a level's rows hold (there are fewer than HOT_SHARE such keys) is named from a
broadcast table of at most HOT_SHARE keys and takes no part in the exchange; all other keys are small groups.

Contract of the cases: null counts as empty, and empty texts are equal to one another; only runs of [\\x20\\x09-\\x0D] are
replaced, by one space, also at the ends; very long texts are cut into as many blocks as they need; of rows that repeat a
doc_id, those with the smallest id of their group are all kept; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.llm.rows import settle
from quizloom.session import HOT_SHARE, cut, look_up

BLOCK = 4096
#: More than the levels that a text's blocks can need.
LEVELS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def name_runs(rows: DataFrame, code: str, content: list[str], total: int) -> DataFrame:
    """rows with a long column name in place of the content columns: equal names exactly for equal contents.

    code is a hash of the content, which deals the rows out and speeds up sorting; it decides nothing.
    """
    line = max(1, total // HOT_SHARE)
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    codes = rows.groupBy(code).agg(F.count("*").alias("_n")).where(F.col("_n") > line).select(code)
    codes = cut(codes)
    if codes.isEmpty():
        hot_rows, cold_rows = None, rows
    else:
        # fewer than HOT_SHARE codes, and so fewer than HOT_SHARE contents that are as frequent
        suspects = rows.join(F.broadcast(codes), code, "left_semi").groupBy(code, *content).agg(F.count("*").alias("_n"))
        hot = cut(suspects.where(F.col("_n") > line).drop("_n").withColumn("_hot_name", -1 - F.monotonically_increasing_id()))
        on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in content]
        right = hot.select(F.col(code).alias("_r_code"), *[F.col(c).alias(f"_r_{c}") for c in content], "_hot_name")
        joined = rows.join(F.broadcast(right), [F.col(code) == F.col("_r_code"), *on], "left").select(*rows.columns, "_hot_name")
        # rows with a hot name leave their content behind and are scattered
        scattered = F.when(F.col("_hot_name").isNull(), F.col(code)).otherwise(F.monotonically_increasing_id())
        kept = {c: F.when(F.col("_hot_name").isNull(), F.col(c)) for c in content}
        hot_rows, cold_rows = True, joined.withColumns({code: scattered, **kept})
    dealt = cold_rows.repartition(int(n), code).withColumn("_at", F.monotonically_increasing_id())
    run = Window.partitionBy(code, *content)
    named = dealt.withColumn("name", F.min("_at").over(run))
    if hot_rows:
        named = named.withColumn("name", F.coalesce("_hot_name", "name")).drop("_hot_name")
    return named.drop("_at", code, *content)


def identities(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and identity (a long, equal exactly for equal normalised texts) for every row of docs."""
    text = docs.select("doc_id", normalised(F.col("text")).cast("binary").alias("data"))
    text = text.withColumn("text_sha256", F.sha2("data", 256))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / BLOCK).cast("int"))
    cuts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(F.col("data"), i * BLOCK + 1, F.lit(BLOCK)))
    # (doc_id, text_sha256) tells apart rows that share a doc_id; rows equal in both have equal texts' blocks
    rows = text.select("doc_id", "text_sha256", F.lit(1).cast("long").alias("copies"), blocks.alias("blocks"), F.posexplode(cuts).alias("i", "block"))
    rows = rows.withColumn("code", F.xxhash64("block"))
    # no fewer than the blocks there are, as normalising only shortens
    total = docs.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / BLOCK)))).first()[0] or 0
    named, level, done = cut(name_runs(rows, "code", ["block"], int(total))), 0, None
    while True:
        # equal texts have equally many blocks and so end on one level: level and name are one integer
        ended = named.where("blocks = 1").select("doc_id", "text_sha256", "copies", (F.col("name") * LEVELS + level).alias("identity"))
        done = ended if done is None else done.unionByName(ended)
        left = named.where("blocks > 1")
        if left.isEmpty():
            break
        level += 1
        # (doc_id, text_sha256) tells apart rows that share a doc_id; a row that is there n times goes on once, as n copies
        pairs = left.groupBy("doc_id", "text_sha256", "blocks", F.expr("i div 2").cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b"),
            F.sum(F.when(F.col("i") % 2 == 0, F.col("copies"))).alias("copies"),
        )
        pairs = cut(pairs.withColumn("blocks", F.ceil(F.col("blocks") / 2).cast("int")).withColumn("code", F.xxhash64("a", "b")))
        named = cut(name_runs(pairs, "code", ["a", "b"], pairs.count()))
    return done.select("doc_id", "text_sha256", "identity", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    ids = cut(identities(docs))
    groups = ids.groupBy("identity").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = look_up(ids, groups, "identity", "group_size", ["keep_id", "group_size"], ids.count())
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keepers(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs: one row of each group of equal normalised texts.

    A row is known by its doc_id and its normalised text, so a row that shares its id with a dropped one is judged by itself.
    Of a group's rows with the smallest id, and of a group without any id, the least row by the columns stays.
    """
    decided = cut(dedup(docs).select("doc_id", "keep_id", "text_sha256"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = decided.groupBy("doc_id", F.col("text_sha256").alias("row_key")).agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
    return settle(docs, cut(rows.select("doc_id", "row_key", "stays")), columns, lambda x: x.withColumn("row_key", F.sha2(normalised(F.col("text")).cast("binary"), 256)))
