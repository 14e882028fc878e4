"""Question-bank views over the synthetic star schema, for Spark and, as SQL, for the oracle.

question: orders (set = customer, kind = priority, module = market segment); option: lineitem, numbered within its order,
correct where the return flag is R; attempt: events (question = props.k); picks follow from the ids by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.session import read_table

PICK = "pmod(event_id * 31 + i * 17 + q, 7) < 3"

SQL = """
opt AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i,
  l_returnflag = 'R' AS correct, l_partkey AS part, l_linestatus AS st, l_returnflag AS flag FROM lineitem),
question AS (SELECT o_orderkey AS q, o_custkey AS set_id, o_orderpriority AS kind, o_orderdate AS added, o_orderstatus AS status, o_totalprice AS price,
  c_mktsegment AS module FROM orders JOIN customer ON c_custkey = o_custkey),
answer AS (SELECT q, coalesce(list(i ORDER BY i) FILTER (WHERE correct), []) AS ans, count(*) AS n_opt FROM opt GROUP BY q),
attempt AS (SELECT event_id, user_id AS usr, CAST(json_extract(props, '$.k') AS BIGINT) AS q, ts, event_type AS kind, value FROM events),
picked AS (SELECT a.*, ans, n_opt, list_filter(range(n_opt), lambda i: (event_id * 31 + i * 17 + a.q) % 7 < 3) AS sel FROM attempt a JOIN answer USING (q)),
mark AS (SELECT *, CASE WHEN len(sel) > 0 AND len(list_intersect(sel, ans)) = len(sel) AND len(sel) = len(ans) THEN 1.0
  WHEN len(sel) > 0 AND len(list_intersect(sel, ans)) = len(sel) AND len(ans) >= 2 AND 2 * len(sel) >= len(ans) THEN 0.5 ELSE 0.0 END AS points FROM picked)
"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.col("l_orderkey").alias("q"), (F.row_number().over(place) - 1).cast("long").alias("i"), (F.col("l_returnflag") == "R").alias("correct"),
        F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("st"), F.col("l_returnflag").alias("flag"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    return orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(
        F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("added"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("module"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, ans (the correct option numbers in order) and n_opt; a question has few options."""
    own = F.array_sort(F.collect_list(F.when(F.col("correct"), F.col("i"))))
    return options(spark, sf_dir).groupBy("q").agg(own.alias("ans"), F.count("*").alias("n_opt"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("usr"), F.get_json_object("props", "$.k").cast("long").alias("q"), "ts", F.col("event_type").alias("kind"), "value")


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempts with ans, n_opt and sel (the options picked)."""
    rows = attempts(spark, sf_dir).join(answers(spark, sf_dir), "q")
    return rows.withColumn("sel", F.expr(f"filter(sequence(0L, n_opt - 1), i -> {PICK})"))
