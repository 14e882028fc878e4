"""Constraints as queries: each gives the rows that break it, or a summary (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.plans.registry import query
from quizloom.session import read_table
from quizloom.sources import standins as S

P = "WITH " + S.SQL


@query(P + " SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query(P + """ SELECT kind, status, count(*) AS n, count(*) FILTER (WHERE len(ans) > 0) AS keyed FROM question JOIN answer USING (q) GROUP BY ALL""")
def key_agreement(spark, sf_dir):
    rows = S.questions(spark, sf_dir).join(S.answers(spark, sf_dir), "q")
    return rows.groupBy("kind", "status").agg(F.count("*").alias("n"), F.count_if(F.size("ans") > 0).alias("keyed"))


@query(P + " SELECT q, len(list_filter(ans, lambda i: i >= n_opt - 1)) AS out_of_range FROM answer WHERE len(list_filter(ans, lambda i: i >= n_opt - 1)) > 0")
def answers_in_range(spark, sf_dir):
    """Answers beyond the options (against one option fewer, so that the stand-in has some)."""
    rows = S.answers(spark, sf_dir).select("q", F.size(F.filter("ans", lambda i: i >= F.col("n_opt") - 1)).cast("long").alias("out_of_range"))
    return rows.where("out_of_range > 0")


@query(P + """ SELECT set_id, q FROM (SELECT set_id, q, added, lag(added) OVER (PARTITION BY set_id ORDER BY q) AS before FROM question) WHERE added < before""")
def order_violations(spark, sf_dir):
    """Entries that stand after a newer one."""
    from pyspark.sql.window import Window

    before = F.lag("added").over(Window.partitionBy("set_id").orderBy("q"))
    return S.questions(spark, sf_dir).withColumn("before", before).where("added < before").select("set_id", "q")


@query(P + """ SELECT module, count(DISTINCT part) AS used, (SELECT count(*) FROM part) - count(DISTINCT part) AS unused FROM opt JOIN question USING (q) GROUP BY module""")
def unused_concepts(spark, sf_dir):
    total = read_table(spark, sf_dir, "part").count()  # one number
    rows = S.options(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", "module"), "q").groupBy("module").agg(F.countDistinct("part").alias("used"))
    return rows.withColumn("unused", F.lit(total) - F.col("used"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS t FROM documents), b AS (SELECT doc_id - 1 AS doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS t FROM documents)
SELECT count(*) FILTER (WHERE a.t = b.t) AS same, count(*) FILTER (WHERE a.t <> b.t) AS mismatched, count(*) FILTER (WHERE b.t IS NULL) AS skipped FROM a LEFT JOIN b USING (doc_id)""")
def second_reading(spark, sf_dir):
    """Two readings compared: same, mismatched, skipped."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), 256).alias("t"))
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id", "left")
    return both.agg(F.count_if(F.col("t") == F.col("u")).alias("same"), F.count_if(F.col("t") != F.col("u")).alias("mismatched"), F.count_if(F.col("u").isNull()).alias("skipped"))
