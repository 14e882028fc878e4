"""Document-store verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.operators import store
from quizloom.plans.registry import query
from quizloom.session import read_table
from quizloom.sources import standins as S


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def get_doc(spark, sf_dir):
    return store.get_doc(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_equal(spark, sf_dir):
    return store.where(read_table(spark, sf_dir, "customer"), "c_mktsegment", "==", "BUILDING").select("c_custkey", "c_name")


TAGGED = "WITH t AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS kinds FROM orders GROUP BY o_custkey)"


def _tagged(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("kinds"))


@query(TAGGED + " SELECT id, len(kinds) AS n FROM t WHERE list_contains(kinds, '2-HIGH')")
def where_array_contains(spark, sf_dir):
    return store.where(_tagged(spark, sf_dir), "kinds", "array-contains", "2-HIGH").select("id", F.size("kinds").cast("long").alias("n"))


@query(TAGGED + " SELECT id, len(kinds) AS n FROM t WHERE list_has_any(kinds, ['1-URGENT', '5-LOW'])")
def where_array_contains_any(spark, sf_dir):
    return store.where(_tagged(spark, sf_dir), "kinds", "array-contains-any", ["1-URGENT", "5-LOW"]).select("id", F.size("kinds").cast("long").alias("n"))


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def ordered_list(spark, sf_dir):
    rows = store.where(read_table(spark, sf_dir, "customer"), "c_mktsegment", "==", "BUILDING").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return store.limit(store.order_by(rows, "c_acctbal", "desc", "c_custkey"), 50)


@query("""WITH o AS (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_custkey % 3 < 2),
n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS seg, 'x' AS extra FROM customer WHERE c_custkey % 3 > 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.seg ELSE o.seg END AS seg, nation, extra FROM o FULL JOIN n ON o.id = n.id""")
def merged_documents(spark, sf_dir):
    """setDoc with merge: new fields over old ones, a null deletes a field."""
    c = read_table(spark, sf_dir, "customer")
    text = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))])
    old = c.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("id"), text(seg=F.col("c_mktsegment"), nation=F.col("c_nationkey")).alias("f"))
    new = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), text(seg=F.when(F.col("c_custkey") % 2 == 0, "NEW"), extra=F.lit("x")).alias("f"))
    return store.upsert(old, new, "id", "f").select("id", F.col("f")["seg"].alias("seg"), F.col("f")["nation"].alias("nation"), F.col("f")["extra"].alias("extra"))


@query("SELECT id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderkey % 100 AS id, 1 AS n FROM orders UNION ALL SELECT CAST(json_extract(props, '$.k') AS BIGINT), 10 FROM events) GROUP BY id")
def incremented(spark, sf_dir):
    base = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("id"), F.lit(1).alias("n"))
    more = S.attempts(spark, sf_dir).select(F.col("q").alias("id"), F.lit(10).alias("n"))
    return store.increments(base, more, "id", "n")


@query("SELECT id, string_agg(x, ',' ORDER BY x) AS tags FROM (SELECT o_custkey AS id, o_orderpriority AS x FROM orders UNION SELECT user_id, event_type FROM events) GROUP BY id")
def array_unions(spark, sf_dir):
    """arrayUnion: a customer's order priorities, to which the events of the user of that number add their types."""
    base = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("tags"))
    more = S.attempts(spark, sf_dir).select(F.col("usr").alias("id"), F.array("kind").alias("tags"))
    return store.array_unions(base, more, "id", "tags").withColumn("tags", F.array_join("tags", ","))


@query("SELECT name, arg_min(usr, (ts, event_id)) AS owner, count(*) - 1 AS refused FROM (SELECT 'name' || (event_id % 300) AS name, user_id AS usr, ts, event_id FROM events) GROUP BY name")
def name_claims(spark, sf_dir):
    rows = S.attempts(spark, sf_dir).select(F.concat(F.lit("name"), F.col("event_id") % 300).alias("name"), "usr", "ts", "event_id")
    owners = store.claims(rows, "name", ["ts", "event_id"]).select("name", F.col("usr").alias("owner"))
    return owners.join(rows.groupBy("name").agg((F.count("*") - 1).alias("refused")), "name")


@query("SELECT event_id, user_id AS d, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id = CAST(json_extract(props, '$.k') AS BIGINT) AS own, event_type IN ('click', 'view') AND user_id <> CAST(json_extract(props, '$.k') AS BIGINT) AS accepted FROM events")
def write_rules(spark, sf_dir):
    """Writes that the rules accept: of a known kind, and not to oneself."""
    rows = S.attempts(spark, sf_dir)
    own = F.col("usr") == F.col("q")
    return rows.select("event_id", F.col("usr").alias("d"), F.col("q").alias("k"), own.alias("own"), (F.col("kind").isin("click", "view") & ~own).alias("accepted"))


LWW = """WITH w AS (SELECT user_id AS usr, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_id, event_type AS v, event_type = 'error' AS deleted FROM events)"""


@query(LWW + " SELECT usr, k, v FROM (SELECT usr, k, arg_max(v, (ts, event_id)) AS v, arg_max(deleted, (ts, event_id)) AS d FROM w GROUP BY usr, k) WHERE NOT d")
def last_writer_wins(spark, sf_dir):
    rows = S.attempts(spark, sf_dir).select("usr", F.col("q").alias("k"), "ts", "event_id", F.col("kind").alias("v"), (F.col("kind") == "error").alias("deleted"))
    return store.latest(rows, ["usr", "k"], ["ts", "event_id"], "deleted").select("usr", "k", "v")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60) GROUP BY event_type")
def telemetry_without_opt_outs(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    out = e.where("event_type = 'signup' AND value > 60").select("user_id")
    return e.join(out, "user_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH " + S.SQL + " SELECT q, set_id, module FROM question WHERE set_id = 42")
def deep_link_set(spark, sf_dir):
    """A deep link as a parameterised query."""
    S.questions(spark, sf_dir).createOrReplaceTempView("quizloom_question")
    return spark.sql("SELECT q, set_id, module FROM quizloom_question WHERE set_id = :id", args={"id": 42})
