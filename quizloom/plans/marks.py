"""Exam marks, diagnostics and class statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.operators import ranking
from quizloom.operators.scoring import mark20, percent, points
from quizloom.plans.registry import query
from quizloom.sources import standins as S

P = "WITH " + S.SQL


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.picked(spark, sf_dir).withColumn("points", points(F.col("sel"), F.col("ans")))


@query(P + "SELECT event_id, usr, q, len(sel) AS ticks, len(ans) AS n_right, points FROM mark")
def exam_points(spark, sf_dir):
    return marked(spark, sf_dir).select("event_id", "usr", "q", F.size("sel").cast("long").alias("ticks"), F.size("ans").cast("long").alias("n_right"), "points")


@query(P + """SELECT module, count(*) AS n, sum(points) AS points, floor(sum(points) / count(*) * 2000 + 0.5) / 100 AS mark
FROM mark JOIN question USING (q) GROUP BY module""")
def exam_marks_by_module(spark, sf_dir):
    rows = marked(spark, sf_dir).join(S.questions(spark, sf_dir).select("q", "module"), "q")
    return rows.groupBy("module").agg(F.count("*").alias("n"), F.sum("points").alias("points")).withColumn("mark", mark20(F.col("points"), F.col("n")))


@query(P + """SELECT usr, kind, count(*) FILTER (WHERE points = 1) AS full_marks, count(*) FILTER (WHERE points = 0.5) AS half, count(*) FILTER (WHERE points = 0 AND len(sel) > 0) AS none,
 count(*) FILTER (WHERE len(sel) = 0) AS blank FROM mark GROUP BY ALL""")
def exam_tally(spark, sf_dir):
    p, blank = F.col("points"), F.size("sel") == 0
    return marked(spark, sf_dir).groupBy("usr", "kind").agg(F.count_if(p == 1).alias("full_marks"), F.count_if(p == 0.5).alias("half"), F.count_if((p == 0) & ~blank).alias("none"), F.count_if(blank).alias("blank"))


@query(P + """SELECT coalesce(kind, '(all)') AS topic, sum(points) AS points, count(*) AS n FROM mark GROUP BY ROLLUP (kind)""")
def points_by_topic(spark, sf_dir):
    return marked(spark, sf_dir).rollup("kind").agg(F.sum("points").alias("points"), F.count("*").alias("n")).select(F.coalesce("kind", F.lit("(all)")).alias("topic"), "points", "n")


EXAMS = """, exam AS (SELECT usr, kind AS scope, CAST(ts AS DATE) AS day, max(ts) AS t, floor(sum(points) / count(*) * 2000 + 0.5) / 100 AS mark FROM mark GROUP BY ALL)"""


def exams(spark, sf_dir):
    rows = marked(spark, sf_dir).groupBy("usr", F.col("kind").alias("scope"), F.to_date("ts").alias("day"))
    return rows.agg(F.max("ts").alias("t"), F.sum("points").alias("_p"), F.count("*").alias("_n")).withColumn("mark", mark20(F.col("_p"), F.col("_n")))


@query(P + EXAMS + " SELECT usr, scope, max(mark) AS best, arg_max(mark, t) AS last, count(*) AS sittings FROM exam GROUP BY ALL")
def best_and_last_mark(spark, sf_dir):
    return exams(spark, sf_dir).groupBy("usr", "scope").agg(F.max("mark").alias("best"), F.max_by("mark", "t").alias("last"), F.count("*").alias("sittings"))


CLEAN = """, first_try AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usr, q ORDER BY ts, event_id) AS rn FROM mark) WHERE rn = 1)"""


def first_tries(rows: DataFrame) -> DataFrame:
    """The first row of each user and question; later ones never count."""
    return ranking.first_by(rows, ["usr", "q"], ["ts", "event_id"])


@query(P + CLEAN + """, need AS (SELECT kind, least(8, count(DISTINCT q)) AS need FROM first_try GROUP BY kind),
d AS (SELECT usr, kind AS lecture, count(*) AS tries, floor(sum(points) / count(*) * 2000 + 0.5) / 100 AS mark FROM first_try GROUP BY ALL)
SELECT usr, lecture, tries, mark, CASE WHEN tries < need THEN 'Not enough' WHEN mark >= 15 THEN 'Solid' WHEN mark >= 10 THEN 'Shaky' ELSE 'Weak spot' END AS status FROM d JOIN need ON lecture = kind""")
def lecture_diagnostic(spark, sf_dir):
    tries = first_tries(marked(spark, sf_dir)).withColumnRenamed("kind", "lecture")
    need = tries.groupBy("lecture").agg(F.least(F.lit(8), F.countDistinct("q")).alias("need"))
    own = tries.groupBy("usr", "lecture").agg(F.count("*").alias("tries"), F.sum("points").alias("_p")).withColumn("mark", mark20(F.col("_p"), F.col("tries")))
    status = F.when(F.col("tries") < F.col("need"), "Not enough").when(F.col("mark") >= 15, "Solid").when(F.col("mark") >= 10, "Shaky").otherwise("Weak spot")
    return own.join(need, "lecture").select("usr", "lecture", "tries", "mark", status.alias("status"))


@query(P + """, c AS (SELECT usr, count(*) AS n, sum(CASE WHEN len(list_intersect(sel, ans)) < len(sel) THEN
  CASE WHEN len(list_intersect(sel, ans)) = 0 THEN 0.0 WHEN len(list_intersect(sel, ans)) = len(ans) THEN 1.0 WHEN len(ans) >= 2 AND 2 * len(list_intersect(sel, ans)) >= len(ans) THEN 0.5 ELSE 0.0 END
  ELSE 0.0 END) AS lost FROM mark GROUP BY usr)
SELECT usr, n, lost, floor(lost / n * 2000 + 0.5) / 100 AS cost FROM c""")
def wrong_tick_cost(spark, sf_dir):
    rows = marked(spark, sf_dir)
    right_only = points(F.array_intersect("sel", "ans"), F.col("ans"))
    lost = F.when(F.size(F.array_except("sel", "ans")) > 0, right_only).otherwise(0.0)
    return rows.groupBy("usr").agg(F.count("*").alias("n"), F.sum(lost).alias("lost")).withColumn("cost", mark20(F.col("lost"), F.col("n")))


@query(P + """, o AS (SELECT p.usr, p.event_id, p.q, opt.i, list_contains(sel, opt.i) AS picked, correct FROM picked p JOIN opt ON opt.q = p.q),
e AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY CASE WHEN picked THEN 0 ELSE 1 END, event_id, i) AS place FROM o WHERE picked <> correct)
SELECT usr, event_id, q, i, picked, place FROM e WHERE place <= 10""")
def proposition_errors(spark, sf_dir):
    rows = S.picked(spark, sf_dir).select("usr", "event_id", "q", "sel", "ans", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_opt") - 1)).alias("i"))
    rows = rows.withColumns({"picked": F.array_contains("sel", F.col("i")), "correct": F.array_contains("ans", F.col("i"))}).where("picked <> correct")
    rows = rows.withColumn("_wrong_first", F.when(F.col("picked"), 0).otherwise(1))
    return ranking.top_k(rows, ["usr"], ["_wrong_first", "event_id", "i"], 10, "place").select("usr", "event_id", "q", "i", "picked", "place")


@query(P + EXAMS + """ SELECT usr, arg_min(scope, (mark, scope)) AS weakest, min(mark) AS mark FROM (SELECT usr, scope, min(mark) AS mark FROM exam GROUP BY ALL) GROUP BY usr""")
def weakest_lecture(spark, sf_dir):
    rows = exams(spark, sf_dir).groupBy("usr", "scope").agg(F.min("mark").alias("mark"))
    return rows.groupBy("usr").agg(F.min_by("scope", F.struct("mark", "scope")).alias("weakest"), F.min("mark").alias("mark"))


@query(P + CLEAN + """, last40 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts DESC, event_id DESC) AS back FROM first_try) WHERE back <= 40)
SELECT usr, count(*) AS tries, count(*) FILTER (WHERE len(list_intersect(sel, ans)) = len(ans) AND len(ans) > 0 AND len(sel) > len(ans)) AS exact_plus_wrong,
 floor(sum(points) / count(*) * 2000 + 0.5) / 100 AS mark_now,
 floor((sum(points) + count(*) FILTER (WHERE len(list_intersect(sel, ans)) = len(ans) AND len(ans) > 0 AND len(sel) > len(ans))) / count(*) * 2000 + 0.5) / 100 AS mark_without FROM last40 GROUP BY usr""")
def tick_habit(spark, sf_dir):
    rows = ranking.top_k(first_tries(marked(spark, sf_dir)), ["usr"], [F.desc("ts"), F.desc("event_id")], 40, "back")
    extra = (F.size(F.array_intersect("sel", "ans")) == F.size("ans")) & (F.size("ans") > 0) & (F.size("sel") > F.size("ans"))
    out = rows.groupBy("usr").agg(F.count("*").alias("tries"), F.count_if(extra).alias("exact_plus_wrong"), F.sum("points").alias("_p"))
    return out.select("usr", "tries", "exact_plus_wrong", mark20(F.col("_p"), F.col("tries")).alias("mark_now"), mark20(F.col("_p") + F.col("exact_plus_wrong"), F.col("tries")).alias("mark_without"))


@query(P + """, m AS (SELECT usr, value >= 20 AS sure, points = 1 AS ok FROM mark)
SELECT usr, count(*) AS n, CASE WHEN count(*) FILTER (WHERE sure) > 0 THEN CAST(floor(100 * count(*) FILTER (WHERE sure AND ok) / count(*) FILTER (WHERE sure) + 0.5) AS BIGINT) END AS sure_pct,
 CASE WHEN count(*) FILTER (WHERE NOT sure) > 0 THEN CAST(floor(100 * count(*) FILTER (WHERE NOT sure AND ok) / count(*) FILTER (WHERE NOT sure) + 0.5) AS BIGINT) END AS unsure_pct FROM m GROUP BY usr HAVING count(*) >= 5""")
def calibration(spark, sf_dir):
    sure, ok = F.col("value") >= 20, F.col("points") == 1
    out = marked(spark, sf_dir).groupBy("usr").agg(F.count("*").alias("n"), F.count_if(sure).alias("_s"), F.count_if(sure & ok).alias("_so"), F.count_if(~sure).alias("_u"), F.count_if(~sure & ok).alias("_uo"))
    share = lambda a, b: F.when(F.col(b) > 0, percent(F.col(a), F.col(b)))
    return out.where("n >= 5").select("usr", "n", share("_so", "_s").alias("sure_pct"), share("_uo", "_u").alias("unsure_pct"))


@query(P + CLEAN + """ SELECT q, count(*) AS n, count(*) FILTER (WHERE points = 1) AS r, CAST(floor(100 * count(*) FILTER (WHERE points = 1) / count(*) + 0.5) AS BIGINT) AS pct
FROM first_try GROUP BY q HAVING count(*) >= 10""")
def class_first_try_rate(spark, sf_dir):
    out = first_tries(marked(spark, sf_dir)).groupBy("q").agg(F.count("*").alias("n"), F.count_if(F.col("points") == 1).alias("r"))
    return out.where("n >= 10").withColumn("pct", percent(F.col("r"), F.col("n")))


@query(P + CLEAN + """, o AS (SELECT q, unnest(sel) AS i FROM first_try), p AS (SELECT q, count(*) FILTER (WHERE len(sel) > 0) AS p FROM first_try GROUP BY q)
SELECT q, i, count(*) AS picks, p, CAST(floor(100 * count(*) / p + 0.5) AS BIGINT) AS pct FROM o JOIN p USING (q) GROUP BY q, i, p""")
def class_option_distribution(spark, sf_dir):
    tries = first_tries(S.picked(spark, sf_dir))
    base = tries.groupBy("q").agg(F.count_if(F.size("sel") > 0).alias("p"))
    return tries.select("q", F.explode("sel").alias("i")).groupBy("q", "i").agg(F.count("*").alias("picks")).join(base, "q").withColumn("pct", percent(F.col("picks"), F.col("p")))


@query(P + CLEAN + """, r AS (SELECT q, count(*) AS n, count(*) FILTER (WHERE points = 1) AS r FROM first_try GROUP BY q)
SELECT q, n, r, place FROM (SELECT *, row_number() OVER (ORDER BY r / n, q) AS place FROM r WHERE n >= 10 AND r / n <= 0.5) WHERE place <= 20""")
def hardest_questions(spark, sf_dir):
    out = first_tries(marked(spark, sf_dir)).groupBy("q").agg(F.count("*").alias("n"), F.count_if(F.col("points") == 1).alias("r"))
    out = out.withColumn("_rate", F.col("r") / F.col("n")).where("n >= 10 AND _rate <= 0.5").orderBy("_rate", "q").limit(20)
    return out.withColumn("place", F.row_number().over(Window.orderBy("_rate", "q")).cast("long")).drop("_rate")


@query(P + """, u AS (SELECT usr, count(*) AS answered, count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30') AS week, max(ts) AS seen FROM attempt GROUP BY usr)
SELECT usr, answered, week, date_diff('day', CAST(seen AS DATE), DATE '2024-01-30') AS days_ago, place FROM (SELECT *, row_number() OVER (ORDER BY answered DESC, usr) AS place FROM u) WHERE place <= 10""")
def leaderboard(spark, sf_dir):
    today = F.lit("2024-01-30").cast("date")
    day = F.to_date("ts")
    out = S.attempts(spark, sf_dir).groupBy("usr").agg(F.count("*").alias("answered"), F.count_if(day.between(F.date_sub(today, 6), today)).alias("week"), F.max("ts").alias("_seen"))
    out = out.orderBy(F.desc("answered"), "usr").limit(10)  # a top-k: each task keeps ten rows
    place = F.row_number().over(Window.orderBy(F.desc("answered"), "usr")).cast("long")
    return out.select("usr", "answered", "week", F.datediff(today, F.to_date("_seen")).cast("long").alias("days_ago"), place.alias("place"))


@query("""WITH v AS (SELECT doc_id % 97 AS note, count(*) AS stars, count(DISTINCT doc_id % 11) AS givers FROM labels WHERE quality = 1 GROUP BY 1)
SELECT note, stars, givers FROM v""")
def star_votes(spark, sf_dir):
    from quizloom.session import read_table

    votes = read_table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 97).alias("note"), (F.col("doc_id") % 11).alias("giver"))
    return votes.groupBy("note").agg(F.count("*").alias("stars"), F.countDistinct("giver").alias("givers"))


@query(P + """, s AS (SELECT usr, points = 1 AS ok, event_id, ts, row_number() OVER (PARTITION BY usr ORDER BY ts, event_id) - row_number() OVER (PARTITION BY usr, points = 1 ORDER BY ts, event_id) AS island FROM mark),
r AS (SELECT usr, count(*) AS len FROM s WHERE ok GROUP BY usr, island)
SELECT u.usr, coalesce(max(len), 0) AS longest, coalesce(max(len), 0) >= 7 AS complete FROM (SELECT DISTINCT usr FROM mark) u LEFT JOIN r USING (usr) GROUP BY u.usr""")
def answer_streak(spark, sf_dir):
    rows = marked(spark, sf_dir).select("usr", "ts", "event_id", (F.col("points") == 1).alias("ok"))
    return ranking.longest_run(rows, ["usr"], ["ts", "event_id"], "ok", "longest").withColumn("complete", F.col("longest") >= 7)


@query(P + """, d AS (SELECT usr, CAST(ts AS DATE) AS day, count(DISTINCT q) AS n FROM attempt GROUP BY ALL),
n AS (SELECT usr, day, row_number() OVER (PARTITION BY usr ORDER BY day) AS nights FROM d WHERE n >= 5)
SELECT usr, CAST(day AS VARCHAR) AS day, nights, nights // 14 AS moons FROM n""")
def study_nights(spark, sf_dir):
    days = S.attempts(spark, sf_dir).groupBy("usr", F.to_date("ts").alias("day")).agg(F.countDistinct("q").alias("_n")).where("_n >= 5")
    nights = F.row_number().over(Window.partitionBy("usr").orderBy("day")).cast("long")
    return days.select("usr", F.col("day").cast("string").alias("day"), nights.alias("nights")).withColumn("moons", F.floor(F.col("nights") / 14).cast("long"))


@query(P + """, u AS (SELECT o_orderkey AS q, CAST(year(o_orderdate) AS BIGINT) AS entry FROM orders WHERE o_orderkey % 3 = 0),
single AS (SELECT o_orderkey AS q, CAST(year(o_orderdate) + 1 AS BIGINT) AS entry FROM orders WHERE o_orderkey % 30 = 0)
SELECT entry, count(*) AS n FROM (SELECT u.entry, u.q FROM u WHERE NOT EXISTS (SELECT 1 FROM single s WHERE s.q = u.q AND s.entry > u.entry)
 UNION SELECT entry, q FROM single) GROUP BY entry""")
def update_counts(spark, sf_dir):
    from quizloom.session import read_table

    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.year("o_orderdate").cast("long").alias("entry"))
    in_sets = orders.where("q % 3 = 0")
    singles = orders.where("q % 30 = 0").withColumn("entry", F.col("entry") + 1)
    return ranking.newest_first_exclusion(in_sets, singles, "entry", "q").groupBy("entry").agg(F.count("*").alias("n"))


@query(P + """ SELECT count(*) AS stored, count(*) FILTER (WHERE was <> now) AS changed, sum(now) AS points_now FROM (SELECT m.points AS now,
 CASE WHEN len(sel) > 0 AND len(list_intersect(sel, list_append(ans, n_opt))) = len(sel) AND len(sel) = len(ans) + 1 THEN 1.0
  WHEN len(sel) > 0 AND len(list_intersect(sel, list_append(ans, n_opt))) = len(sel) AND len(ans) + 1 >= 2 AND 2 * len(sel) >= len(ans) + 1 THEN 0.5 ELSE 0.0 END AS was FROM mark m)""")
def regrade(spark, sf_dir):
    """Stored marks (against an older key with one more option) against marks recomputed from stored picks."""
    rows = marked(spark, sf_dir).withColumn("was", points(F.col("sel"), F.array_append("ans", F.col("n_opt"))))
    return rows.agg(F.count("*").alias("stored"), F.count_if(F.col("was") != F.col("points")).alias("changed"), F.sum("points").alias("points_now"))


#: The tiers of a day's answers.
TIERS = [10, 20, 30, 50, 75, 100, 150]


@query(P + f""", d AS (SELECT usr, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS c FROM attempt GROUP BY ALL)
SELECT usr, day, c, CAST(coalesce((SELECT max(t) FROM (SELECT unnest({TIERS}) AS t) WHERE t <= c), 0) AS BIGINT) AS tier FROM d""")
def day_tiers(spark, sf_dir):
    days = S.attempts(spark, sf_dir).groupBy("usr", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("c"))
    return days.withColumn("tier", ranking.floor_tier(F.col("c"), TIERS))


@query(P + """, f AS (SELECT usr, min(ts) AS t, min_by(event_id, ts) AS e FROM attempt WHERE usr <> 0 GROUP BY usr),
s AS (SELECT usr, row_number() OVER (ORDER BY t, e) AS place FROM f)
SELECT usr, place, CASE WHEN place <= 6 THEN 'Little Bear' ELSE 'Great Bear' END AS bear FROM s WHERE place <= 13""")
def sky_slots(spark, sf_dir):
    first = S.attempts(spark, sf_dir).where("usr <> 0").groupBy("usr").agg(F.min(F.struct("ts", "event_id")).alias("_t")).orderBy("_t").limit(13)
    place = F.row_number().over(Window.orderBy("_t")).cast("long")
    return first.select("usr", place.alias("place")).withColumn("bear", F.when(F.col("place") <= 6, "Little Bear").otherwise("Great Bear"))


@query(P + """, d AS (SELECT usr, CAST(ts AS DATE) AS day, count(*) AS c FROM attempt GROUP BY ALL)
SELECT usr, CAST(day AS VARCHAR) AS day, CAST(sum(c) OVER (PARTITION BY usr ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d""")
def rolling_week(spark, sf_dir):
    days = S.attempts(spark, sf_dir).groupBy("usr", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("usr").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return days.select("usr", F.col("day").cast("string").alias("day"), F.sum("c").over(w).alias("week"))


@query(P + CLEAN + """, o AS (SELECT q, (i * 3 + 1) % n_opt AS lead_i, count(*) AS picks FROM (SELECT q, n_opt, unnest(sel) AS i FROM first_try) GROUP BY ALL),
p AS (SELECT q, count(*) FILTER (WHERE len(sel) > 0) AS p FROM first_try GROUP BY q)
SELECT q, lead_i, CAST(sum(picks) AS BIGINT) AS picks, CAST(floor(100 * sum(picks) / max(p) + 0.5) AS BIGINT) AS pct FROM o JOIN p USING (q) GROUP BY q, lead_i""")
def option_map_counts(spark, sf_dir):
    """Picks on copies counted on the lead's option numbers through an option map."""
    tries = first_tries(S.picked(spark, sf_dir))
    base = tries.groupBy("q").agg(F.count_if(F.size("sel") > 0).alias("p"))
    maps = tries.select("q", "n_opt").distinct().select("q", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_opt") - 1), lambda i: (i * 3 + 1) % F.col("n_opt"))).alias("i", "lead_i"))
    picks = tries.select("q", F.explode("sel").alias("i")).groupBy("q", "i").agg(F.count("*").alias("picks"))
    out = picks.join(maps.withColumn("i", F.col("i").cast("long")), ["q", "i"]).groupBy("q", "lead_i").agg(F.sum("picks").alias("picks"))
    return out.join(base, "q").select("q", "lead_i", "picks", percent(F.col("picks"), F.col("p")).alias("pct"))
