"""Stream-like behaviours, as batch queries and as streams over the same events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.plans.registry import query
from quizloom.session import read_table, scoped
from quizloom.sources import standins as S
from quizloom.streaming import live, machines

DAILY = "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL"
SETTLED = """WITH e AS (SELECT user_id AS usr, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY usr ORDER BY ts, event_id) AS g FROM e)
SELECT usr, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM s GROUP BY usr, g"""


def _events(spark, sf_dir):
    return live.attempts(read_table(spark, sf_dir, "events"))


@query(DAILY)
def daily_counts(spark, sf_dir):
    return live.daily_counts(_events(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(DAILY)
def daily_counts_stream(spark, sf_dir):
    stream = live.daily_counts(live.attempts(live.event_stream(spark, sf_dir)))
    return live.drained(stream, "quizloom_daily", "complete").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(SETTLED)
def settled_changes(spark, sf_dir):
    return live.settled(_events(spark, sf_dir), "6 hours").select("usr", "event_id", "n")


@query(SETTLED)
def settled_changes_stream(spark, sf_dir):
    stream = live.settled(live.attempts(live.event_stream(spark, sf_dir)), "6 hours")
    return live.drained(stream, "quizloom_settled", "complete").select("usr", "event_id", "n")


@query("SELECT q, count(DISTINCT user_id) AS users FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS q FROM events) GROUP BY q")
def counted_once(spark, sf_dir):
    return live.once(_events(spark, sf_dir), ["usr", "q"]).groupBy("q").agg(F.count("*").alias("users"))


@query("SELECT q, count(DISTINCT user_id) AS users FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS q FROM events) GROUP BY q")
def counted_once_stream(spark, sf_dir):
    stream = live.once(live.attempts(live.event_stream(spark, sf_dir)), ["usr", "q"]).select("usr", "q")
    return live.drained(stream, "quizloom_once").groupBy("q").agg(F.count("*").alias("users"))


THROTTLED = """WITH RECURSIVE e AS (SELECT user_id AS usr, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT usr, n, ts, event_id, ts AS last, TRUE AS ok FROM e WHERE n = 1
 UNION ALL SELECT e.usr, e.n, e.ts, e.event_id, CASE WHEN e.ts - t.last >= INTERVAL 3 HOURS THEN e.ts ELSE t.last END, e.ts - t.last >= INTERVAL 3 HOURS FROM t JOIN e ON e.usr = t.usr AND e.n = t.n + 1)
SELECT usr, event_id FROM t WHERE ok"""


@query(THROTTLED)
def throttled_writes(spark, sf_dir):
    return live.throttled(_events(spark, sf_dir), 3 * 3600).select("usr", "event_id")


@query(THROTTLED)
def throttled_writes_stream(spark, sf_dir):
    stream = live.throttled(live.attempts(live.event_stream(spark, sf_dir)), 3 * 3600)
    return live.drained(stream, "quizloom_throttled").select("usr", "event_id")


@query("""WITH x AS (SELECT o_orderkey AS exam, o_orderdate AS start, o_orderdate + INTERVAL 50 MINUTES AS fin, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + (o_orderkey % 70) * INTERVAL 1 MINUTE END AS hand_in FROM orders)
SELECT exam, strftime(least(coalesce(hand_in, fin), fin), '%Y-%m-%d %H:%M:%S') AS handed, hand_in IS NULL OR hand_in > fin AS auto FROM x""")
def exams_handed_in(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS exam", "o_orderdate + INTERVAL 50 MINUTES AS end", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + make_dt_interval(0, 0, o_orderkey % 70) END AS hand_in")
    return live.handed_in(rows).withColumn("handed", F.date_format("handed", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH d AS (SELECT event_id % 40 AS colour, user_id AS usr, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT colour, arg_max(usr, (ts, event_id)) AS owner, count(*) AS duels, strftime(max(ts) + INTERVAL 7 DAYS, '%Y-%m-%d %H:%M') AS until FROM d GROUP BY colour""")
def colour_owners(spark, sf_dir):
    rows = _events(spark, sf_dir).where("kind = 'purchase'").withColumn("colour", F.col("event_id") % 40)
    out = rows.groupBy("colour").agg(F.max_by("usr", F.struct("ts", "event_id")).alias("owner"), F.count("*").alias("duels"), F.max("ts").alias("_t"))
    return out.select("colour", "owner", "duels", F.date_format(F.expr("_t + INTERVAL 7 DAYS"), "yyyy-MM-dd HH:mm").alias("until"))


@query("WITH " + S.SQL + """, n AS (SELECT event_id % 25 AS duel, usr, sum(points) AS pts FROM mark GROUP BY ALL)
SELECT duel, usr, pts, place FROM (SELECT *, rank() OVER (PARTITION BY duel ORDER BY pts DESC) AS place, row_number() OVER (PARTITION BY duel ORDER BY pts DESC, usr) AS n FROM n) WHERE n <= 8""")
def party_ranks(spark, sf_dir):
    from quizloom.plans.marks import marked

    n = marked(spark, sf_dir).groupBy((F.col("event_id") % 25).alias("duel"), "usr").agg(F.sum("points").alias("pts"))
    w = Window.partitionBy("duel")
    n = n.withColumns({"place": F.rank().over(w.orderBy(F.desc("pts"))).cast("long"), "_n": F.row_number().over(w.orderBy(F.desc("pts"), "usr"))})
    return n.where("_n <= 8").drop("_n")


@query("WITH " + S.SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY usr, q ORDER BY ts, event_id) = 1 OR kind = 'purchase' AS clean FROM attempt)
SELECT usr, q, arg_max(kind, (ts, event_id)) AS kind FROM c WHERE clean GROUP BY usr, q""")
def latest_clean_try(spark, sf_dir):
    """First tries and exams are clean; an exam's answer replaces the clean one before it."""
    first = F.row_number().over(Window.partitionBy("usr", "q").orderBy("ts", "event_id")) == 1
    rows = _events(spark, sf_dir).withColumn("clean", first | (F.col("kind") == "purchase")).where("clean")
    return rows.groupBy("usr", "q").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))


#: Stand-ins: a signup starts an exam of 20, 25 or 50 questions at 36 minutes each, a click picks, a purchase hands in.
EXAM_KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'pick' WHEN 'purchase' THEN 'hand in' ELSE 'other' END"
SIZES, MINUTES = [20, 25, 50], 36
LAST = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"
LAST_EXAM = LAST.replace("FROM events", f"FROM events WHERE {EXAM_KIND} <> 'other'")
EXAM_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS usr, event_id, ts, {EXAM_KIND} AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS q,
  ts + {MINUTES} * {SIZES}[event_id % 3 + 1] * INTERVAL 1 MINUTE AS ends FROM events WHERE ts <= {LAST_EXAM}),
s AS MATERIALIZED (SELECT s.usr, s.event_id AS exam, s.ts AS started, s.ends, min(h.ts) FILTER (WHERE h.ts <= s.ends) AS hand, arg_min(h.event_id, (h.ts, h.event_id)) FILTER (WHERE h.ts <= s.ends) AS hand_id
  FROM (SELECT * FROM e WHERE kind = 'start') s LEFT JOIN (SELECT * FROM e WHERE kind = 'hand in') h ON h.usr = s.usr AND (h.ts, h.event_id) > (s.ts, s.event_id) GROUP BY ALL),
o AS MATERIALIZED (SELECT *, coalesce(hand, ends) AS handed, hand IS NULL AS auto, coalesce(hand_id, 9223372036854775807) AS tie FROM s),
n AS MATERIALIZED (SELECT x.usr, x.exam, arg_min(y.exam, (y.started, y.exam)) AS next FROM o x JOIN o y ON y.usr = x.usr AND (y.started, y.exam) > (x.handed, x.tie) GROUP BY ALL),
r AS (SELECT usr, arg_min(exam, (started, exam)) AS exam FROM o GROUP BY usr UNION ALL SELECT r.usr, n.next FROM r JOIN n USING (usr, exam)),
l AS (SELECT o.* FROM o JOIN r USING (usr, exam) WHERE NOT auto OR ends <= {LAST_EXAM})
SELECT l.usr, exam, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(handed, '%Y-%m-%d %H:%M:%S') AS handed, auto, count(DISTINCT e.q) AS answered
FROM l LEFT JOIN e ON e.usr = l.usr AND e.kind = 'pick' AND (e.ts, e.event_id) > (started, exam) AND (e.ts, e.event_id) < (handed, tie) GROUP BY l.usr, exam, started, handed, auto"""


def exam_events(events):
    minutes = F.element_at(F.array(*map(F.lit, SIZES)), (F.col("event_id") % 3 + 1).cast("int")) * MINUTES
    rows = events.select("event_id", F.col("user_id").alias("usr"), F.col("ts").cast("timestamp").alias("ts"), F.expr(EXAM_KIND).alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("q"), minutes.cast("long").alias("minutes"))
    return rows.where("kind <> 'other'")


def exam_rows(log):
    told = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return log.select("usr", "exam", told("started"), told("handed"), "auto", "answered")


@query(EXAM_SQL)
@scoped
def exam_sessions(spark, sf_dir):
    """Exams from their start to the hand-in or the end of their time, each once, and how many questions were answered."""
    rows = exam_events(read_table(spark, sf_dir, "events"))
    return exam_rows(machines.exams_batch(rows, machines.watermark_of(rows)))


@query(EXAM_SQL)
def exam_sessions_stream(spark, sf_dir):
    """The same by the state machine with event-time timers."""
    return exam_rows(machines.drained_in_order(machines.exams_stream(exam_events(live.event_stream(spark, sf_dir))), "quizloom_exams"))


#: Stand-ins: every 12 events are a duel of its first two players; even ids invite or accept, and so on by the event's type.
DUEL_EVENTS = """SELECT event_id, event_id // 12 AS duel, ts, CASE event_type WHEN 'signup' THEN 'invite' WHEN 'view' THEN 'accept' WHEN 'error' THEN 'decline' ELSE 'hand in' END AS kind,
  event_id // 12 * 2 + event_id % 2 AS usr, event_id // 12 * 2 + 1 - event_id % 2 AS other, value AS mark FROM events"""
DUEL_SQL = f"""WITH e AS MATERIALIZED (SELECT * FROM ({DUEL_EVENTS}) WHERE ts <= {LAST}),
i AS (SELECT duel, arg_min(usr, (ts, event_id)) AS first, arg_min(other, (ts, event_id)) AS second, min(ts) AS made, arg_min(event_id, (ts, event_id)) AS tie FROM e WHERE kind = 'invite' GROUP BY duel),
w AS MATERIALIZED (SELECT e.*, first, second, made + INTERVAL {{days}} DAYS AS ends FROM e JOIN i USING (duel) WHERE (ts, event_id) > (made, tie) AND ts <= made + INTERVAL {{days}} DAYS),
a AS (SELECT duel, arg_min(kind, (ts, event_id)) AS answer, min(ts) AS answered, arg_min(event_id, (ts, event_id)) AS answer_id FROM w WHERE usr = second AND kind IN ('accept', 'decline') GROUP BY duel),
h AS (SELECT duel, usr, first, arg_min(mark, (ts, event_id)) AS mark, min(ts) AS ts FROM w JOIN a USING (duel) WHERE answer = 'accept' AND kind = 'hand in' AND (ts, event_id) > (answered, answer_id) GROUP BY ALL),
b AS (SELECT duel, count(*) AS n, max(ts) AS last, max(mark) FILTER (WHERE usr = first) AS f, max(mark) FILTER (WHERE usr <> first) AS s FROM h GROUP BY duel),
d AS (SELECT duel, CASE WHEN n = 2 THEN 'decided' WHEN answer = 'decline' THEN 'declined' WHEN made + INTERVAL {{days}} DAYS <= {LAST} THEN 'expired' END AS state, first, second,
  CASE WHEN n = 2 AND f > s THEN first WHEN n = 2 AND f < s THEN second END AS winner, CASE WHEN n = 2 THEN last WHEN answer = 'decline' THEN answered ELSE made + INTERVAL {{days}} DAYS END AS told
  FROM i LEFT JOIN a USING (duel) LEFT JOIN b USING (duel))"""
DUEL_DAYS = 3
DUELS = DUEL_SQL.replace("{days}", str(DUEL_DAYS)) + " SELECT duel, state, first, second, winner, strftime(told, '%Y-%m-%d %H:%M:%S') AS told FROM d WHERE state IS NOT NULL"


def duel_events(events):
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'invite' WHEN 'view' THEN 'accept' WHEN 'error' THEN 'decline' ELSE 'hand in' END")
    duel = F.floor(F.col("event_id") / 12)
    side = F.col("event_id") % 2
    return events.select("event_id", duel.alias("duel"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (duel * 2 + side).alias("usr"), (duel * 2 + 1 - side).alias("other"), F.col("value").alias("mark"))


@query(DUELS)
@scoped
def duel_states(spark, sf_dir):
    """Duels that ended: decided by both marks, declined, or expired."""
    rows = duel_events(read_table(spark, sf_dir, "events"))
    rows = machines.duels_batch(rows, machines.watermark_of(rows), DUEL_DAYS)
    return rows.withColumn("told", F.date_format("told", "yyyy-MM-dd HH:mm:ss"))


@query(DUELS)
def duel_states_stream(spark, sf_dir):
    """The same by the state machine, which expires duels by timers."""
    rows = machines.drained_in_order(machines.duels_stream(duel_events(live.event_stream(spark, sf_dir)), DUEL_DAYS), "quizloom_duels")
    return rows.withColumn("told", F.date_format("told", "yyyy-MM-dd HH:mm:ss"))


@query(DUEL_SQL.replace("{days}", str(DUEL_DAYS)) + """, w2 AS (SELECT duel, told, winner, CASE WHEN winner = first THEN second ELSE first END AS loser FROM d WHERE state = 'decided' AND winner IS NOT NULL),
t AS (SELECT duel, told, winner % 40 AS usr, TRUE AS won FROM w2 UNION ALL SELECT duel, told, loser % 40, FALSE FROM w2),
n AS (SELECT *, lead(told) OVER (PARTITION BY usr ORDER BY told, duel, won) AS after FROM t)
SELECT usr, duel, strftime(told, '%Y-%m-%d %H:%M:%S') AS since, strftime(least(coalesce(after, told + INTERVAL 7 DAYS), told + INTERVAL 7 DAYS), '%Y-%m-%d %H:%M:%S') AS until FROM n WHERE won""")
@scoped
def duel_colours(spark, sf_dir):
    """Who holds a colour and how long: taken by winning, given back by losing or after seven days (players folded to 40)."""
    rows = duel_events(read_table(spark, sf_dir, "events"))
    rows = machines.duels_batch(rows, machines.watermark_of(rows), DUEL_DAYS)
    held = machines.colours(rows.withColumns({c: F.col(c) % 40 for c in ("first", "second", "winner")}))
    return held.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("since", "until")})
