"""State machines over event streams: exams that hand themselves in, and duels that end, expire or are declined.

A machine is a table of transitions, (state, kind of event) to the next state, with a time after which it moves by itself. The
stream keeps each key's events until the watermark has passed them and then takes them in the order of (ts, event_id), so
events may come in any order within the watermark, and events that are sent again count once: while they wait by their id,
and later because they are late. Timers are of event time, so a machine also ends while its user is away. Results are appended
once, when they are certain; what happened after the watermark is not told yet. The batch forms take the same events up to
the same time (`until`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quizloom.session import cut
from quizloom.streaming.live import LATE, drained

#: Times are microseconds, which no session's time zone changes.
EXAM = "usr long, exam long, started long, ends long, handed long, auto boolean, answered long"
#: (state, event) to the next state; other events change nothing. An exam also leaves "runs" at its end.
EXAM_MOVES = {("idle", "start"): "runs", ("runs", "pick"): "runs", ("runs", "hand in"): "idle"}

DUEL = "duel long, state string, first long, second long, winner long, told long"
#: A duel's moves by the event and who it is from: first is the challenger, second the one who is challenged.
DUEL_MOVES = {
    ("none", "invite", "first"): "invited", ("invited", "accept", "second"): "in", ("invited", "decline", "second"): "declined",
    ("in", "hand in", "first"): "first handed in", ("in", "hand in", "second"): "second handed in",
    ("first handed in", "hand in", "second"): "decided", ("second handed in", "hand in", "first"): "decided",
}
ENDS = ("declined", "decided")


KINDS = {"long": int, "double": float, "string": str}


class Ordered(StatefulProcessor):
    """Keeps events until the watermark has passed them, then hands them on in order; a subclass says what they do.

    Each call to the state store is a message to the JVM, so a key's new events are appended by one, and all that have passed are
    read, and the machine's state is read and written, by one each.
    """

    #: The event's columns beside the key, event_id and ts: name and kind.
    FIELDS: list[tuple[str, str]] = []
    #: The machine's state between two calls, and the result's columns.
    STATE, RESULT = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, " + ", ".join(f"{n} {k}" for n, k in self.FIELDS))
        self.kept = handle.getValueState("machine", self.STATE)
        self.row = Row(*[c.split()[0] for c in self.RESULT.split(", ")])

    def take(self, key: tuple, us: int, event_id: int, fields: tuple) -> Iterator[tuple]:
        """Result rows of one event; self.now is the machine's state, or None."""
        raise NotImplementedError

    def pass_time(self, key: tuple, us: int) -> Iterator[tuple]:
        """Result rows of what ends by itself before the time us."""
        raise NotImplementedError

    def next_end(self) -> int | None:
        """When the machine moves by itself."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value = lambda x, k: None if x is None or x != x else KINDS[k](x)
        new = [(int(r.us), int(r.event_id), *[value(r[n], k) for n, k in self.FIELDS]) for r in rows]
        if not new:
            return
        self.waiting.appendList(new)
        first = min(new)[0]
        if first > timerValues.getCurrentWatermarkInMs() * 1000:
            self.handle.registerTimer(-(-first // 1000))
        else:
            yield from self.advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key, timerValues)

    def advance(self, key: tuple, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # an event that was sent again waits once
        waiting = sorted({x[1]: tuple(x) for x in self.waiting.get()}.values(), key=lambda x: x[:2])
        before = self.now = self.kept.get()
        out, done = [], 0
        for us, event_id, *fields in waiting:
            if us > passed:
                break
            out += self.pass_time(key, us)
            out += self.take(key, us, event_id, tuple(fields))
            done += 1
        out += self.pass_time(key, passed + 1)
        if done == len(waiting):
            self.waiting.clear()
        elif done:
            self.waiting.put(waiting[done:])
        if self.now is None and before is not None:
            self.kept.clear()
        elif self.now != before:
            self.kept.update(self.now)
        later = [x[0] for x in waiting[done:][:1]] + [t for t in [self.next_end()] if t is not None]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if later:
            self.handle.registerTimer(-(-min(later) // 1000))
        yield from (self.row(*x) for x in out)

    def close(self) -> None:
        pass


class Exams(Ordered):
    """One exam at a time a user; a start while one runs changes nothing."""

    FIELDS = [("kind", "string"), ("q", "long"), ("minutes", "long")]
    STATE, RESULT = "exam long, started long, ends long, picks array<long>", EXAM

    def _log(self, key: tuple, handed: int, auto: bool) -> Iterator[tuple]:
        exam, started, ends, picks = self.now
        self.now = None
        yield (key[0], exam, started, ends, handed, auto, len(picks))

    def take(self, key: tuple, us: int, event_id: int, fields: tuple) -> Iterator[tuple]:
        kind, q, minutes = fields
        state = "runs" if self.now is not None else "idle"
        to = EXAM_MOVES.get((state, kind))
        if state == "idle" and to == "runs":
            self.now = (event_id, us, us + int(minutes) * 60_000_000, [])
        elif kind == "pick" and to == "runs" and q is not None:
            if q not in self.now[3]:
                self.now = (*self.now[:3], [*self.now[3], q])
        elif to == "idle":
            yield from self._log(key, us, False)

    def pass_time(self, key: tuple, us: int) -> Iterator[tuple]:
        if self.now is not None and self.now[2] < us:
            yield from self._log(key, self.now[2], True)

    def next_end(self) -> int | None:
        return self.now[2] if self.now is not None else None


class Duels(Ordered):
    """A duel's state by what its two players do; it expires when it is not decided in time."""

    FIELDS = [("kind", "string"), ("usr", "long"), ("other", "long"), ("mark", "double")]
    STATE, RESULT = "state string, first long, second long, first_mark double, second_mark double, ends long", DUEL

    def __init__(self, days: int):
        self.days = days

    def take(self, key: tuple, us: int, event_id: int, fields: tuple) -> Iterator[tuple]:
        kind, usr, other, mark = fields
        state, first, second, *marks, ends = self.now if self.now is not None else ("none", usr, other, None, None, us + self.days * 86_400_000_000)
        who = "first" if usr == first else "second" if usr == second else None
        to = DUEL_MOVES.get((state, kind, who))
        if to is None or (state == "none" and (second is None or first == second)):
            return
        if kind == "hand in":
            marks[0 if who == "first" else 1] = float(mark or 0.0)
        self.now = (to, first, second, *marks, ends)
        if to in ENDS:
            winner = None if to == "declined" or marks[0] == marks[1] else first if marks[0] > marks[1] else second
            yield (key[0], to, first, second, winner, us)

    def pass_time(self, key: tuple, us: int) -> Iterator[tuple]:
        if self.now is not None:
            state, first, second, _, _, ends = self.now
            if state not in (*ENDS, "expired") and ends < us:
                self.now = ("expired", first, second, None, None, ends)
                yield (key[0], "expired", first, second, None, ends)

    def next_end(self) -> int | None:
        return self.now[5] if self.now is not None and self.now[0] not in (*ENDS, "expired") else None


def with_times(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in columns})


def exams_stream(events: DataFrame) -> DataFrame:
    """The log of exams (EXAM) of a stream of events: event_id, usr, ts, kind (start, pick, hand in), q, minutes."""
    rows = events.select("event_id", "usr", "ts", F.unix_micros("ts").alias("us"), "kind", "q", "minutes").withWatermark("ts", LATE)
    return with_times(rows.groupBy("usr").transformWithState(Exams(), EXAM, "Append", "EventTime"), ["started", "ends", "handed"])


def duels_stream(events: DataFrame, days: int = 7) -> DataFrame:
    """The ends of duels (DUEL) of a stream of events: event_id, duel, ts, kind (invite, accept, decline, hand in), usr, other, mark."""
    rows = events.select("event_id", "duel", "ts", F.unix_micros("ts").alias("us"), "kind", "usr", "other", "mark").withWatermark("ts", LATE)
    return with_times(rows.groupBy("duel").transformWithState(Duels(days), DUEL, "Append", "EventTime"), ["told"])


def watermark_of(events: DataFrame) -> DataFrame:
    """One row: the time until which a stream over all these events is certain."""
    return events.agg((F.date_trunc("millisecond", F.max("ts")) - F.expr(f"INTERVAL {LATE}")).alias("until"))


def exams_batch(events: DataFrame, until: DataFrame) -> DataFrame:
    """The same log by windows: each start's end and the start after it are known without the others.

    Which starts begin exams follows by doubling steps along those links, in about log2 of a user's starts rounds.
    """
    rows = cut(events.dropDuplicates(["event_id"]).crossJoin(F.broadcast(until)).where("ts <= until"))
    back = Window.partitionBy("usr").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.withColumn("_hand", F.last(F.when(F.col("kind") == "hand in", F.struct("ts", "event_id")), ignorenulls=True).over(back)).where("kind = 'start'")
    ends = F.col("ts") + F.make_dt_interval(mins=F.col("minutes").cast("int"))
    auto = F.coalesce(F.col("_hand.ts") > F.col("_ends"), F.lit(True))
    starts = starts.withColumn("_ends", ends).withColumn("auto", auto)
    # an exam is over at its hand-in, or just after all events at its end
    over = F.when(F.col("auto"), F.struct(F.col("_ends").alias("ts"), F.lit((1 << 63) - 1).alias("event_id"))).otherwise(F.col("_hand"))
    starts = cut(starts.select("usr", "ts", "event_id", F.col("_ends").alias("ends"), over.alias("over"), "auto", "until"))
    marks = starts.select("usr", F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.col("event_id").alias("start"), F.lit(None).cast("long").alias("of"))
    marks = marks.unionByName(starts.select("usr", F.col("over.ts").alias("at"), F.col("over.event_id").alias("tie"), F.lit(None).cast("long").alias("start"), F.col("event_id").alias("of")))
    back = Window.partitionBy("usr").orderBy(F.desc("at"), F.desc("tie"), "start").rowsBetween(Window.unboundedPreceding, -1)
    links = marks.withColumn("next", F.last("start", ignorenulls=True).over(back)).where("of IS NOT NULL").select("usr", F.col("of").alias("start"), "next")
    first = starts.groupBy("usr").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("start"))
    reached, links = cut(first), cut(links.where("next IS NOT NULL"))
    while not links.isEmpty():
        reached = cut(reached.unionByName(reached.join(links, ["usr", "start"]).select("usr", F.col("next").alias("start"))).distinct())
        ahead = links.select("usr", F.col("start").alias("next"), F.col("next").alias("_next"))
        links = cut(links.join(ahead, ["usr", "next"]).select("usr", "start", F.col("_next").alias("next")))
    real = starts.join(reached.withColumnRenamed("start", "event_id"), ["usr", "event_id"]).where("NOT auto OR ends <= until")
    picks = rows.where("kind = 'pick' AND q IS NOT NULL").select("usr", "ts", "event_id", "q")
    lanes = picks.withColumn("exam", F.lit(None).cast("struct<event_id:bigint,over:struct<ts:timestamp,event_id:bigint>>"))
    lanes = lanes.unionByName(real.select("usr", "ts", "event_id", F.lit(None).cast("long").alias("q"), F.struct("event_id", "over").alias("exam")))
    forth = Window.partitionBy("usr").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    within = lanes.withColumn("_in", F.last("exam", ignorenulls=True).over(forth)).where("q IS NOT NULL AND struct(ts, event_id) < _in.over")
    answered = within.groupBy(F.col("_in.event_id").alias("event_id")).agg(F.count_distinct("q").alias("answered"))
    out = real.join(answered, "event_id", "left")
    return out.select("usr", F.col("event_id").alias("exam"), F.col("ts").alias("started"), "ends", F.col("over.ts").alias("handed"), "auto", F.coalesce("answered", F.lit(0)).alias("answered"))


def duels_batch(events: DataFrame, until: DataFrame, days: int = 7) -> DataFrame:
    """The same ends by aggregates, as each state is entered once: the first invitation, then the first answer after it, then marks.

    events of a duel are those of its players; a duel has few of them, but none are gathered.
    """
    rows = events.dropDuplicates(["event_id"]).crossJoin(F.broadcast(until)).where("ts <= until")
    rows = cut(rows.withColumn("at", F.struct("ts", "event_id")))
    invited = rows.where("kind = 'invite' AND other IS NOT NULL AND usr <> other").groupBy("duel").agg(F.min_by(F.struct("usr", "other", "at"), "at").alias("_i"), F.first("until").alias("until"))
    invited = invited.select("duel", F.col("_i.usr").alias("first"), F.col("_i.other").alias("second"), F.col("_i.at").alias("made"), "until", (F.col("_i.at.ts") + F.make_dt_interval(days=F.lit(days))).alias("ends"))
    own = cut(rows.select("duel", "kind", "usr", "mark", "at").join(invited, "duel").where("at > made AND at.ts <= ends"))
    answer = own.where("usr = second AND kind IN ('accept', 'decline')").groupBy("duel").agg(F.min_by("kind", "at").alias("answer"), F.min("at").alias("answered"))
    handed = own.where("kind = 'hand in' AND usr IN (first, second)").join(answer.where("answer = 'accept'"), "duel").where("at > answered")
    handed = handed.groupBy("duel", "usr").agg(F.min_by(F.coalesce("mark", F.lit(0.0)), "at").alias("mark"), F.min("at").alias("at"))
    both = handed.join(invited.select("duel", "first"), "duel").groupBy("duel").agg(
        F.count("*").alias("n"), F.max("at").alias("last"), F.max(F.when(F.col("usr") == F.col("first"), F.col("mark"))).alias("_f"), F.max(F.when(F.col("usr") != F.col("first"), F.col("mark"))).alias("_s")
    )
    out = invited.join(answer, "duel", "left").join(both, "duel", "left")
    decided, declined = F.col("n") == 2, F.col("answer") == "decline"
    state = F.when(decided, "decided").when(declined, "declined").when(F.col("ends") <= F.col("until"), "expired")
    winner = F.when(decided & (F.col("_f") > F.col("_s")), F.col("first")).when(decided & (F.col("_f") < F.col("_s")), F.col("second"))
    told = F.when(decided, F.col("last.ts")).when(declined, F.col("answered.ts")).otherwise(F.col("ends"))
    return out.select("duel", state.alias("state"), "first", "second", winner.alias("winner"), told.alias("told")).where("state IS NOT NULL")


def colours(duels: DataFrame, keep_days: int = 7) -> DataFrame:
    """usr, duel, since, until: who holds a colour of the sky, by decided duels in the order of (told, duel).

    A winner takes a colour for keep_days; winning again renews it. Losing, or the time's end, gives it back.
    """
    ended = duels.where("state = 'decided' AND winner IS NOT NULL").select("duel", "told", "winner", F.when(F.col("winner") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("loser"))
    turns = ended.select("duel", "told", F.col("winner").alias("usr"), F.lit(True).alias("won")).unionByName(ended.select("duel", "told", F.col("loser").alias("usr"), F.lit(False).alias("won")))
    after = F.lead("told").over(Window.partitionBy("usr").orderBy("told", "duel", "won"))
    held = turns.withColumn("_after", after).where("won")
    return held.select("usr", "duel", F.col("told").alias("since"), F.least(F.coalesce("_after", F.expr(f"told + INTERVAL {keep_days} DAYS")), F.expr(f"told + INTERVAL {keep_days} DAYS")).alias("until"))


def drained_in_order(stream: DataFrame, name: str) -> DataFrame:
    """live.drained, with the state store that machines need."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drained(stream, name)
    finally:
        spark.conf.set(key, before)
