"""Exams and duels: streams equal batches, also when events are sent again, come out of order, or the stream is broken off."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from quizloom.streaming import machines

EVENTS = "event_id long, usr long, ts timestamp, kind string, q long, minutes long"
DUELS = "event_id long, duel long, ts timestamp, kind string, usr long, other long, mark double"
T0 = datetime(2024, 3, 1)


def exam_events(n, users, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["start", "pick", "pick", "pick", "hand in"])
        rows.append((i, r.randrange(users), T0 + timedelta(minutes=r.randrange(3000)), kind, r.choice([None, 1, 2, 3, 4]), r.choice([20, 25, 50])))
    return sorted(rows, key=lambda x: x[2])


def exams_by_hand(rows, until):
    """One pass over each user's events."""
    out = []
    for usr in {x[1] for x in rows}:
        exam = None
        for event_id, _, ts, kind, q, minutes in [*sorted({x for x in rows if x[1] == usr and x[2] <= until}, key=lambda x: (x[2], x[0])), (None, usr, until + timedelta(microseconds=1), "", None, 0)]:
            if exam and exam[2] < ts:
                out.append((usr, *exam[:3], exam[2], True, len(exam[3])))
                exam = None
            if kind == "start" and exam is None:
                exam = (event_id, ts, ts + timedelta(minutes=minutes), set())
            elif kind == "pick" and exam and q is not None:
                exam[3].add(q)
            elif kind == "hand in" and exam:
                out.append((usr, *exam[:3], ts, False, len(exam[3])))
                exam = None
    return sorted(out)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, make, schema, path, out, state):
    """What the stream appended on what is there now; called again, it goes on where it stopped."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = make(spark.readStream.schema(schema).parquet(path))
    stream.writeStream.outputMode("append").option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(key, before)
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect())


def test_exams(spark, tmp_path):
    rows = exam_events(260, 5, 3)
    until = max(x[2] for x in rows) - timedelta(hours=1)
    want = exams_by_hand(rows, until)
    assert {x[5] for x in want} == {True, False} and len(want) > 30
    frame = spark.createDataFrame(rows + rows[:50], EVENTS)
    assert sorted(tuple(r) for r in machines.exams_batch(frame, machines.watermark_of(frame)).collect()) == want
    # three parts in time, each stirred, with events sent again; the stream starts anew for each part from its checkpoint
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    r = random.Random(1)
    for k in range(3):
        part = rows[k * 90 : (k + 1) * 90] + rows[max(0, k * 90 - 20) : k * 90]
        r.shuffle(part)
        write(spark, part, EVENTS, path)
        got = run(spark, machines.exams_stream, EVENTS, path, out, state)
    assert got == want
    assert run(spark, machines.exams_stream, EVENTS, path, out, state) == want


def test_exam_edges(spark):
    m = lambda x: T0 + timedelta(minutes=x)
    rows = [
        (1, 1, m(0), "start", None, 20), (2, 1, m(5), "start", None, 50), (3, 1, m(20), "pick", 9, None), (4, 1, m(20), "hand in", None, None), (5, 1, m(20), "start", None, 20), (6, 1, m(41), "pick", 1, None),
        (7, 2, m(0), "hand in", None, None), (8, 2, m(1), "pick", 1, None), (9, 2, m(2), "start", None, 25), (10, 2, m(2), "pick", None, None), (11, 3, m(10), "start", None, 50), (12, 9, m(100), "pick", 1, None), (13, 4, m(39), "start", None, 50),
    ]
    frame = spark.createDataFrame(rows, EVENTS)
    got = sorted(tuple(r) for r in machines.exams_batch(frame, machines.watermark_of(frame)).collect())
    assert got == exams_by_hand(rows, m(40)) == [(1, 1, m(0), m(20), m(20), False, 1), (1, 5, m(20), m(40), m(40), True, 0), (2, 9, m(2), m(27), m(27), True, 0)]
    none = spark.createDataFrame([], EVENTS)
    assert machines.exams_batch(none, machines.watermark_of(none)).collect() == []


def duels_by_hand(rows, until, days):
    out, state = [], {}
    for event_id, duel, ts, kind, usr, other, mark in [*sorted({x for x in rows if x[2] <= until}, key=lambda x: (x[2], x[0])), (None, None, until + timedelta(microseconds=1), "", None, None, None)]:
        for d, s in state.items():
            if s["state"] not in ("declined", "decided", "expired") and s["ends"] < ts:
                s["state"] = "expired"
                out.append((d, "expired", s["first"], s["second"], None, s["ends"]))
        s = state.get(duel)
        if s is None:
            if kind == "invite" and other is not None and usr != other:
                state[duel] = {"state": "invited", "first": usr, "second": other, "ends": ts + timedelta(days=days), "marks": {}}
        elif s["state"] == "invited" and usr == s["second"] and kind in ("accept", "decline"):
            s["state"] = "in" if kind == "accept" else "declined"
            if kind == "decline":
                out.append((duel, "declined", s["first"], s["second"], None, ts))
        elif s["state"] == "in" and kind == "hand in" and usr in (s["first"], s["second"]):
            s["marks"].setdefault(usr, mark or 0.0)
            if len(s["marks"]) == 2:
                f, g = s["marks"][s["first"]], s["marks"][s["second"]]
                s["state"] = "decided"
                out.append((duel, "decided", s["first"], s["second"], s["first"] if f > g else s["second"] if g > f else None, ts))
    return sorted(out, key=repr)


def test_duels(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for i in range(1400):
        duel = r.randrange(60)
        a, b = r.sample([duel * 3, duel * 3 + 1, duel * 3 + 2], 2) if r.random() < 0.2 else r.sample([duel * 3, duel * 3 + 1], 2)
        rows.append((i, duel, T0 + timedelta(minutes=60 * duel + r.randrange(4000)), r.choice(["invite", "accept", "accept", "decline", "hand in", "hand in", "hand in"]), a, r.choice([b, b, b, None, a]), r.choice([None, 1.0, 1.0, 2.0])))
    rows.sort(key=lambda x: x[2])
    until = max(x[2] for x in rows) - timedelta(hours=1)
    want = duels_by_hand(rows, until, 1)
    assert {x[1] for x in want} == {"declined", "decided", "expired"} and any(x[1] == "decided" and x[4] is None for x in want)
    frame = spark.createDataFrame(rows + rows[:99], DUELS)
    assert sorted((tuple(x) for x in machines.duels_batch(frame, machines.watermark_of(frame), 1).collect()), key=repr) == want
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):
        write(spark, rows[k * 700 : (k + 1) * 700] + rows[max(0, k * 700 - 30) : k * 700], DUELS, path)
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key)
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        machines.duels_stream(spark.readStream.schema(DUELS).parquet(path), 1).writeStream.option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        spark.conf.set(key, before)
    assert sorted((tuple(x) for x in spark.read.parquet(out).collect()), key=repr) == want


def test_colours(spark):
    t = lambda d: T0 + timedelta(days=d)
    rows = [(1, "decided", 7, 8, 7, t(0)), (2, "decided", 7, 9, 7, t(3)), (3, "decided", 8, 7, 8, t(5)), (4, "declined", 7, 8, None, t(6)), (5, "decided", 9, 8, None, t(7)), (6, "decided", 8, 9, 9, t(20))]
    got = machines.colours(spark.createDataFrame(rows, "duel long, state string, first long, second long, winner long, told timestamp"))
    assert sorted(tuple(r) for r in got.collect()) == [(7, 1, t(0), t(3)), (7, 2, t(3), t(5)), (8, 3, t(5), t(12)), (9, 6, t(20), t(27))]
    assert got.where(F.col("until") <= F.col("since")).isEmpty()


def test_machines_send_few_messages_to_the_state_store():
    """A key's new events are one message, and all that have passed are read, taken and put away by one each."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def __getattr__(self, method):
            def call(*args):
                calls.append((self.name, method))
                if method in ("put", "appendList"):
                    self.rows = [*(self.rows if method == "appendList" else []), *args[0]]
                if method == "update":
                    self.rows = [args[0]]
                if method == "clear":
                    self.rows = []
                if self.name == "machine":
                    return self.rows[0] if method == "get" and self.rows else None
                return list(self.rows) if method == "get" else None

            return call

    class Handle:
        getListState = getValueState = staticmethod(lambda name, schema: State(name))
        listTimers = staticmethod(lambda: calls.append(("timers", "list")) or [])
        registerTimer = staticmethod(lambda at: calls.append(("timers", "register")))

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    event = Row("event_id", "us", "kind", "usr", "other", "mark")
    rows = [event(1, 1_000_000, "invite", 7, 8, None), event(2, 2_000_000, "accept", 8, 7, None)] + [event(i, i * 1_000_000, "hand in", 7 + i % 2, 8 - i % 2, 1.0 * i) for i in range(3, 500)]
    duels = machines.Duels(3)
    duels.init(Handle)
    assert list(duels.handleInputRows((5,), iter(rows + rows[:9]), At(0))) == []
    assert [tuple(x) for x in duels.handleExpiredTimer((5,), At(10_000_000), None)] == [(5, "decided", 7, 8, 7, 4_000_000)]
    assert len(calls) < 10
