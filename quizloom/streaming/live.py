"""Stream-like behaviour: each operator takes a batch or a streaming DataFrame and means the same on both.

Late data: one hour of watermark (our design). Sinks that keep state in tables use foreachBatch with one write a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.session import scratch_path

LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, file: str = "events.parquet") -> DataFrame:
    """The events as a file stream; the schema is read from the file, as streams take none by themselves."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def attempts(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("usr"), F.get_json_object("props", "$.k").cast("long").alias("q"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key counts once, whatever is sent again."""
    return rows.withWatermark("ts", LATE).dropDuplicates(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def daily_counts(rows: DataFrame) -> DataFrame:
    """Tumbling days: day, kind, n."""
    base = rows.withWatermark("ts", LATE) if rows.isStreaming else rows
    return base.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "kind", "n")


def settled(rows: DataFrame, gap: str) -> DataFrame:
    """Debounce: of a user's events less than gap apart, the last value, once the user has been still for gap."""
    base = rows.withWatermark("ts", LATE) if rows.isStreaming else rows
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    out = base.groupBy(F.session_window("ts", gap).alias("w"), "usr").agg(last.alias("event_id"), F.count("*").alias("n"))
    return out.select("usr", F.col("w.start").alias("start"), "event_id", "n")


def throttled(rows: DataFrame, seconds: int) -> DataFrame:
    """At most one write of a user in so many seconds: a write passes if the last that passed is long enough ago.

    The state is one time stamp a user. Rows of a micro-batch are taken in the order of their times.
    """
    schema = "usr long, ts timestamp, event_id long"
    gap = pd.Timedelta(seconds=seconds)

    def passing(times: pd.DataFrame, last: pd.Timestamp | None) -> tuple[pd.DataFrame, pd.Timestamp | None]:
        kept = []
        for row in times.sort_values(["ts", "event_id"]).itertuples(index=False):
            if last is None or row.ts - last >= gap:
                kept.append(row)
                last = row.ts
        return pd.DataFrame(kept, columns=["usr", "ts", "event_id"]), last

    own = rows.select("usr", "ts", "event_id")
    if not rows.isStreaming:
        return own.groupBy("usr").applyInPandas(lambda g: passing(g, None)[0], schema)

    def step(key: tuple, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, last = passing(pd.concat(list(groups)), pd.Timestamp(state.get[0], unit="us") if state.exists else None)
        if last is not None:
            state.update((int(last.value // 1000),))
        if len(out):
            yield out

    return own.groupBy("usr").applyInPandasWithState(step, schema, "last long", "append", "NoTimeout")


def handed_in(exams: DataFrame) -> DataFrame:
    """exam, handed, auto: an exam is handed in by the user or at its end, whichever comes first."""
    return exams.select("exam", F.least(F.coalesce("hand_in", "end"), F.col("end")).alias("handed"), (F.col("hand_in").isNull() | (F.col("hand_in") > F.col("end"))).alias("auto"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives on what is there now, from a table in the shared folder.

    In append mode each micro-batch adds files; in complete mode it writes the whole result anew, and the last one counts.
    """
    spark = stream.sparkSession
    place = scratch_path(spark, name)
    out = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{place}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/rows")
    numbers = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/{number}")
        numbers.append(number)

    out.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/{numbers[-1]}") if numbers else spark.createDataFrame([], stream.schema)


def upserting(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table under path: version n + 1 is merge(version n, batch), written whole.

    A batch that is repeated after a failure writes its own version again, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/{number - 1}") if number else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/{number}")

    return write
