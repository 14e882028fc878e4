"""Sharding by histogram sort, in DataFrame expressions only, under the law of near-equal bytes.

Documents are ordered by a key of KEY_DIGITS hexadecimal digits: the crc32 of the text, then a one-to-one scramble of
doc_id, then one of a row's number, so equal texts stand together and yet can be divided, even if their ids are equal too. Candidate boundaries are key prefixes. Each round counts the
exact bytes and rows below the candidates across all partitions, and only the intervals that hold a splitter not yet met
within tolerance, or too many rows for one task, get finer candidates. When all splitters meet the tolerance, documents
are exchanged once, into parts of known sizes, so that slots follow from the counts below each part.

What the driver holds is the counts of the candidates: at most FAN for each interval refined in a round, and at most
shards + PARTS intervals are refined, whatever the input's size.

Contract of the cases: a null text has no bytes (size 1) and the crc32 of the empty text; a null doc_id sorts like any other
key; rows equal in text and doc_id are interchangeable, and any of them may be the ones at a shard's edge; very long texts count whole, and one that is larger
than a shard's share makes its shard larger; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizloom.session import cut

KEY_DIGITS, DIGITS = 40, 2
FAN = 16**DIGITS
#: Parts into which the documents are exchanged, at least (and at least four for each shuffle partition); no part holds
#: more than twice its share unless one key does.
PARTS = 256
#: A splitter is met when the bytes below it are off by no more than this share of a shard.
TOLERANCE = 0.002


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    digits = lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0")
    key = F.concat(F.lpad(F.lower(F.hex(crc)), 8, "0"), digits(F.col("doc_id")), digits(F.monotonically_increasing_id()))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"), key.alias("key"))


def count_below(rows: DataFrame, shards: int, parts: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[str, int, int]], list[int], list[list[str]]]:
    """The intervals (their key prefix, rows, bytes) in key order after all rounds, for each shard the first interval of it, and the prefixes refined in each round."""
    counted = {"": None}
    total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    counted[""] = (total[0], total[1])
    refine, length, refined = [""] if total[0] else [], 0, []
    while refine and length < KEY_DIGITS:
        length += DIGITS
        inside = F.substring("key", 1, length - DIGITS).isin(refine) if length > DIGITS else F.lit(True)
        got = rows.where(inside).groupBy(F.substring("key", 1, length).alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        refined.append(refine)
        for prefix in refine:
            del counted[prefix]
        counted |= {r["p"]: (r["n"], r["b"]) for r in got}
        order = sorted(counted)
        below, ends = 0, []
        for p in order:
            below += counted[p][1]
            ends.append(below)
        wanted = set()
        for k in range(1, shards):
            target = total[1] * k / shards
            i = bisect.bisect_left(ends, target)
            start = ends[i] - counted[order[i]][1]
            if min(ends[i] - target, target - start) > tolerance * total[1] / shards:
                wanted.add(order[i])
        wanted |= {p for p in order if counted[p][0] > max(1, 2 * total[0] // parts)}
        refine = sorted(p for p in wanted if len(p) == length and counted[p][0] > 1)
    order = sorted(counted) if total[0] else []
    starts, below, first = [], 0, [0]
    for p in order:
        starts.append(below)
        below += counted[p][1]
    for k in range(1, shards):
        target = total[1] * k / shards
        at = bisect.bisect_left([*starts, below], target)
        if at and target - [*starts, below][at - 1] < [*starts, below][at] - target:
            at -= 1
        first.append(max(first[-1], at))
    return [(p, *counted[p]) for p in order], first, refined


def shard(docs: DataFrame, shards: int = 8, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(PARTS, 4 * partitions)
    rows = cut(keyed(docs))
    intervals, first, refined = count_below(rows, shards, parts)
    # neighbouring intervals of one shard make up parts; a part knows its shard and the rows of its shard before it
    share = max(1, sum(n for _, n, _ in intervals) // parts)
    table, part, room, current, before, start = [], -1, 0, -1, 0, 0
    for i, (prefix, n, _) in enumerate(intervals):
        own = bisect.bisect_right(first, i) - 1
        if own != current:
            current, before, room = own, 0, 0
        if n > room:
            part, room, start = part + 1, share, before
        table.append({"prefix": prefix, "part": part, "shard": own, "start": start})
        room, before = room - n, before + n
    lookup = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(table)), "array<struct<prefix:string,part:int,shard:int,start:bigint>>")).alias("t")).select("t.*")
    # the shortest beginning of the key that was not refined names its interval
    prefix = F.substring("key", 1, DIGITS * max(1, len(refined)))
    for k in range(len(refined) - 1, 0, -1):
        prefix = F.when(F.substring("key", 1, DIGITS * k).isin(refined[k]), prefix).otherwise(F.substring("key", 1, DIGITS * k))
    placed = rows.withColumn("prefix", prefix).join(F.broadcast(lookup), "prefix", "left")  # the driver's counts: bounded, see above
    dealt = placed.repartition(partitions, "part")
    slot = F.row_number().over(Window.partitionBy("part").orderBy("key", "size")) - 1 + F.col("start")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
