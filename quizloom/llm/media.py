"""Media columns: content-defined chunking of payloads into a deduplicated store, and verified reconstruction.

A text's payload (its UTF-8 bytes and spaces up to a multiple of UNIT) becomes a WAV file of 8-bit samples. A rolling gear
hash over the last 32 bytes cuts the file where its high bits are zero, so equal stretches are cut alike wherever they stand.
Chunk digests are counted and given one owner each by joins of narrow tables. The store then holds every distinct chunk once:

  media/   one row for each distinct file: its digest, the ordered list of chunk digests, and the bytes of the chunks that stand
           nowhere else (most of them), so that most files are read back without any exchange;
  chunks/  digest and bytes of each chunk that stands in several places, written by its owner.

Reading back joins the shared chunks to the lists that name them, puts chunks in order, and checks every chunk's and
every file's digest. Contents cross the network only for files that share chunks.

Contract of the cases: null counts as empty, and an empty text's payload is one unit of spaces; files of any length are
stored whole; equal texts share all their chunks and have equal values; repeated rows give repeated rows; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.batches import slices
from quizloom.session import cut, delete_path, look_up, scratch_path, with_ids, without_ids

UNIT, RATE, HEADER = 192, 8000, 44
LEAST, MOST, BITS = 512, 8192, 11
_GEAR = np.random.RandomState(7).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def wav(data: bytes) -> bytes:
    """data, padded, as the samples of an 8-bit mono WAV file."""
    payload = data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def payload_of(file: bytes) -> bytes:
    return file[HEADER : HEADER + struct.unpack_from("<I", file, HEADER - 4)[0]]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + table[byte], which 32 bits keep of the last 32 bytes."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def cuts(file: bytes) -> list[int]:
    """The ends of a file's chunks."""
    n = len(file)
    ends, start = [], 0
    if n > LEAST:
        for c in (np.flatnonzero(gear(np.frombuffer(file, dtype=np.uint8)) >> np.uint32(32 - BITS) == 0) + 1).tolist():
            while c - start > MOST:
                start += MOST
                ends.append(start)
            if c - start >= LEAST and c < n:
                ends.append(c)
                start = c
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n]


def chunks(file: bytes) -> list[bytes]:
    ends = cuts(file)
    return [file[a:b] for a, b in zip([0, *ends], ends)]


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the file's digest), parts (its chunks' digests in order) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, files, parts = [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                file = wav(data)
                sizes.append(len(data))
                files.append(_digest(file))
                parts.append([_digest(c) for c in chunks(file)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(parts, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "parts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, parts array<binary>")


def _write_media(rows: DataFrame, path: str, mode: str) -> None:
    rows.write.mode(mode).option("compression", "zstd").parquet(path)


def store(docs: DataFrame, path: str) -> DataFrame:
    """Writes the store under path and returns doc_id, n_bytes, media, parts for every row of docs (cut)."""
    named = cut(lists(docs))
    files = cut(named.groupBy("media").agg(F.min("doc_id").alias("owner"), F.first("parts").alias("parts")))
    places = files.select("media", "owner", F.posexplode("parts").alias("at", "part"))
    n_places = files.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0))).first()[0]
    known = cut(places.groupBy("part").agg(F.count("*").alias("uses"), F.min(F.struct("media", "at")).alias("holder")).where("uses > 1"))
    shared = look_up(places, known, "part", "uses", ["holder"], n_places).where("holder IS NOT NULL")
    # 1: shared and written by this file; 2: shared and written by another, or at another place of this one
    role = F.when((F.col("holder.media") == F.col("media")) & (F.col("holder.at") == F.col("at")), 1).otherwise(2)
    roles = cut(shared.groupBy("media").agg(F.first("owner").alias("owner"), F.map_from_entries(F.collect_list(F.struct("at", role.alias("role")))).alias("roles")))
    # files that share nothing are written where they are read; one row of docs writes each file
    writers = files.select(F.col("owner").alias("doc_id"), "media")
    sharing = cut(roles.select(F.col("owner").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    twins = named.join(writers.withColumnRenamed("doc_id", "_writer"), "media").where(~F.col("doc_id").eqNullSafe(F.col("_writer")))
    again = named.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 OR doc_id IS NULL")
    special = cut(sharing.unionByName(twins.select("doc_id")).unionByName(again.select("doc_id")).distinct())

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text"):
                file = wav((text.as_py() or "").encode())
                parts = chunks(file)
                out.append((_digest(file), [_digest(c) for c in parts], parts))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate([pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())])], ["media", "parts", "own"])

    text = docs.select("doc_id", "text")
    _write_media(without_ids(text.where("doc_id IS NOT NULL"), special.where("doc_id IS NOT NULL"), "doc_id").mapInArrow(plain, "media binary, parts array<binary>, own array<binary>"), f"{path}/media", "overwrite")
    # the rest: every file once, with the roles of its chunks
    rest = writers.join(roles.select("media", "roles"), "media", "left").withColumnRenamed("media", "_media")
    rest = with_ids(rest.where("doc_id IS NOT NULL"), special.where("doc_id IS NOT NULL"), "doc_id").unionByName(rest.where("doc_id IS NULL"))
    texts = with_ids(text.where("doc_id IS NOT NULL"), special.where("doc_id IS NOT NULL"), "doc_id").unionByName(text.where("doc_id IS NULL"))
    rest = rest.withColumnRenamed("doc_id", "_owner")
    met = texts.join(rest, texts["doc_id"].eqNullSafe(rest["_owner"])).select("text", "_media", "roles")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, media, roles in zip(batch.column("text"), batch.column("_media"), batch.column("roles")):
                file = wav((text.as_py() or "").encode())
                if _digest(file) != media.as_py():  # another text under the same doc_id
                    continue
                parts, role = chunks(file), dict(roles.as_py() or [])
                out.append((media.as_py(), [_digest(c) for c in parts], [None if i in role else c for i, c in enumerate(parts)], [c for i, c in enumerate(parts) if role.get(i) == 1]))
            kinds = [pa.binary(), *[pa.list_(pa.binary())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["media", "parts", "own", "lent"])

    # rows that repeat a text under one doc_id would write the file twice; they are equal
    rows = met.mapInArrow(parted, "media binary, parts array<binary>, own array<binary>, lent array<binary>")
    if not again.isEmpty():
        rows = rows.dropDuplicates(["media"])
    _write_media(rows.select("media", "parts", "own"), f"{path}/media", "append")
    lent = rows.select(F.explode("lent").alias("data"))
    lent.select(F.unhex(F.sha2("data", 256)).alias("part"), "data").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    return named


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored file, from the stored bytes: media, payload and file digests and sizes, feature, verified."""
    media = spark.read.schema("media binary, parts array<binary>, own array<binary>").parquet(f"{path}/media")
    kept = spark.read.schema("part binary, data binary").parquet(f"{path}/chunks")
    whole = media.where(~F.exists("own", lambda c: c.isNull())).withColumn("lent", F.lit(None).cast("array<struct<at:int,data:binary>>"))
    partial = media.where(F.exists("own", lambda c: c.isNull()))
    wanted = partial.select("media", F.posexplode(F.arrays_zip("parts", "own")).alias("at", "x")).where("x.own IS NULL").select("media", "at", F.col("x.parts").alias("part"))
    uses = cut(wanted.groupBy("part").agg(F.count("*").alias("uses")))
    total = uses.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    lent = look_up(wanted, kept.join(uses, "part"), "part", "uses", ["data"], total)
    lent = lent.groupBy("media").agg(F.collect_list(F.struct("at", "data")).alias("lent"))  # no more than the file itself
    files = whole.unionByName(partial.join(lent, "media", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media, parts, own, lent in zip(*[batch.column(c) for c in ("media", "parts", "own", "lent")]):
                got = own.as_py()
                for x in lent.as_py() or []:
                    got[x["at"]] = x["data"]
                file = b"".join(c or b"" for c in got)
                ok = [_digest(c or b"") for c in got] == parts.as_py() and _digest(file) == media.as_py()
                out.append((media.as_py(), *features(file, len(got)), ok))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], [c.split(" ")[0] for c in READ.split(", ")])

    return files.select("media", "parts", "own", "lent").mapInArrow(run, READ)


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, verified boolean"


def features(file: bytes, n_chunks: int) -> tuple[int, str, int, int, str, str]:
    payload = payload_of(file)
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    centred = x - 128
    crossings = int(np.count_nonzero(np.diff(x > x.mean())))
    text = f"chunks={n_chunks};sum={int(x.sum())};energy={int((centred * centred).sum())};low={int(x.min())};high={int(x.max())};crossings={crossings}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), text


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and what was read back, for every row of docs. Without a path, the store is dropped when it has been read."""
    spark = docs.sparkSession
    place = path or scratch_path(spark, "media")
    named = store(docs, place)
    back = cut(read_back(spark, place))
    if path is None:
        delete_path(spark, place)
    counts = named.groupBy("media").agg(F.count("*").alias("copies"))
    values = [c.split(" ")[0] for c in READ.split(", ")[1:]]
    out = look_up(named.select("doc_id", "n_bytes", "media"), back.join(counts, "media"), "media", "copies", values, named.count())
    return out.select("doc_id", "n_bytes", *values)
