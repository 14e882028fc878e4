"""MinHash near-dedup with odd sketches.

1. One pass gives each document its set of distinct 5-word shingles (64-bit hashes), the set's digest, and BANDS band keys of
   BAND_ROWS MinHash values each. Documents with equal sets are one class from here on.
2. Classes that share a band key are candidates. Of a class that has any, an odd sketch is made: SAMPLES MinHash values, each
   flipping one bit of SKETCH_BITS, so that the population count of two sketches' XOR estimates their Jaccard similarity to
   about 0.02 near 0.75.
3. Stars: each bucket of m classes names one centre (the class whose band keys are the most shared, so that a group names
   mostly one centre in all of its bands) and m - 1 pairs. Pairs whose estimate reaches LEAST_ESTIMATE are verified on full
   sets; what is linked becomes components.
4. The rest: all classes of buckets that still hold more than one component. A prefix-filter join over their full sets finds
   every pair of different components that can reach the threshold, exactly and without the sketch: shingles are ordered by
   how many of these classes hold them, and a pair that reaches it shares one within both classes' first quarter. The join's
   keys are a shingle and the two classes' size steps, and a shingle's place bounds the sizes it can serve, so classes
   that only share a template (below a similarity of about 0.69) meet in no key at all. Pairs found are verified.
5. Components of all confirmed links, over classes, give each document the smallest doc_id it can reach.

Rows grow in proportion to the classes and their shingles: no step names all pairs of a bucket, and no number of partners or
candidates is capped. Pairs of similarities between 0.69 and 0.75 are compared one by one where a rare shingle is common to
them. Two documents at similarity 0.75 share no band with a probability of 2e-5; that is the method's only loss.

Contract of the cases: null, empty and wordless texts have no shingles and are linked with nothing; with fewer than five words
the whole sequence is one shingle; whole texts and words count however long; repeated rows are copies of one another; a null
doc_id counts as larger than any other; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from quizloom.llm.batches import slices
from quizloom.llm.rows import settle
from quizloom.operators.graph import connected_components
from quizloom.session import cut, look_up, release, spread, with_ids

SHINGLE, LEAST_PERCENT = 5, 75
BANDS, BAND_ROWS = 40, 5
SAMPLES, SKETCH_BITS, LEAST_ESTIMATE = 1024, 2048, 0.68
#: Sizes within this factor of one another are one step of the prefix join.
SIZE_STEP = 1.1
#: Bytes of text that are hashed together.
PIECE = 1 << 18

_random = np.random.RandomState(20240501)
_BYTE = _random.randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_BASE = 0x5851F42D4C957F2D
_UP = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(PIECE, _BASE, dtype=np.uint64)]))
_DOWN = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(PIECE, pow(_BASE, -1, 1 << 64), dtype=np.uint64)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A = (_random.randint(0, 1 << 31, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _random.randint(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data, in order; words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased.

    A word's hash is a polynomial in its bytes, so a word that runs over pieces is the sum of its stretches.
    """
    out, open_sum, open_size = [], np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64)
    for at in range(0, len(data), PIECE):
        raw = np.frombuffer(data[at : at + PIECE], dtype=np.uint8)
        gap = np.concatenate([[True], _SPACE[raw], [True]])
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_LOWER[raw]] * _UP[: len(raw)], dtype=np.uint64)])
        values, sizes = (sums[ends] - sums[starts]) * _DOWN[starts], (ends - starts).astype(np.uint64)
        if open_size[0]:
            if len(starts) and starts[0] == 0:
                values[:1] = values[:1] * np.uint64(pow(_BASE, int(open_size[0]), 1 << 64)) + open_sum
                sizes[:1] += open_size
            else:
                values, sizes = np.concatenate([open_sum, values]), np.concatenate([open_size, sizes])
            open_size = np.zeros(1, dtype=np.uint64)
        if not _SPACE[raw[-1]]:
            open_sum, open_size = values[-1:], sizes[-1:]
            values, sizes = values[:-1], sizes[:-1]
        out.append(_mix(values + sizes * _STEP[0]))
    if open_size[0]:
        out.append(_mix(open_sum + open_size * _STEP[0]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = word_hashes((text or "").encode())
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total += _mix(words[i : i + n] + _STEP[i]) * _STEP[i]
    return np.unique(_mix(total))


def minhash(hashes: np.ndarray, samples: int) -> np.ndarray:
    """The smallest value of each of the first samples hash functions."""
    x = hashes.astype(np.uint32)  # mixed bits
    out = np.full(samples, 0xFFFFFFFF, dtype=np.uint32)
    a, b = _A[:samples, None], _B[:samples, None]
    step = max(64, (1 << 17) // samples)
    for i in range(0, len(x), step):
        np.minimum(out, (a * x[None, i : i + step] + b).min(axis=1), out=out)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = minhash(hashes, BANDS * BAND_ROWS).reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[1]
    for i in range(BAND_ROWS):
        key = _mix(key + rows[:, i] * _STEP[i])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """SKETCH_BITS parities of where the samples fall."""
    at = _mix(minhash(hashes, SAMPLES).astype(np.uint64) + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP[2]) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


#: Sketches that differ in more bits than this are estimated below LEAST_ESTIMATE.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - math.exp(-2 / SKETCH_BITS * 2 * SAMPLES * (1 - LEAST_ESTIMATE))))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, bands for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digests, bands = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                n.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                bands.append(band_keys(own) if len(own) else None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """digest, hashes (the set), sketch for every row of docs that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, sets, sketches = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                if len(own):
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sets.append(own.view(np.int64))
                    sketches.append(odd_sketch(own))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["digest", "hashes", "sketch"])

    return docs.select("text").mapInArrow(run, "digest binary, hashes array<long>, sketch binary")


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (centre, cls; cut) whose sketches differ in MOST_BITS bits at most."""
    met = spread(pairs, sketches.select(F.col("cls").alias("centre"), F.col("sketch").alias("_c")), "centre", pairs.count()).join(sketches.select("cls", "sketch"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("_c", "sketch"))
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= MOST_BITS
            yield batch.select(["centre", "cls"]).filter(pa.array(near))

    return met.select("centre", "cls", "_c", "sketch").mapInArrow(run, "centre long, cls long")


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """a, b of the pairs (centre, cls; cut) whose full sets are similar enough."""
    met = spread(pairs, full.select(F.col("cls").alias("centre"), F.col("hashes").alias("_a")), "centre", pairs.count())
    met = met.join(full.select("cls", F.col("hashes").alias("_b")), "cls")
    both = F.size(F.array_intersect("_a", "_b"))
    met = met.select(F.col("centre").alias("a"), F.col("cls").alias("b"), both.alias("_i"), (F.size("_a") + F.size("_b")).alias("_n"))
    return met.where(100 * F.col("_i") >= LEAST_PERCENT * (F.col("_n") - F.col("_i"))).select("a", "b")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Distinct (centre, cls): every bucket's classes with its centre. shared: key, m, cls."""
    busy = shared.groupBy("cls").agg(F.sum("m").alias("busy"))
    centres = cut(shared.join(busy, "cls").groupBy("key").agg(F.max(F.struct("busy", "cls"))["cls"].alias("centre")))
    return shared.join(centres, "key").where("cls <> centre").select("centre", "cls").distinct()


def prefix_pairs(open_classes: DataFrame, full: DataFrame) -> DataFrame:
    """Distinct (centre, cls) of different labels whose sets can be similar enough. open_classes: cls, label.

    With sizes n and m the sets share at least 3/7 of (n + m). A set's shingle at place p (from 0, rare ones first) can be
    the first that it shares only with sets of (4n - 7p) / 3 shingles at most.
    """
    rows = open_classes.join(full, "cls").select("cls", "label", F.size("hashes").alias("n"), F.explode("hashes").alias("t"))
    often = rows.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(often, "t")  # a class's shingles are distinct, so no class fills a key; adaptive execution splits common shingles
    # places are counted from the end, as what only one class holds stands before everything else
    place = F.col("n") - F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("df"), F.desc("t")))
    rows = rows.withColumn("p", place).where(4 * F.col("p") <= F.col("n"))
    step = lambda size: F.floor(F.log(size.cast("double")) / math.log(SIZE_STEP)).cast("int")
    reach = F.floor((4 * F.col("n") - 7 * F.col("p")) / 3)
    rows = rows.withColumns({"own": step(F.col("n")), "reach": reach, "other": F.explode(F.sequence(step(F.ceil(F.col("n") * 0.75)), step(F.greatest(reach, F.ceil(F.col("n") * 0.75)))))})
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select("t", "low", "high", "cls", "label", "n", "own", "reach")
    rows = cut(rows)
    key = ["t", "low", "high"]
    labels = rows.groupBy(*key, "label").agg(F.count("*").alias("k"))
    # the label that most rows of a key have takes one side only, so a large component is not compared with itself
    major = cut(labels.groupBy(*key).agg(F.max(F.struct("k", "label"))["label"].alias("major"), F.count("*").alias("n_labels")).where("n_labels > 1").drop("n_labels"))
    left = rows.join(major, key).where("label <> major").select(*key, "major", *[F.col(c).alias(f"_{c}") for c in ("cls", "label", "n", "own", "reach")])
    differ = (F.col("label") != F.col("_label")) & ((F.col("label") == F.col("major")) | (F.col("_cls") < F.col("cls")))
    steps = (F.least("own", "_own") == F.col("low")) & (F.greatest("own", "_own") == F.col("high"))
    met = left.join(rows, key).where(differ & steps & (F.col("n") <= F.col("_reach")) & (F.col("_n") <= F.col("reach")))
    return met.select(F.least("_cls", "cls").alias("centre"), F.greatest("_cls", "cls").alias("cls")).distinct()


def linked_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component for the classes that are linked with another. classes: cls, digest, first, bands, some."""
    members = classes.select("cls", F.explode("bands").alias("key"))
    buckets = cut(members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    # buckets' keys join tables that are read from files: adaptive execution splits a large bucket's partition
    shared = cut(members.join(buckets, "key"))
    named = cut(classes.join(shared.select("cls").distinct(), "cls", "left_semi").select("cls", "digest", "some"))
    texts = with_ids(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), named.select(F.col("some").alias("doc_id")).distinct(), "doc_id")
    if not named.where("some IS NULL").isEmpty():
        texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id IS NULL"))
    full = cut(full_sets(texts).dropDuplicates(["digest"]).join(named.select("digest", "cls"), "digest").select("cls", "hashes", "sketch"))
    stars = cut(star_pairs(shared))
    near = cut(near_pairs(stars, full.select("cls", "sketch")))
    links = cut(confirmed(near, full))
    found = connected_components(links)
    labelled = shared.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("label"))
    split = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("key")
    split = cut(split)
    open_classes = cut(labelled.join(split, "key").select("cls", "label").distinct())
    if not open_classes.isEmpty():
        rest = cut(prefix_pairs(open_classes, full))
        more = cut(confirmed(rest, full))
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))
        release(rest, more)
    release(buckets, shared, named, full, stars, near, links, split, open_classes)
    return found


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, smallest and keeper for every row of docs.

    smallest is the least doc_id of the row's group, and keeper the digest that stays with it; both are null for rows that no
    other row resembles.
    """
    signed = cut(sign(docs))
    nulls_last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(nulls_last)["doc_id"].alias("some"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    n_rows, found = signed.count(), linked_classes(classes, docs)
    linked = cut(found.withColumnRenamed("node", "cls").join(classes.select("cls", "digest", "some", "copies"), "cls"))
    least = F.min(F.struct(F.col("some").isNull().alias("none"), F.col("some").alias("smallest"), F.col("digest").alias("keeper")))
    roots = linked.groupBy("component").agg(least.alias("_r"), F.count("*").alias("n")).select("component", "n", "_r.smallest", "_r.keeper")
    linked = look_up(linked, roots, "component", "n", ["smallest", "keeper"], n_rows)
    alone = classes.join(found.select(F.col("node").alias("cls")), "cls", "left_anti").where("copies > 1")
    groups = linked.select("digest", "copies", "smallest", "keeper").unionByName(alone.select("digest", "copies", F.col("some").alias("smallest"), F.col("digest").alias("keeper")))
    groups = cut(groups)
    release(classes)
    return look_up(signed.select("doc_id", "n_shingles", "digest"), groups, "digest", "copies", ["smallest", "keeper"], n_rows)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    component = F.coalesce("smallest", "doc_id")
    return grouped(docs).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keepers(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs: one row of each group, and every row without words.

    A row is known by its doc_id and its set's digest, so a row that shares its id with a dropped one is judged by itself.
    Rows equal in both are one group's copies: the least of them (by the columns) stays.
    """
    decided = cut(grouped(docs).where("keeper IS NOT NULL"))
    stays = F.col("doc_id").eqNullSafe(F.col("smallest")) & (F.col("digest") == F.col("keeper"))
    rows = decided.groupBy("doc_id", "digest").agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
    return settle(docs, cut(rows.select("doc_id", F.hex("digest").alias("row_key"), "stays")), columns, with_digest)


def with_digest(docs: DataFrame) -> DataFrame:
    """docs with row_key, the digest of each row's set in hexadecimal (null without words)."""
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest().upper() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "row_key"])

    return docs.mapInArrow(run, StructType([*kinds.fields, StructField("row_key", StringType())]))


NEAR_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT t.doc_id, count(s) AS n FROM (SELECT DISTINCT doc_id FROM texts) t LEFT JOIN sets USING (doc_id) GROUP BY t.doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN both_ways ON a = other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, n AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN sizes USING (doc_id) JOIN roots USING (doc_id)"""
