"""Embedding near-dedup by product quantisation: inverted lists, residual codes, asymmetric distances, exact rerank.

1. Equal vectors become one class with a weight, so copies are never compared with one another.
2. A bounded sample (SAMPLE_ROWS classes, fewer where vectors are long) fits coarse centres and, for SUBSPACES stretches of the
   residual, codebooks of CODES words. Centres start at sample vectors farther apart than a link is long, so a crowd of near
   copies does not eat up many lists; a list with a crowd takes the crowd's mean as its centre.
3. Every class is put into the list of its nearest centre with its residual's code and the length of what the code misses,
   and as a query it probes the PROBES nearest lists. A pair is found if either side probes the other's list.
4. In a list, a query's distances to coded entries are sums of table entries. An entry is compared exactly where that distance
   is within a link's length plus what the entry's code misses, so the codes lose no pair that the probes reach. The cosine of
   full vectors in double precision decides.
5. Entries nearer to the centre than half a link's length (the list's core) are all linked with one another: their links are
   counted by weight and joined by a star, without comparing them. Other queries meet a core only if they are near enough.
6. Lists and their queries are dealt into blocks of about BLOCK_ROWS, so no list fills a task. A block returns sums of weights
   and the edges of a forest, never its pairs; components join them.

With 12 probes, pairs at cosine 0.9 are found with a probability of 0.98 or more (measured in tests/llm); where there are no
more lists than probes, all are. A query crosses the network once a probed list, in the precision of the table's vectors. What is broadcast is two rows a list (MAX_LISTS of them) and the model.

Contract of the cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Vectors
link only with vectors of the same length; each length has its own lists. Repeated vec_ids are rows of their own, and a null
vec_id may be linked but is no component's id: a component of null ids only has a null id and keeps its rows. An empty table
gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quizloom.operators.graph import connected_components
from quizloom.session import cut, look_up, scoped

LEAST_COSINE = 0.9
#: The distance of unit vectors at that cosine.
REACH = float(np.sqrt(2 - 2 * LEAST_COSINE))
SAMPLE_ROWS, SAMPLE_VALUES = 16384, 1 << 21
LIST_ROWS, MAX_LISTS, PROBES = 256, 4096, 12
SUBSPACES, CODES = 8, 256
BLOCK_ROWS = 1024
#: Room for rounding: of double distances, and of the single-precision tables.
ROOM, TABLE_ROOM = 1e-9, 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to the rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def means(points: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        own = np.concatenate([squares(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=points[:, j], minlength=len(centres)) for j in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Model:
    """Coarse centres and the codebooks of their residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = self._centres(sample, lists)
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        rest = sample - self.centres[squares(sample, self.centres).argmin(1)]
        n = max(1, min(CODES, len(sample) // 4))
        self.books = [means(rest[:, a:b], rest[:n, a:b], 6) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    @staticmethod
    def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
        chosen, far = [0], squares(sample, sample[:1])[:, 0]
        while len(chosen) < lists and (open_ := np.flatnonzero(far > REACH**2)).size:
            chosen.append(int(open_[0]))
            far = np.minimum(far, squares(sample, sample[chosen[-1:]])[:, 0])
        centres = means(sample, sample[chosen], 8)
        own, kept = squares(sample, centres).argmin(1), []
        for j in range(len(centres)):
            mine = sample[own == j]
            if len(mine) >= 4:
                close = squares(mine, mine[:1024]) <= (REACH / 2) ** 2
                crowd = close.sum(0)
                if crowd.max() >= max(4, len(mine) // 10):
                    centres[j] = mine[close[:, crowd.argmax()]].mean(0)
            if not kept or squares(centres[j : j + 1], centres[kept]).min() > (REACH / 2) ** 2:
                kept.append(j)
        return centres[kept]

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The residuals' codes and the lengths that they miss."""
        codes, miss = [], np.zeros(len(rest))
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False):
            d = squares(rest[:, a:b], book)
            codes.append(d.argmin(1).astype(np.uint8))
            miss += d.min(1)
        return np.stack(codes, axis=1), np.sqrt(miss)

    def table_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances (entries by queries) of coded entries to queries' exact residuals."""
        out = np.zeros((len(codes), len(rest)), dtype=np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out += squares(book, rest[:, a:b]).astype(np.float32)[codes[:, m]]
        return out


def sign(embeddings: DataFrame) -> DataFrame:
    """vec_id, key, dims, x for every row; key (a digest of the components) is null where nothing may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, kept = [], [], []
            for value in batch.column("x"):
                x = value.as_py()
                a = np.array([np.nan if c is None else c for c in x or ()], dtype=np.float64) + 0.0  # no negative zeros
                sound = len(a) > 0 and bool(np.isfinite(a).all()) and bool(a.any())
                keys.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest() if sound else None)
                dims.append(len(a))
                kept.append(a if sound else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(kept, pa.list_(pa.float64()))], ["vec_id", "key", "dims", "x"]
            )

    return embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, key binary, dims int, x array<double>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def encode(classes: DataFrame, model: Model, dims: int, kind: str) -> DataFrame:
    """cls, w, x (of this kind), list, core, code, miss, probes, away for every class: its place, its code and the lists it probes."""
    held = {"float": pa.float32(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n, u = batch.num_rows, unit(matrix(batch.column("x"), dims))
                d = np.sqrt(squares(u, model.centres))
                p = min(PROBES, d.shape[1])
                near = np.argsort(d, axis=1, kind="stable")[:, :p]
                away = np.take_along_axis(d, near, axis=1)
                codes, miss = model.code(u - model.centres[near[:, 0]])
                lists = lambda a, kind, m: pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(a.ravel(), kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls"), batch.column("w"), batch.column("x").cast(pa.list_(held)), pa.array(near[:, 0].astype(np.int32)), pa.array(away[:, 0] <= REACH / 2 - ROOM),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss), lists(near.astype(np.int32), pa.int32(), p), lists(away, pa.float64(), p)],
                    ["cls", "w", "x", "list", "core", "code", "miss", "probes", "away"],
                )

    kinds = f"cls long, w long, x array<{kind}>, list int, core boolean, code binary, miss double, probes array<int>, away array<double>"
    return classes.select("cls", "w", "x").mapInArrow(run, kinds)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node of its component) with the connections of the edges a[i], b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return [(int(n), int(nodes[r])) for n, r in zip(nodes, label, strict=True) if n != nodes[r]]


def block_links(model: Model, dims: int):
    """A block's function: (node, links) by weight for its queries and for entries that do not probe back, and a forest (node, other)."""

    def run(table: pa.Table) -> pa.Table:
        query = np.array(table.column("query"))
        cls, w, home = (np.array(table.column(c)) for c in ("cls", "w", "list"))
        place, u = int(table.column("place")[0].as_py()), unit(matrix(table.column("x"), dims).astype(np.float64))
        q, e = np.flatnonzero(query), np.flatnonzero(~query)
        node, links, other = [], [], []
        if len(q) and len(e):
            code = np.frombuffer(b"".join(table.column("code").take(pa.array(e)).to_pylist()), dtype=np.uint8).reshape(len(e), -1)
            miss = np.array(table.column("miss").take(pa.array(e)), dtype=np.float64)
            near = model.table_distances(u[q] - model.centres[place], code) <= ((REACH + miss + TABLE_ROOM) ** 2)[:, None]
            x, y = np.nonzero(near)
            x, y = e[x], q[y]
            sure = np.concatenate([np.einsum("ij,ij->i", u[x[i : i + 65536]], u[y[i : i + 65536]]) >= LEAST_COSINE for i in range(0, len(x), 65536)] or [np.zeros(0, bool)])
            sure &= cls[x] != cls[y]
            x, y = x[sure], y[sure]
            seen = np.bincount(y, weights=w[x], minlength=len(cls)).astype(np.int64)
            probes = matrix(table.column("probes").take(pa.array(e)), len(table.column("probes")[int(e[0])]))
            blind = ~(probes[np.searchsorted(e, x)] == home[y][:, None]).any(axis=1)
            seen += np.bincount(x[blind], weights=w[y[blind]], minlength=len(cls)).astype(np.int64)
            at = np.flatnonzero(seen)
            tree = forest(cls[x], cls[y]) if len(x) else []
            node = [*cls[at].tolist(), *[a for a, _ in tree]]
            links = [*seen[at].tolist(), *[None] * len(tree)]
            other = [*[None] * len(at), *[b for _, b in tree]]
        return pa.table([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["node", "links", "other"])

    return run


def found_links(classes: DataFrame, dims: int, kind: str) -> DataFrame:
    """node, links, other: parts of the classes' sums of linked weights, and edges of the components. classes: cls, key, w, x."""
    spark, n = classes.sparkSession, classes.count()
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dims))
    sample = np.array([r.x for r in classes.orderBy(F.xxhash64("key"), "key").limit(bound).select("x").collect()], dtype=np.float64).reshape(-1, dims)
    model = Model(unit(sample), max(1, min(MAX_LISTS, n // LIST_ROWS, len(sample) // 8)))
    encoded = cut(encode(classes, model, dims, kind))
    held = encoded.groupBy("list", "core").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.min("cls").alias("lead"))
    held = spark.createDataFrame(held.collect(), held.schema)  # two rows a list at most
    core = held.where("core").select("list", "weight", "lead")
    sure = encoded.where("core").select("cls", "w", "list").join(F.broadcast(core), "list")
    sure = sure.select(F.col("cls").alias("node"), (F.col("weight") - F.col("w")).alias("links"), F.when(F.col("cls") != F.col("lead"), F.col("lead")).alias("other"))

    parts = held.select(F.col("list").alias("place"), F.col("core").alias("part"), "n")
    probing = F.explode(F.arrays_zip(F.col("probes").alias("place"), F.col("away").alias("d"))).alias("_p")
    wanted = F.when(F.col("part"), (F.col("d") <= 1.5 * REACH + ROOM) & ~(F.col("core") & (F.col("list") == F.col("place")))).otherwise(True)
    meets = lambda rows, known: rows.select("*", probing).select("*", "_p.place", "_p.d").drop("_p").join(F.broadcast(known), "place").where(wanted)
    asking = meets(encoded.select("cls", "list", "core", "probes", "away"), parts).groupBy("place", "part").agg(F.count("*").alias("m"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    dealt = parts.join(asking, ["place", "part"]).select("place", "part", blocks("n").alias("n_e"), blocks("m").alias("n_q"))
    dealt = spark.createDataFrame(dealt.collect(), dealt.schema)
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    own = encoded.join(F.broadcast(dealt), (F.col("list") == F.col("place")) & (F.col("core") == F.col("part")))
    columns = ["place", "part", "e", "q", "query", "cls", "w", "list", "x", "code", "miss", "probes"]
    entries = own.withColumns({"query": F.lit(False), "e": one_of("n_e")}).withColumn("q", all_of("n_q")).select(*columns)
    queries = meets(encoded, dealt).withColumns({"query": F.lit(True), "q": one_of("n_q")}).withColumn("e", all_of("n_e"))
    idle = {"code": F.lit(None).cast("binary"), "miss": F.lit(None).cast("double"), "probes": F.lit(None).cast("array<int>")}
    queries = queries.withColumns(idle).select(*columns)
    met = entries.unionByName(queries).groupBy("place", "part", "e", "q").applyInArrow(block_links(model, dims), "node long, links long, other long")
    return cut(met.unionByName(sure))


@scoped
def components(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    signed = cut(sign(embeddings))
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("w"), F.min("vec_id").alias("some"), F.first("dims").alias("dims"), F.first("x").alias("x"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    lengths = [r.dims for r in classes.groupBy("dims").agg(F.count("*").alias("n")).where("n > 1").orderBy("dims").collect()]
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)
    found = [found_links(classes.where(F.col("dims") == d), d, "float" if single else "double") for d in lengths]
    total = signed.count()
    known = classes.select("cls", "key", "w", "some")
    if found:
        parts = found[0]
        for more in found[1:]:
            parts = parts.unionByName(more)
        counts = parts.groupBy(F.col("node").alias("cls")).agg(F.sum("links").alias("near"))
        labels = connected_components(parts.where("other IS NOT NULL"), "node", "other").withColumnRenamed("node", "cls")
        known = cut(known.join(counts, "cls", "left").join(labels, "cls", "left"))
        groups = known.where("component IS NOT NULL").groupBy("component").agg(F.count("*").alias("size"), F.min("some").alias("least"))
        known = look_up(known, groups, "component", "size", ["least"], total)
    else:
        known = known.withColumns({"near": F.lit(0).cast("long"), "component": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})
    least = F.when(F.col("component").isNull(), F.col("some")).otherwise(F.col("least"))
    known = cut(known.select("key", "w", (F.col("w") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), least.alias("least")))
    out = look_up(signed.select("vec_id", "key"), known, "key", "w", ["n_links", "least"], total)
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


NEAR_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= {LEAST_COSINE}),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, b FROM reached JOIN links ON a = other),
roots AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN roots USING (vec_id)"""
