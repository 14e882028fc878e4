"""Centroid clustering by delta Lloyd: exact integer k-means whose rounds touch only what changed.

1. Vectors become integers, floor(SCALE * x), and are written once as a table in buckets of a row number.
2. Assignments (row, owner, squared distance) are a table in the same buckets, one a round; joining the two moves no rows.
   A vector whose owner's centroid stood still keeps its distance and is compared with the changed centroids only; a vector
   whose owner's centroid moved is compared with all.
3. A round's table holds the components of the vectors that changed owner. They are summed as signed transfers (minus at the
   old owner, plus at the new one) and added to the global sums, from which the changed centroids follow by exact floors.
   When no centroid changes, the rounds left would change nothing and are not run.

The driver holds k centroids and k sums of DIMENSIONS integers, whatever the input's size. All tables are in the shared
folder; a round reads the one before, which is then deleted, so a lost executor costs the tasks it ran.

Contract of the cases: vectors that are null, have another number of components, or hold null or non-finite ones are left
out. Components beyond +-LARGEST are cut to it, which keeps squared distances within a long. A null vec_id is drawn as an
empty text and stays null in the result; repeated rows are vectors of their own. Ties go to the smaller centroid; rows with
equal hashes are drawn in the order of their components. Fewer than k vectors make fewer centroids; none make an empty
result. A sum of distances beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.session import delete_path, own_path, scoped

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components are cut to this; 64 squared differences then stay below 2 ** 63.
LARGEST = 1 << 27
#: Rows of a bucket, where that makes more buckets than the session has shuffle partitions.
BUCKET_ROWS = 1_000_000


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v of the rows whose embedding has DIMENSIONS finite components."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") == DIMENSIONS) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c * SCALE))))).cast("int"))
    return embeddings.where(F.coalesce(sound, F.lit(False))).select("vec_id", v.alias("v"))


class Buckets:
    """Tables in the shared folder, all in the same number of buckets of row_id."""

    def __init__(self, spark, n_buckets: int):
        self.spark, self.n, self.paths = spark, n_buckets, {}

    def write(self, df: DataFrame) -> str:
        name = f"quizloom_{uuid.uuid4().hex}"
        self.paths[name] = own_path(self.spark, "buckets")
        df.write.bucketBy(self.n, "row_id").sortBy("row_id").option("path", self.paths[name]).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        for name in list(self.paths):
            self.drop(name)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to rows of centroids."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= 1 << 22:  # every sum is an integer below 2 ** 53, so doubles are exact and use the fast product
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return (v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)


def reassign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids marked in changed took new places."""
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | changed[owner]
    if moved.any():
        d = distances(v[moved], centroids)
        owner[moved] = d.argmin(1)
        distance[moved] = d.min(1)
    still, new = np.flatnonzero(~moved), np.flatnonzero(changed)
    if len(still) and len(new):
        d = distances(v[still], centroids[new])
        best, to = d.min(1), new[d.argmin(1)]
        nearer = (best < distance[still]) | ((best == distance[still]) & (to < owner[still]))
        owner[still[nearer]], distance[still[nearer]] = to[nearer], best[nearer]
    return owner, distance


def assign(rows: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """row_id, vec_id, owner, distance, was, moved of rows with row_id, vec_id, v, owner, distance; moved is v where owner is not was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column("v").flatten()
            v = flat.to_numpy().astype(np.int64).reshape(n, -1)
            was, before = (batch.column(c).to_numpy() for c in ("owner", "distance"))
            owner, distance = reassign(v, was.astype(np.int64), before, centroids, changed)
            differs = owner != was
            ends = np.concatenate([[0], np.cumsum(np.where(differs, v.shape[1], 0))]).astype(np.int32)
            parts = pa.array(v[differs].astype(np.int32).ravel(), pa.int32())
            moved = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~differs, False)), parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("vec_id"), pa.array(owner.astype(np.int32)), pa.array(distance), batch.column("owner"), moved],
                ["row_id", "vec_id", "owner", "distance", "was", "moved"],
            )

    return rows.select("row_id", "vec_id", "v", "owner", "distance").mapInArrow(run, "row_id long, vec_id long, owner int, distance long, was int, moved array<int>")


def transfers(assigned: DataFrame, k: int) -> tuple[list[list[int]], list[int]]:
    """What each cluster's sum and count gained by the vectors that changed owner."""
    ends = F.explode(F.array(F.struct(F.col("owner").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign"))))
    signed = assigned.where("moved IS NOT NULL").select("moved", ends.alias("_e")).where("_e.cluster >= 0").select("moved", "_e.cluster", "_e.sign")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's sums: below 2 ** 63 for 2 ** 36 rows
        sums = np.zeros((k, DIMENSIONS + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                v = batch.column("moved").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
                cluster, sign = batch.column("cluster").to_numpy(), batch.column("sign").to_numpy().astype(np.int64)
                for c in np.unique(cluster):
                    own = sign[cluster == c]
                    sums[c, :-1] += own @ v[cluster == c]
                    sums[c, -1] += own.sum()
        at = np.flatnonzero(sums.any(axis=1))
        place = np.tile(np.arange(DIMENSIONS + 1), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, DIMENSIONS + 1).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[at].ravel())], ["cluster", "place", "part"])

    parts = signed.mapInArrow(partial, "cluster int, place int, part long")
    total = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    gains, counts = [[0] * DIMENSIONS for _ in range(k)], [0] * k
    for c, p, x in total.collect():  # k * (DIMENSIONS + 1) rows at most
        if p < DIMENSIONS:
            gains[c][p] = int(x)
        else:
            counts[c] = int(x)
    return gains, counts


@scoped
def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every sound vector."""
    spark = embeddings.sparkSession
    numbered = embeddings.transform(integer_vectors).withColumn("row_id", F.monotonically_increasing_id())
    plain = own_path(spark, "vectors")
    numbered.write.parquet(plain)  # row numbers are fixed here
    numbered = spark.read.parquet(plain)
    buckets = Buckets(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // BUCKET_ROWS)))
    try:
        vectors = buckets.write(numbered.repartition(buckets.n, "row_id"))
        drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = [r.v for r in numbered.orderBy(drawn, "v").limit(k).select("v").collect()]
        k = len(first)
        centroids = np.array(first, dtype=np.int64).reshape(k, DIMENSIONS)
        sums, counts, changed = [[0] * DIMENSIONS for _ in range(k)], [0] * k, np.ones(k, dtype=bool)
        known = None
        for round_ in range(rounds + 1):
            held = spark.table(vectors)
            if known is None:
                rows = held.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")})
            else:
                rows = held.drop("vec_id").join(spark.table(known).select("row_id", "vec_id", "owner", "distance").hint("merge"), "row_id")
            new = buckets.write(assign(rows, centroids, changed))
            if known is not None:
                buckets.drop(known)
            known = new
            if round_ == rounds or not k:
                break
            gains, more = transfers(spark.table(known), k)
            sums = [[a + b for a, b in zip(s, g, strict=True)] for s, g in zip(sums, gains, strict=True)]
            counts = [a + b for a, b in zip(counts, more, strict=True)]
            after = np.array([[x // n for x in s] if n else list(c) for s, n, c in zip(sums, counts, centroids, strict=True)], dtype=np.int64)
            changed = (after != centroids).any(axis=1)
            centroids = after
            if not changed.any():
                break
        result = spark.table(known).select("vec_id", F.col("owner").alias("cluster"), "distance")
        digests = [(c, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in range(k)]
        names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
        each = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_each"))
        total = each.agg(F.sum("_each").alias("_all"))
        as_long = lambda c: F.expr(f"try_cast({c} AS bigint)")
        told = names.join(each, "cluster").crossJoin(total).select("cluster", as_long("_each").alias("cluster_inertia"), as_long("_all").alias("inertia"), "centroid_sha256")
        out = own_path(spark, "clusters")
        result.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").write.parquet(out)
        return spark.read.parquet(out)
    finally:
        buckets.close()


def cluster_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by plain Lloyd rounds, each a step of CTEs."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (
  SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept, c{i}),
a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT cluster, p, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMENSIONS})) AS p FROM a{i}) GROUP BY cluster, p),
n{i} AS (SELECT cluster, list(x ORDER BY p) AS c FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (cluster))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
