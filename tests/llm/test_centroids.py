"""op12: delta rounds against plain Lloyd, and the cases of the contract."""

import hashlib
import math

import numpy as np
import pytest

from quizloom.llm import centroids
from quizloom.session import read_table

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, k=8, rounds=10, seed=3):
    kept = []
    for vec_id, x, *_ in rows:
        if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [max(-(1 << 27), min(1 << 27, math.floor(1024 * float(np.float32(c))))) for c in x]))
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    places = [list(v) for _, v in drawn[:k]]
    for left in range(rounds, -1, -1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in places] for _, v in kept]
        own = [min(range(len(places)), key=lambda j: (d[j], j)) for d in far]
        if left:
            for j in range(len(places)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
                if mine:
                    places[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    inertia = [sum(d[o] for d, o in zip(far, own, strict=True) if o == j) for j in range(len(places))]
    return sorted(((r[0], o, d[o], inertia[o], sum(inertia), text[o]) for r, o, d in zip(kept, own, far, strict=True)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_rows():
    r = np.random.RandomState(7)
    rows = [(i, (r.randn(64) + 3 * (i % 5)).tolist(), 0, "x") for i in range(120)]
    rows += [rows[3], rows[3], (None, rows[4][1], 1, None), (None, [0.5] * 64, 1, None), (200, [1e30] * 64, 0, ""), (201, [-1e30] + [0.0] * 63, 0, "")]
    rows += [(300, None, 0, ""), (301, [], 0, ""), (302, [1.0] * 63, 0, ""), (303, [float("nan")] * 64, 0, ""), (304, [float("inf")] * 64, 0, ""), (305, [None] + [1.0] * 63, 0, "")]
    return rows


def test_brute_force(spark, odd_rows):
    got = centroids.cluster(spark.createDataFrame(odd_rows, SCHEMA))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = brute(odd_rows)
    assert len(want) == 126 and rows_of(got) == want


def test_few_and_none(spark, odd_rows):
    few = [r for r in odd_rows[:3]] + [odd_rows[0]]
    assert rows_of(centroids.cluster(spark.createDataFrame(few, SCHEMA))) == brute(few)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame(odd_rows[-6:], SCHEMA)).count() == 0


def test_delta_equals_full():
    r = np.random.RandomState(1)
    v, c = r.randint(-9, 9, (400, 64)), r.randint(-9, 9, (6, 64))
    v[:40] = v[0]
    every = np.ones(6, dtype=bool)
    owner, d = centroids.reassign(v, np.full(400, -1), np.zeros(400, dtype=np.int64), c, every)
    for changed in ([0], [3, 5], [], [1, 2, 4]):
        c = c.copy()
        for j in changed:
            c[j] = r.randint(-9, 9, 64)
        c[5] = c[2]  # a tie
        marks = np.isin(np.arange(6), [*changed, 5])
        owner, d = centroids.reassign(v, owner, d, c, marks)
        full = centroids.reassign(v, np.full(400, -1), np.zeros(400, dtype=np.int64), c, every)
        assert (owner == full[0]).all() and (d == full[1]).all()
    big = np.array([[1 << 27] * 64, [-(1 << 27)] * 64])
    assert centroids.distances(big, big)[0, 1] == 1 << 62


def test_extra_columns_and_sf(spark, sf):
    got = centroids.cluster(read_table(spark, sf, "embeddings").selectExpr("*", "1 AS row_id", "2 AS owner", "3 AS v"))
    assert got.count() == 500 and got.select("inertia").distinct().count() == 1
