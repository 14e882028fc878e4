"""op13: recall against brute force, exact links where all lists are probed, hot crowds, and the cases of the contract."""

import numpy as np
import pytest

from quizloom.llm import vector_near as vn
from quizloom.session import read_table

SCHEMA = "vec_id long, embedding array<double>, label int, key string"


def brute(rows):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    n, sound = len(rows), []
    for i, r in enumerate(rows):
        x = r[1]
        if x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            sound.append(i)
    link = np.zeros((n, n), dtype=bool)
    for d in {len(rows[i][1]) for i in sound}:
        at = [i for i in sound if len(rows[i][1]) == d]
        u = vn.unit(np.array([rows[i][1] for i in at], dtype=float))
        link[np.ix_(at, at)] = u @ u.T >= vn.LEAST_COSINE
    np.fill_diagonal(link, False)
    label = np.arange(n)
    while True:
        low = np.array([min(label[i], label[link[i]].min(initial=n)) for i in range(n)])
        if (low == label).all():
            break
        label = low
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], int(link[i].sum()), least, r[0] == least))
    return sorted(out, key=repr)


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in vn.components(spark.createDataFrame(rows, schema)).collect()), key=repr)


def near(r, x, cosine):
    """Vectors at this cosine to the rows of x."""
    x, z = vn.unit(x), r.randn(*x.shape)
    z = vn.unit(z - (z * x).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * z


def test_cases(spark):
    r = np.random.RandomState(5)
    base = r.randn(60, 64)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(base)]
    rows += [(100 + i, (3 * v).tolist(), 0, "") for i, v in enumerate(near(r, base[:20], 0.95))]
    rows += [(7, base[3].tolist(), 1, ""), (7, base[3].tolist(), 1, ""), (None, base[9].tolist(), 1, None), (None, (-base[10]).tolist(), 1, None), (None, (-base[10]).tolist(), 1, None)]
    rows += [(200, None, 0, ""), (201, [], 0, ""), (202, [0.0] * 64, 0, ""), (203, [0.0] * 64, 0, ""), (204, [float("nan")] * 64, 0, ""), (205, [float("inf")] + [0.0] * 63, 0, "")]
    rows += [(206, [None] + [1.0] * 63, 0, ""), (207, [1.0] * 3, 0, ""), (208, [1.0, 1.0, 0.9], 0, ""), (209, [2.0], 0, ""), (210, [5.0], 0, ""), (211, [-5.0], 0, ""), (212, [1e300] * 64, 0, ""), (213, [1e-300] * 64, 0, "")]
    rows += [(214, [-0.0] * 63 + [1.0], 0, ""), (215, [0.0] * 63 + [1.0], 0, "")]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 0, "")]) == [(1, 0, 1, True)]


def test_crowds(spark, monkeypatch):
    """A third of the rows near one another, in small blocks, with lists that are all probed: equal to brute force."""
    monkeypatch.setattr(vn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vn, "LIST_ROWS", 100)
    r = np.random.RandomState(6)
    base = r.randn(400, 64)
    tight = near(r, np.repeat(base[:1], 150, axis=0), 0.985)
    wide = near(r, np.repeat(base[1:2], 100, axis=0), 0.94)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(np.concatenate([base, tight, wide, tight[:50]]))]
    want = brute(rows)
    assert found(spark, rows) == want and max(x[1] for x in want) >= 199


def test_recall(spark, monkeypatch):
    """Pairs at cosine 0.9 and a little above, more lists than probes: at least 0.98 are found, none else."""
    monkeypatch.setattr(vn, "LIST_ROWS", 40)
    r = np.random.RandomState(8)
    base = r.randn(2000, 64)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(np.concatenate([base, near(r, base[:1000], 0.901)]))]
    want, got = {x[0]: x for x in brute(rows)}, {x[0]: x for x in found(spark, rows)}
    assert sum(x[1] for x in want.values()) == 2000
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(x[1] for x in got.values()) >= 0.98 * 2000


def test_code_bound_loses_nothing():
    r = np.random.RandomState(2)
    u = vn.unit(r.randn(3000, 64))
    u[1500:] = near(r, u[:1500], 0.91)
    model = vn.Model(u[:2000], 30)
    rest = u - model.centres[0]
    codes, miss = model.code(rest)
    far = np.sqrt(np.maximum(model.table_distances(rest[:200], codes), 0))
    linked = u @ u[:200].T >= vn.LEAST_COSINE
    assert (far <= (vn.REACH + miss + vn.TABLE_ROOM)[:, None])[linked].all()


def test_forest():
    a, b = np.array([5, 7, 9, 1]), np.array([6, 6, 9, 3])
    assert sorted(vn.forest(a, b)) == [(3, 1), (6, 5), (7, 5)]


@pytest.mark.parametrize("name", ["embeddings"])
def test_table(spark, sf, name):
    rows = [(r.vec_id, list(r.embedding)) for r in read_table(spark, sf, name).collect()]
    got = sorted((tuple(r) for r in vn.components(read_table(spark, sf, name)).collect()), key=repr)
    assert got == brute(rows)
