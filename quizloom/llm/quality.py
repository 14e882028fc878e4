"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver over a bounded sample of labelled rows (text_stats.SAMPLE_PER_CLASS of each class): every
statistic is cut into BINS quantile bins once, and a split is sought in the histograms of gradients and hessians. The
forest is flattened into arrays (feature, threshold, left, right, value), which workers walk for a whole batch at once.

Contract of the cases: null and empty texts have statistics of zero and get that leaf's score; texts of any length are
measured whole; repeated rows give repeated rows; an empty table gives an empty one; without usable labels every score
is 0.5, and with labels of one class it is that class's smoothed rate; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.batches import slices
from quizloom.llm.text_stats import STATS, doc_stats, labelled_sample

BINS, TREES, DEPTH, RATE, LEAF_HESSIAN, L2 = 64, 80, 4, 0.12, 1.0, 1.0
#: Documents with at least this score are of good quality.
GOOD = 0.7
MODULUS, HELD_OUT = 4, 2


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf's children are itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Logistic loss, second-order leaves, deterministic for rows in one order."""
    n, width = x.shape if len(x) else (0, len(STATS))
    rate = ((y * weight).sum() + 0.5) / (weight.sum() + 1.0)
    base = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * p * (1 - p)
            roots.append(_grow(nodes, binned, edges, grad, hess, np.arange(n), DEPTH, score))
    table = np.array(nodes or [[0, 0, 0, 0, 0.0]], dtype=np.float64)
    roots = roots or [0]
    return Forest(base, np.array(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])


def _grow(nodes: list, binned: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, score: np.ndarray) -> int:
    """Appends the subtree over rows, adds its leaves to score and returns its node."""
    me = len(nodes)
    nodes.append([0, 0.0, me, me, 0.0])
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0)
    if depth and h >= 2 * LEAF_HESSIAN:
        for j in range(binned.shape[1]):
            if len(edges[j]) == 0:
                continue
            b = binned[rows, j]
            gl = np.bincount(b, grad[rows], BINS)[:-1].cumsum()
            hl = np.bincount(b, hess[rows], BINS)[:-1].cumsum()
            gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
            gain[(hl < LEAF_HESSIAN) | (h - hl < LEAF_HESSIAN)] = 0
            k = int(gain[: len(edges[j])].argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] < 0:
        nodes[me][4] = float(-RATE * g / (h + L2))
        score[rows] += nodes[me][4]
        return me
    _, j, k = best
    goes = binned[rows, j] <= k
    nodes[me][0], nodes[me][1] = j, float(edges[j][k])
    nodes[me][2] = _grow(nodes, binned, edges, grad, hess, rows[goes], depth - 1, score)
    nodes[me][3] = _grow(nodes, binned, edges, grad, hess, rows[~goes], depth - 1, score)
    return me


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest from the bounded labelled sample; only the sampled rows' statistics come to the driver."""
    sample = labelled_sample(labels, "quality", MODULUS, HELD_OUT)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * SAMPLE_PER_CLASS ids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = doc_stats(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("label"), batch.column("weight")]
            columns.append(pa.array(stats.tolist(), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "weight", "stats"])

    got = picked.mapInArrow(measure, "doc_id long, label int, weight double, stats array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(STATS))), np.zeros(0), np.zeros(0))
    x = np.array(got["stats"].tolist())
    order = np.lexsort([*x.T, got["doc_id"].to_numpy()])
    return fit(x[order], got["label"].to_numpy(float)[order], got["weight"].to_numpy(float)[order])


def score_documents(docs: DataFrame, forest: Forest, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and, with keep, these columns of docs; one pass, no exchange."""
    keep = [c for c in keep or [] if c != "doc_id"]
    fields = {f.name: f.dataType for f in docs.schema}
    schema = "doc_id long, score double" + "".join(f", `{c}` {fields[c].simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = forest.scores(doc_stats(batch.column("text").to_pylist()))
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), *[batch.column(c) for c in keep]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", *keep])

    return docs.select("doc_id", "text", *[c for c in keep if c != "text"]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_documents(docs, train(docs, labels))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(MODULUS)) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
