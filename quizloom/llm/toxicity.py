"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, searched in a block-max inverted index.

Terms are lower-case words; every word that stands in two examples or more is in the vocabulary, and every example is in the
index. A term weighs (1 + ln tf) * idf * gain, where gain is the information that the term's presence gives about the label
among the examples, classes taken as equally large: with idf alone the many words of a text's subject hide the few that
matter (plain weights find 0.40 of the held-out toxic labels of sf0.1, these find about 0.9). Vectors have length 1.

The index holds, for each term, its postings in blocks of BLOCK examples and each block's largest weight. A query sums the
largest weights to bound every block, visits blocks from the highest bound down, GROUP at a time, and stops when no bound
reaches the K-th best score, so its K nearest examples are exact. They vote with the POWER-th power of their similarity; the
votes pass through a logistic calibration fitted on leave-one-out votes. A text that shares no term with any example gets
the rate among all examples.

Bounds: examples are a bounded sample (EXAMPLES of each class), CALIBRATION of them are voted on for the calibration. What is
broadcast is the index: these examples' postings, a table of terms and blocks, and the vocabulary.

Contract of the cases: null and empty texts have no terms; texts of any length are read whole; repeated rows give repeated
rows; an empty table gives an empty one; rows with a null label teach nothing, and of labels that disagree about one id the
larger holds; with labels of one class every score is that class's smoothed rate, and without usable labels 0.5; of equally
near examples those first in the index's order are taken; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.batches import slices
from quizloom.llm.text_stats import labelled_sample
from quizloom.session import cut

MODULUS, HELD_OUT = 5, 0
EXAMPLES, CALIBRATION = 2048, 2048
BLOCK, GROUP, K, POWER = 64, 8, 15, 4
#: The weight of the prior among the votes: as much as neighbours at this similarity.
DOUBT = 0.35
#: Terms of a text that are told as evidence.
EVIDENCE = 8

words = re.compile(r"\w+").findall


def counts(text: str | None) -> Counter[str]:
    return Counter(words((text or "").lower()))


def vector(found: Counter[str], number: dict[str, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in order and their weights, of length 1; empty if no term has a weight."""
    known = [t for t in found if t in number]
    return unit(np.array([number[t] for t in known], dtype=np.int64), np.array([found[t] for t in known], dtype=np.int64), weight)


def unit(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """vector for term numbers that stand n times each."""
    order = np.argsort(at)
    at, n = at[order], n[order]
    w = (1 + np.log(n)) * weight[at]
    has = w > 0
    at, w = at[has], w[has]
    return at, w / np.sqrt((w * w).sum()) if len(w) else w


class BlockMaxIndex:
    """Exact nearest examples by cosine over sparse unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.size = len(vectors)
        # like stands by like, so that blocks' bounds differ
        heaviest = [(int(at[w.argmax()]), -float(w.max())) if len(at) else (terms, 0.0) for at, w in vectors]
        self.order = np.array(sorted(range(self.size), key=lambda i: (heaviest[i], i)), dtype=np.int64)
        blocks = max(1, -(-self.size // BLOCK))
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, dtype=np.int64)])
        place = np.repeat(np.arange(self.size), [len(vectors[i][0]) for i in self.order])
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        by_term = np.lexsort((place, term))
        self.terms, self.blocks = terms, blocks
        self.term, self.places, self.weights = term[by_term].astype(np.int32), place[by_term].astype(np.int32), weight[by_term]
        self._table()

    def __getstate__(self) -> dict:
        """Postings only: who receives the index makes its tables anew."""
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "highest")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._table()

    def _table(self) -> None:
        terms, blocks = self.terms, self.blocks
        #: Where the postings of each term begin in each block; the row after a term's last block is the next term's first.
        cells = self.term.astype(np.int64) * blocks + self.places // BLOCK
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(cells, minlength=terms * blocks))]).astype(np.int32)
        self.highest = np.zeros(terms * blocks, dtype=np.float32)
        np.maximum.at(self.highest, cells, np.nextafter(self.weights.astype(np.float32), np.float32(2)))
        self.highest = self.highest.reshape(terms, blocks)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and similarities of the k nearest examples that share a term with the query, nearest first."""
        bound = w @ self.highest[at]
        queue = np.argsort(-bound, kind="stable")
        score, best = np.zeros(self.blocks * BLOCK), np.zeros(0, dtype=np.int64)
        for first in range(0, self.blocks, GROUP):
            some = queue[first : first + GROUP]
            if bound[some[0]] <= 0 or (len(best) == k and bound[some[0]] < score[best[-1]] - 1e-9):
                break
            cells = (at[:, None] * self.blocks + some).ravel()
            begin = self.starts[cells]
            n = self.starts[cells + 1] - begin
            used = np.flatnonzero(n)
            begin, n, ends = begin[used], n[used], np.cumsum(n[used])
            postings = np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            score += np.bincount(self.places[postings], self.weights[postings] * np.repeat(w[used // len(some)], n), minlength=len(score))
            if skip >= 0:
                score[np.flatnonzero(self.order == skip)] = 0
            found = np.flatnonzero(score > 0)
            if len(found) > k:
                least = np.partition(score[found], len(found) - k)[len(found) - k]
                found = found[score[found] >= least]
            best = found[np.lexsort((found, -score[found]))][:k]
        return self.order[best], score[best]


class Model:
    def __init__(self, vocabulary: list[str], weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, shares: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """weight: of each term; vectors: of the examples; shares: how many labelled rows an example stands for."""
        self.vocabulary, self.number, self.weight = vocabulary, {t: i for i, t in enumerate(vocabulary)}, weight
        self.ids, self.labels, self.shares = ids, labels.astype(float), shares.astype(float)
        self.index = BlockMaxIndex(vectors, len(vocabulary))
        self.prior = float(((self.labels * self.shares).sum() + 0.5) / (self.shares.sum() + 1.0))
        self.slope, self.shift = 1.0, 0.0
        some = [i for i in range(0, len(vectors), max(1, -(-len(vectors) // CALIBRATION))) if len(vectors[i][0])]
        if len(some) > 20 and 0 < self.labels.sum() < len(self.labels):
            raw = np.array([self.vote(*self.index.nearest(*vectors[i], skip=i)) for i in some])
            self._calibrate(np.log(raw / (1 - raw)), self.labels[some], self.shares[some] / self.shares[some].mean())

    def vote(self, who: np.ndarray, near: np.ndarray) -> float:
        """The neighbours' share of label 1 by similarity, drawn towards the prior when little is near."""
        w = near**POWER * self.shares[who]
        doubt = DOUBT**POWER * (self.shares.mean() if len(self.shares) else 1.0)
        return float((w @ self.labels[who] + self.prior * doubt) / (w.sum() + doubt))

    def _calibrate(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
        """Weighted logistic regression of labels on the votes' log odds, drawn towards leaving them as they are."""
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(share * (p - y) * x).sum() + 4 * (a - 1), (share * (p - y)).sum() + 4 * b])
            h = share * p * (1 - p)
            hess = np.array([[(h * x * x).sum() + 4, (h * x).sum()], [(h * x).sum(), h.sum() + 4]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
        if np.isfinite([a, b]).all() and a > 0:
            self.slope, self.shift = float(a), float(b)

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        """The score, the ids of the nearest examples and the heaviest terms of the text."""
        at, w = vector(counts(text), self.number, self.weight)
        who, near = self.index.nearest(at, w) if len(at) else (at, w)
        if not len(who):
            return self.prior, [], []
        raw = self.vote(who, near)
        score = 1 / (1 + math.exp(-(self.slope * math.log(raw / (1 - raw)) + self.shift)))
        return score, self.ids[who].tolist(), [self.vocabulary[i] for i in at[np.lexsort((at, -w))[:EVIDENCE]].tolist()]


def entropy(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -p * np.log(p) - (1 - p) * np.log(1 - p)


def term_weights(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, rate: float) -> np.ndarray:
    """idf * gain of terms that c1 of n1 toxic and c0 of n0 other examples hold; rate: the toxic share of labelled rows."""
    p1, p0 = c1 / n1, c0 / n0
    n = n1 + n0
    idf = np.log((1 + n) / (1 + n * (rate * p1 + (1 - rate) * p0))) + 1
    return idf * np.maximum(0, entropy((p1 + p0) / 2) - (entropy(p1) + entropy(p0)) / 2)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = cut(labelled_sample(labels, "toxic", MODULUS, HELD_OUT, EXAMPLES))
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * EXAMPLES ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [counts(text.as_py()) for text in batch.column("text")]
            columns = [batch.column(c) for c in ("doc_id", "label", "weight")]
            columns += [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "weight", "terms", "counts"])

    examples = cut(picked.mapInArrow(count, "doc_id long, label int, weight double, terms array<string>, counts array<int>"))
    size = {r["label"]: (r["n"], r["w"]) for r in examples.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    n1, n0 = size.get(1, (0, 0))[0], size.get(0, (0, 0))[0]
    vocabulary: list[str] = []
    weight = np.zeros(0)
    if n1 and n0:
        terms = examples.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("c1"), F.count("*").alias("n"))
        seen = terms.where("n > 1").toPandas().sort_values("term")
        vocabulary = seen["term"].tolist()
        c1, n = seen["c1"].to_numpy(float), seen["n"].to_numpy(float)
        weight = term_weights(c1, n - c1, n1, n0, size[1][1] / (size[1][1] + size[0][1]))
    # as columns: the driver makes no object of a term in an example
    rows = examples.orderBy("doc_id", "terms").toArrow().combine_chunks()
    held = rows.column("terms").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
    codes = pc.fill_null(pc.index_in(held.flatten(), value_set=pa.array(vocabulary, pa.string())), -1).to_numpy()
    n = rows.column("counts").combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(pc.list_value_length(held).to_numpy()) if rows.num_rows else []
    vectors = []
    for begin, end in zip([0, *ends[:-1]], ends):
        known = codes[begin:end] >= 0
        vectors.append(unit(codes[begin:end][known].astype(np.int64), n[begin:end][known], weight))
    return Model(vocabulary, weight, *[rows.column(c).to_numpy() for c in ("doc_id", "label", "weight")], vectors)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours (ids of the nearest examples) and evidence (terms) in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [shared.value.score(text.as_py()) for text in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "neighbours", "evidence"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, neighbours array<long>, evidence array<string>")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(MODULUS)) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "evidence")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))
