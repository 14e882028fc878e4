"""Labels and document statistics that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a model may learn from.
SAMPLE_PER_CLASS = 8192


def labelled_sample(labels: DataFrame, target: str, modulus: int, held_out: int, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, label, weight: at most per_class rows of each class with crc32(doc_id as text) mod modulus <> held_out.

    Rows with a null id or label teach nothing; of labels that disagree about one id the larger holds. The rows with the
    smallest hash of the id are taken (an order that has nothing to do with the input's), and weight restores the
    classes' true proportions.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    one = one.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held_out)
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for label, n in sorted(counts.items()):
        some = one.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        parts.append(some.withColumn("weight", F.lit(n / min(n, per_class))))
    if not parts:
        return one.select("doc_id", "label", F.lit(1.0).alias("weight"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Names of what doc_stats measures, in its order.
STATS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "space", "high",
    "stop", "comma", "bang", "pipe", "symbol", "angle", "bracket", "other_mark", "distinct_words",
    "top_word", "lines", "line_words", "distinct_lines", "top_line", "marked_words", "upper_words", "entropy",
]

_KIND = np.zeros((256, 12), dtype=np.float64)
for _k, _set in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\v\f", None, ".", ",;:", "!?", "|", "*$%&#@^~+=", "<>/\\", "()[]{}", "\"'`_-"]):
    if _set is None:
        _KIND[128:, _k] = 1
    else:
        _KIND[list(_set.encode()), _k] = 1


def doc_stats(texts: list[str | None]) -> np.ndarray:
    """One row of STATS for each whole text; a null text counts as empty, and an empty text gives zeros."""
    out = np.zeros((len(texts), len(STATS)))
    for row, text in zip(out, texts):
        data = (text or "").encode()
        if not data:
            continue
        n = len(data)
        counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        kinds = counts @ _KIND / n
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        n_words, n_lines = max(1, len(words)), max(1, len(lines))
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        line_tally: dict[bytes, int] = {}
        for x in lines:
            line_tally[x] = line_tally.get(x, 0) + 1
        p = counts[counts > 0] / n
        marked = sum(c for w, c in tally.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,"))
        upper = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
        row[:] = [
            np.log1p(n), np.log1p(len(words)), n / n_words, np.log1p(max(map(len, tally), default=0)), *kinds,
            len(tally) / n_words, max(tally.values(), default=0) / n_words,
            n_lines / n_words, np.log1p(n_words / n_lines), len(line_tally) / n_lines, max(line_tally.values(), default=0) / n_lines,
            marked / n_words, upper / n_words, -(p * np.log2(p)).sum(),
        ]
    return out
