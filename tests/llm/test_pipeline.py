"""The pipeline's stages against plain versions of what they decide."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from quizloom.llm import curriculum, quality
from test_ops import brute_near


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before, docs))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == pipeline.COLUMNS
    good, unique, apart, mixed, tokens = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for _, d in kept]
    assert sum(labels.get(i) == 1 for i in good) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(labels.get(i) == 0 for i in good) <= 0.4 * sum(q == 0 for q in labels.values())
    texts = {r["doc_id"]: r["text"] for r in kept[0][1].collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert unique == sorted(first.values())
    assert apart == sorted(i for i, _, c in brute_near([(i, texts[i]) for i in unique]) if i == c)
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in curriculum.mix(kept[3][0]).collect()}
    assert Counter(mixed) == Counter({i: n for i, (t, s) in plan.items() if s and (n := int(t / s + 0.5))})
    assert Counter(tokens) == Counter(mixed)


def test_threshold_is_the_contracts():
    assert quality.GOOD == 0.7 and [n for n, _ in pipeline.STAGES][0] == "quality classifier" and len(pipeline.STAGES) == 5


def test_stages_on_awkward_rows(spark, sf):
    """Repeated and null ids, null columns, empty texts, clashing columns and an empty table, stage by stage."""
    rows = [(1, "A b", "en", "s", 1), (5, "A b", "en", None, None), (5, "B c", None, "s", 1), (5, "B c", None, "s", 1), (None, "A b", "en", "s", 1), (None, None, None, None, None), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, taken string")
    stage = dict(pipeline.STAGES)
    ids = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    unique = stage["exact dedup"](spark, docs, sf)
    assert unique.columns == pipeline.COLUMNS and ids(unique) == [("1", "A b"), ("5", "B c"), ("6", "")]
    apart = stage["MinHash near-dedup"](spark, docs, sf)
    assert apart.columns == pipeline.COLUMNS and ids(apart) == [("1", "A b"), ("5", "B c"), ("6", ""), ("None", "")]
    mixed = stage["mixing sources"](spark, docs, sf)
    assert mixed.columns == pipeline.COLUMNS and all(t for _, t in ids(mixed))
    assert stage["BPE encoding"](spark, docs, sf).count() == len(rows)
    assert stage["quality classifier"](spark, docs, sf).columns == pipeline.COLUMNS
    for name, f in pipeline.STAGES:
        assert f(spark, docs.limit(0), sf).count() == 0, name
