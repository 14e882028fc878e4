"""The ten operators against brute force and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from conftest import SF
from tokenizers import Tokenizer

from quizloom.llm import bpe, chat, curriculum, exact, media, near, quality, queries, shards, text_stats, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n ", "en", "a", 3), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (6, "One  two\nthree four five six", "en", "a", 1), (7, "one two three four five six", "de", "c", 1), (8, "é ß İ 😀 <|endoftext|> x" * 3, "fr", None, 1),
    (9, "w " * 40_000, "en", "a", 80_000), (10, "x" * 70_000, "en", "a", 70_000), (4, "one", "en", "b", 3), (None, "null id", "en", "a", 7), (11, "idiot scum trash", "en", "a", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names operators might use themselves."""
    extra = [(*r, "s", 1, 2, True) for r in ODD]
    return spark.createDataFrame(extra, DOCS + ", score string, size int, name int, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def brute_near(rows):
    """Components by comparing all shingle sets; rows: (id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted((r[0] if r[0] is not None else -1, len(s), smallest[find(i)] if smallest[find(i)] is not None else -1) for i, (r, s) in enumerate(zip(rows, sets)))


def near_rows(df):
    fix = lambda x: -1 if x is None else x
    return sorted((fix(r["doc_id"]), r["n_shingles"], fix(r["component_id"])) for r in df.collect())


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(11)
    base = [[r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 50)) for _ in range(n)] for n in (146, 60, 9, 5)]
    rows, k = [], 0
    for words in base:
        for edits in [0, 0, 1, 1, 2, 3, 4, 5, 6, 8] * 3:
            own = list(words)
            for _ in range(edits):
                own[r.randrange(len(own))] = f"edit{r.randint(0, 10**6)}"
            rows.append((k := k + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(near.components(df)) == brute_near(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    assert near_rows(near.components(odd)) == brute_near([r[:2] for r in ODD])
    assert near.components(none).count() == 0


def near_group(size, seed=5):
    """(cls, bands, shingles) of a text of 120 words and size - 1 copies with one to eleven words replaced."""
    r, words, out = random.Random(seed), [f"w{i}" for i in range(120)], []
    for k in range(size):
        own = list(words)
        for _ in range(0 if k == size // 2 else 1 + r.randrange(11)):
            own[r.randrange(120)] = f"e{k}x{r.randint(0, 10**6)}"
        hashes = near.shingles(" ".join(own))
        out.append((k, near.band_keys(hashes).tolist(), hashes.view(np.int64).tolist()))
    return out


@pytest.mark.parametrize("size", [500, 2000, 4500])
def test_pairs_grow_in_proportion_to_a_group(spark, size):
    """Of a group with many members under the threshold, neither stars nor the prefix join name all pairs."""
    rows = near_group(size)
    members = spark.createDataFrame([(k, i) for i, bands, _ in rows for k in bands], "key long, cls long")
    shared = members.join(members.groupBy("key").count().withColumnRenamed("count", "m").where("m > 1"), "key").select("key", "m", "cls").cache()
    assert near.star_pairs(shared).count() <= 12 * size
    full = spark.createDataFrame([(i, x) for i, _, x in rows], "cls long, hashes array<long>")
    apart = full.select("cls", F.col("cls").alias("label"))
    linked = {i for i, _, x in rows if 100 * len(set(x) & set(rows[size // 2][2])) >= 75 * len(set(x) | set(rows[size // 2][2]))}
    labelled = apart.withColumn("label", F.when(F.col("cls").isin(sorted(linked)), 0).otherwise(F.col("label") + 1))
    assert size / 4 < len(linked) < size and near.prefix_pairs(labelled, full).count() <= size


def test_prefix_join_finds_every_link(spark):
    """Without stars, the join alone finds all pairs at the threshold, whatever the sizes."""
    r = random.Random(3)
    rows = [(k, sorted(x)) for k in range(400) for x in [{r.randrange(60 * (k % 7), 60 * (k % 7) + 40 + k % 30) for _ in range(r.randint(1, 60))}]]
    full = spark.createDataFrame(rows, "cls long, hashes array<long>")
    got = {(x["centre"], x["cls"]) for x in near.prefix_pairs(full.select("cls", F.col("cls").alias("label")), full).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))}
    assert want and want <= got


def test_keepers_know_rows_by_id_and_text(spark, none):
    rows = [(1, "A"), (5, "A"), (5, "B"), (9, "C"), (None, "C"), (None, "C"), (None, "D"), (None, "D"), (7, "E"), (7, "E"), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DOCS + ", row_key string")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = lambda f: sorted((str(r["doc_id"]), str(r["text"])) for r in f(docs, columns).collect())
    same = [("1", "A"), ("5", "B"), ("7", "E"), ("9", "C"), ("None", "D")]
    assert kept(near.keepers) == sorted([*same, ("8", ""), ("8", ""), ("None", "None")])
    assert kept(exact.keepers) == sorted([*same, ("8", "")])
    assert near.keepers(none, columns).count() == 0 and exact.keepers(none, columns).count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(2)
    data = b"".join(bytes(r.choices(b"abcXYZ\xc3\xa9", k=r.randint(1, 12))) + r.choice([b" ", b"\n\t", b"\x0b"]) for _ in range(400))
    whole = near.word_hashes(data)
    monkeypatch.setattr(near, "PIECE", 64)
    assert (near.word_hashes(data) == whole).all() and len(whole) == len(data.split())
    one = near.word_hashes(b"x" * 63 + b" " + b"Y" * 300 + b" yy")
    monkeypatch.undo()
    assert (one == near.word_hashes(b"x" * 63 + b" " + b"y" * 300 + b" YY")).all()


def test_odd_sketch_estimates_similarity():
    r = np.random.RandomState(3)
    for j in (0.6, 0.75, 0.9):
        n = 2000
        both = round(2 * n * j / (1 + j))
        pool = r.randint(0, 1 << 62, 2 * n, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - both : 2 * n - both])
        x, y = (np.unpackbits(np.frombuffer(near.odd_sketch(s), dtype=np.uint8)) for s in (a, b))
        share = 2 * (x != y).sum() / near.SKETCH_BITS
        estimate = 1 + near.SKETCH_BITS / (4 * near.SAMPLES) * math.log(1 - share)
        assert abs(estimate - j) < 0.08


def check_shards(rows, texts, n_shards, tolerance=None):
    by = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    if tolerance:
        sums = [sum(r["size"] for r in by[k]) for k in range(n_shards)]
        assert max(sums) - min(sums) <= tolerance, sums


def test_shards(docs, texts):
    rows = shards.shard(docs).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 8, 2 * max(r["size"] for r in rows))


def test_shards_of_one_text_and_of_odd_rows(spark, odd, none):
    copies = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string")
    rows = shards.shard(copies).collect()
    check_shards(rows, {i: "same text" for i in range(3000)}, 8, 100)
    nameless = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    check_shards(shards.shard(nameless).collect(), {None: "same text"}, 8, 100)
    rows = shards.shard(odd).collect()
    assert len(rows) == len(ODD)
    check_shards(rows, {r[0]: r[1] for r in ODD}, 8)
    assert shards.shard(none).count() == 0


def test_shards_equal_brute_force(docs, texts):
    """Shards are runs of the documents in the order of their keys, with edges at the document nearest to each target."""
    key = {r["doc_id"]: r["key"] for r in shards.keyed(docs).collect()}
    rows = {r["doc_id"]: r for r in shards.shard(docs).collect()}
    order = sorted(texts, key=lambda i: key[i][:24])
    assert [(rows[i]["shard"], rows[i]["slot"]) for i in order] == sorted((r["shard"], r["slot"]) for r in rows.values())
    size = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    total, below = sum(size.values()), 0
    for k, (a, b) in enumerate(zip(order, order[1:])):
        below += size[a]
        if rows[a]["shard"] != rows[b]["shard"]:
            target = total * rows[b]["shard"] / 8
            assert abs(below - target) <= max(size[a], size[b], shards.TOLERANCE * total / 8), (k, below, target)


def test_mix_meets_targets(spark, docs, odd, none):
    for df in (docs, odd, none):
        rows = curriculum.mix(df).collect()
        taken, target, size = defaultdict(int), {}, {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
            assert r["position"] is None or 0 <= r["position"] <= 1
            taken[r["source"]] += r["taken"]
            target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 3 * size[s] for s in target)
        assert abs(sum(target.values()) - sum(size.values())) < 1e-6
        assert sorted(map(str, rows)) == sorted(map(str, curriculum.mix(df.repartition(5)).collect()))


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 50), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in curriculum.targets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == 300 and got["d"] == 0
    assert got[None] == 150 and got["a"] == pytest.approx(1160 - 30 - 300 - 150)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3], "x") for i in range(300)]
    got = curriculum.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    early = {s: sum(1 for r in got if r["source"] == s and r["taken"] and r["position"] < 0.5) / sum(1 for r in got if r["source"] == s and r["taken"]) for s in "abc"}
    # demand met by half time: 0.625, 0.5 and 0.375 of the targets, which are 0.5, 1 and 1.5 passes; these are first takes
    assert abs(early["a"] - 0.625) < 0.03 and abs(early["b"] - 0.5) < 0.03 and abs(early["c"] - 0.375 * 1.5) < 0.03


def labelled(spark, n=400):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [word() for _ in range(60)]
        if toxic:
            words[r.randrange(60)] = r.choice(["stupid", "moron", "idiot"]) + r.choice(["", ",", "!"])
        good = i % 5 > 0
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels, truth = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert sum(got[i]["predicted"] == truth[i][2] for i in held) >= 0.97 * len(held)
    scored = toxicity.classify(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.classify(none, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


def brute_toxicity(docs, labels):
    """Scores by dense loops over all labelled rows that are not held out; docs and labels: {id: text}, {id: 0 or 1}."""
    import re

    bag = lambda t: {w: re.findall(r"\w+", (t or "").lower()).count(w) for w in set(re.findall(r"\w+", (t or "").lower()))}
    known = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 5]
    bags, n = {i: bag(t) for i, t in docs.items()}, len(known)
    n1 = sum(labels[i] for i in known)
    h = lambda p: sum(-x * math.log(x) for x in (p, 1 - p) if x > 0)
    weight = {}
    for t in {t for i in known for t in bags[i]}:
        c1, c0 = (sum(t in bags[i] for i in known if labels[i] == y) for y in (1, 0))
        if c1 + c0 > 1:
            p1, p0 = c1 / n1, c0 / (n - n1)
            weight[t] = (math.log((1 + n) / (1 + c1 + c0)) + 1) * max(0.0, h((p1 + p0) / 2) - (h(p1) + h(p0)) / 2)

    def vector(i):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in bags[i].items() if weight.get(t, 0) > 1e-12}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(i) for i in docs}
    prior, doubt = (n1 + 0.5) / (n + 1), toxicity.DOUBT**toxicity.POWER

    def vote(i, others):
        near = sorted(((sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), labels[j]) for j in others), reverse=True)[: toxicity.K]
        w = [s**toxicity.POWER for s, _ in near]
        p = (sum(x * y for x, (_, y) in zip(w, near)) + prior * doubt) / (sum(w) + doubt)
        return math.log(p / (1 - p))

    x, y = np.array([vote(i, [j for j in known if j != i]) for i in known]), np.array([labels[i] for i in known])
    a, b = 1.0, 0.0
    for _ in range(20_000):  # plain descent to the same optimum
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - 2e-3 * (((p - y) * x).sum() + 4 * (a - 1)), b - 2e-3 * ((p - y).sum() + 4 * b)
    return {i: 1 / (1 + math.exp(-(a * vote(i, known) + b))) if vectors[i] else prior for i in docs}


def test_toxicity_equals_brute_force(spark):
    r = random.Random(4)
    texts = {i: " ".join(f"w{int(r.expovariate(0.03))}" for _ in range(40)) + (" Moron, idiot" if i % 5 == 0 else " idiot!" if i % 11 == 0 else "") for i in range(160)} | {200: None, 201: "unseen"}
    toxic = {i: int(i % 5 == 0) for i in range(160)}
    docs, labels = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    want = brute_toxicity(texts, toxic)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_toxicity_recall_on_held_out_labels(spark):
    """On sf0.1, a tenth of the toxic labels marks texts without any word of the others' kind."""
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 0.9 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def test_classifiers_on_odd_labels(spark):
    docs, _, truth = labelled(spark, 60)
    twice = spark.createDataFrame([(i, 1, t) for i, _, t in truth] + [(i, 1, 0) for i, _, _ in truth] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame([(i, 1, t) for i, _, t in truth], "doc_id long, quality int, toxic int")
    scores = lambda f, x: sorted((r["doc_id"], round(r["score"], 12)) for r in f.classify(docs, x).collect())
    assert scores(toxicity, twice) == scores(toxicity, once)
    assert len({s for _, s in scores(quality, once)}) == 1 and scores(quality, once)[0][1] > 0.9
    assert len({s for _, s in scores(toxicity, once.withColumn("toxic", F.lit(0)))}) == 1


def test_block_max_search_is_exact():
    r = np.random.RandomState(6)
    vectors = []
    for _ in range(700):
        at = np.sort(r.choice(40, r.randint(1, 7), replace=False))
        w = r.rand(len(at)) + 0.1
        vectors.append((at, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for at, w in vectors[:60]:
        q = np.zeros(40)
        q[at] = w
        want = np.sort(dense @ q)[::-1][: toxicity.K]
        _, got = index.nearest(at, w)
        assert np.allclose(got, want)


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels, truth = labelled(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) and got[i]["predicted"] == int(got[i]["score"] >= 0.7) for i in got)
    assert sum(got[i]["predicted"] == truth[i][1] for i in held) >= 0.97 * len(held)
    assert len(quality.classify(odd, labels).collect()) == len(ODD) and quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_forest_equals_walking_each_tree():
    r = np.random.RandomState(1)
    x = r.rand(300, len(text_stats.STATS))
    y = (x[:, 3] + 0.3 * r.rand(300) > 0.6).astype(float)
    forest = quality.fit(x, y, np.ones(300))

    def walk(node, row):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    want = [1 / (1 + math.exp(-(forest.base + sum(walk(t, row) for t in forest.roots)))) for row in x[:40]]
    assert np.allclose(forest.scores(x[:40]), want)


def brute_exact(rows):
    import re

    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


def test_exact_dedup_equals_brute_force(spark, docs, texts, odd, none, monkeypatch):
    fields = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    run = lambda df: sorted(str(tuple(r)) for r in exact.dedup(df).select(*fields).collect())
    assert run(docs) == brute_exact(texts.items())
    assert run(odd) == brute_exact(ODD)
    assert exact.dedup(none).count() == 0
    # many levels, equal halves, and blocks that cut characters
    monkeypatch.setattr(exact, "BLOCK", 4)
    r = random.Random(8)
    rows = [(i, "".join(r.choice(["ab", "é", "abab", " ", "  "]) for _ in range(r.randint(0, 12)))) for i in range(200)] + [(500, "abcd" * 33), (501, "abcd" * 33), (502, "abcd" * 34)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute_exact(rows)


def check_media(rows, want):
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in want)
    by = defaultdict(list)
    for i, t in want:
        by[i].append(t)
    for r in rows:
        able = []
        for t in by[r["doc_id"]]:
            data = (t or "").encode()
            payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
            file = media.wav(data)
            able.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest()))
        assert r["verified"] and (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) in able


def test_media_round_trip(docs, texts, odd, none):
    check_media(media.round_trip(docs).collect(), list(texts.items()))
    check_media(media.round_trip(odd).collect(), [r[:2] for r in ODD])
    assert media.round_trip(none).count() == 0


def test_chunks_are_stored_once(spark, docs, tmp_path):
    media.store(docs, str(tmp_path))
    stored = [bytes(c) for r in spark.read.parquet(f"{tmp_path}/media").select("own").collect() for c in r["own"] if c is not None]
    stored += [bytes(r["data"]) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()]
    assert len(stored) == len(set(stored))


def test_insertion_moves_few_cuts():
    data = bytes(random.Random(7).choices(range(97, 123), k=200_000))
    before = set(media.chunks(media.wav(data)))
    after = media.chunks(media.wav(data[:100_000] + b"inserted" + data[100_000:]))
    assert sum(c in before for c in after) >= len(after) - 6 and b"".join(after) == media.wav(data[:100_000] + b"inserted" + data[100_000:])


def test_chat_reads_back(spark):
    hard = ["a", "", None, "</turn>", "<turn:user>", "<turn+>", "\\o\\b\\", "\\### Assistant: </turn> ok", "x\ny<turn"]
    rows = [(1, i, ["user", "user", "assistant", "assistant", "sys>tem", None][i % 6], hard[i % 9]) for i in range(54)] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "user", "first"), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv]["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert back[1]["n_blocks"] < 54
    assert chat.digest(chat.read_back(chat.format_conversations(df.limit(0)))).count() == 0


def test_chat_of_many_turns(spark):
    """Work on 10 times the turns takes about 10 times the time; clashing columns are not read; long texts count whole."""
    import time

    def rows(n):
        return spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é text "), "id").alias("text"), F.lit("x").alias("turns"), F.lit(1).alias("starts"), F.lit(2).alias("blocks"))

    took = {}
    for n in (300, 4_000, 40_000):
        began = time.time()
        got = chat.read_back(chat.format_conversations(rows(n))).select(F.size("turns").alias("n"), "loss", "n_blocks").first()
        took[n] = time.time() - began
        assert got["n"] == n and got["loss"] == "".join(f"é text {i}" for i in range(n) if i % 3 == 2)
    assert took[40_000] < 25 * max(took[4_000], 0.5), took
    long = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "</turn>é" * 300_000)], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.read_back(chat.format_conversations(long))).first()
    assert got["loss_sha256"] == hashlib.sha256(("</turn>é" * 300_000).encode()).hexdigest() and got["n_turns"] == 2


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_bpe(rows, want, library):
    assert len(rows) == len(want)
    able = defaultdict(set)
    for i, t in want:
        ids = library.encode(t or "", add_special_tokens=False).ids
        able[i].add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in able[r["doc_id"]] for r in rows)


def test_bpe_equals_the_library(docs, texts, odd, none, library):
    path = queries.word_tokenizer()
    check_bpe(bpe.encode_documents(docs, path).collect(), list(texts.items()), library)
    check_bpe(bpe.encode_documents(odd, path).collect(), [r[:2] for r in ODD], library)
    assert bpe.encode_documents(none, path).count() == 0
    kept = bpe.encode_documents(docs, path, keep=["lang"]).first()
    assert len(kept["ids"]) == kept["n_tokens"] and kept["lang"]


def test_bpe_on_random_texts(library):
    own = bpe.WordBpe(open(queries.word_tokenizer(), encoding="utf-8").read())
    r = random.Random(1)
    bits = ["a", "the", "'s", "'RE", " ", "\n", "é", "é", "Σ", "İ", "12", "²", "<|endoftext|>", "!!", "😀", "ß", "x" * 90, "qu" * 200]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decoded(" ".join(map(str, ids))) == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_every_code_point(library):
    own = bpe.WordBpe(open(queries.word_tokenizer(), encoding="utf-8").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 8192):
        texts = [f"a{c}b 1{c}2 {c}{c}. x{c}" for c in points[i : i + 8192]]
        want = [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert own.encoded(texts) == want


def test_bpe_on_marks_side_by_side(library):
    """Each mark beside marks of other classes, in both orders, and each composition's halves."""
    import unicodedata

    own = bpe.WordBpe(open(queries.word_tokenizer(), encoding="utf-8").read())
    points = [chr(c) for c in range(0x300, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    beside = [chr(c) for c in (0x334, 0x327, 0x323, 0x301, 0x345, 0x94D, 0x5B0, 0x3099, 0x8D1, 0xFE22)]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = [t for m in marks for b in beside for t in (m + b, b + m, f"a{b}{m}{b}e", f"e{m}{b}")]
    for c in map(chr, range(0xC0, 0x110000)):
        halves = unicodedata.decomposition(c)
        if halves and not halves.startswith("<"):
            texts.append("".join(chr(int(x, 16)) for x in halves.split()) + "\u0301")
    r = random.Random(2)
    texts += ["".join(r.choice(marks + list("aeio") * 40) for _ in range(r.randint(2, 12))) for _ in range(20000)]
    for i in range(0, len(texts), 8192):
        some = texts[i : i + 8192]
        assert own.encoded(some) == [" ".join(map(str, e.ids)) for e in library.encode_batch(some, add_special_tokens=False)]


def test_url_rules(spark):
    cases = [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/a?b", "x.com", "/fr/a", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://example.org?x=/es/", "example.org", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://best-casino-slots.win/jackpot", "best-casino-slots.win", "/jackpot", None, "block"), ("https://www.university.edu/research#x", "www.university.edu", "/research", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_url_model_on_held_out_urls():
    """A quarter of the names, with all that was built from them, is kept from the model."""
    table = urls.labelled_urls()
    held = lambda host: zlib.crc32(host.encode()) % 4 == 0
    bias, weights = urls.fit([x for x in table if not held(x[1])])
    blocked = [(label, bias + sum(weights[b] for b in urls.buckets_of(host, path)) > 0) for label, host, path in table if held(host)]
    caught, wrong = [b for label, b in blocked if label], [b for label, b in blocked if not label]
    assert len(caught) > 60 and sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.05 * len(wrong)


def test_url_model_on_pages(spark):
    """Site names of other words, half of them spam's, under ordinary domains; the model saw none of these hosts."""
    bad = ["bestpoker-win", "freeslots", "cheap-viagra-shop", "adultcams", "click-ads", "spamlinks", "crack-download", "fastloan-cash"]
    good = ["ththing", "tionsh", "rivergarden", "old-bridge", "greenhill", "northern-lights", "my-notes", "saint-mary"]
    rows = [(k, f"https://{start}{name}.example.{end}/{lang}/{k}{tail}") for k, (start, name, end, lang, tail) in enumerate((s, n, e, "en", t) for s in ("", "www.", "m.") for n in bad + good for e in ("net",) for t in ("", "/", ".html?page=2"))]
    got = {r["host"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()}
    wrong = [h for h, v in got.items() if v != ("block" if any(b in h for b in bad) else "allow")]
    assert len(got) == 48 and len(wrong) <= 3, wrong


def test_url_filter_on_odd_rows(spark):
    long = "http://a.net/" + "path/" * 30_000
    rows = [(1, long), (1, long), (None, "http://x.example.net"), (2, None), (3, "://"), (4, "ftp://ÉX.com/dé")]
    got = sorted((str(r["page_id"]), r["host"], len(r["path"]), r["verdict"]) for r in urls.judge(spark.createDataFrame([(*r, "h", 5) for r in rows], "page_id long, url string, host string, score int")).collect())
    assert [(i, h, n) for i, h, n, _ in got] == [("1", "a.net", 150_001), ("1", "a.net", 150_001), ("2", "", 0), ("3", "", 0), ("4", "Éx.com", 3), ("None", "x.example.net", 0)]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    text = lambda df: sorted(tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).values.tolist())
    assert text(got) == text(want)
