"""Small cases of the operators outside llm."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.operators import keyed, lines, pairing, ranking, store, segmenter
from quizloom.operators.graph import connected_components
from quizloom.operators.scoring import mark20, points
from quizloom.session import look_up


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


#: Points by right options ticked, for 1 to 5 right ones.
TABLE = {1: [0, 1], 2: [0, 0.5, 1], 3: [0, 0, 0.5, 1], 4: [0, 0, 0.5, 0.5, 1], 5: [0, 0, 0, 0.5, 0.5, 1]}


def test_points_follow_the_table(spark):
    cases = [(list(range(n))[::-1], sorted(random.Random(n * k).sample(range(n), k)), float(TABLE[n][k])) for n in TABLE for k in range(n + 1)]
    cases += [([0, 1], [0, 1, 4], 0.0), ([], [1], 0.0), ([0], [], 0.0)]
    df = spark.createDataFrame(cases, "ans array<int>, sel array<int>, want double").withColumn("got", points(F.col("sel"), F.col("ans")))
    assert df.where("got <> want").count() == 0


def test_mark_rounds_halves_up(spark):
    assert spark.range(1).select(mark20(F.lit(20.0), F.lit(30))).first()[0] == 13.33


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")))
    assert got == sorted((x, root(x)) for x in list(parent))


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_look_up_meets_hot_cold_and_null_keys(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(50)] + [(50, "cold"), (51, None), (52, "unknown")], "id int, k string")
    groups = spark.createDataFrame([("hot", 50, 1), ("cold", 1, 2)], "k string, n int, v int")
    for total in (10, 4096 * 20, 4096 * 100):
        got = dict(look_up(left, groups, "k", "n", ["v"], total).select("id", "v").collect())
        assert got == {**{i: 1 for i in range(50)}, 50: 2, 51: None, 52: None}


def test_dense_position_is_gapless(spark):
    df = spark.createDataFrame([(x * 37 % 101,) for x in range(101)], "x int")
    got = ranking.dense_position(df.repartition(5), [F.col("x")]).collect()
    assert all(r["x"] == r["position"] for r in got) and len(got) == 101


def test_first_by_and_top_k(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), ("a", 1, "y")], "k string, t int, v string")
    assert rows_of(ranking.first_by(df, ["k"], ["t"]).where("k = 'a'")) == [("a", 1, "y")]
    assert ranking.top_k(df, ["k"], ["t"], 2).count() == 3


def test_newest_entry_takes_single_questions(spark):
    in_sets = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q")], "e int, q string")
    singles = spark.createDataFrame([(3, "p"), (1, "q")], "e int, q string")
    assert rows_of(ranking.newest_first_exclusion(in_sets, singles, "e", "q")) == [(1, "q"), (2, "q"), (3, "p")]


def test_guarded_update_folds_in_order(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "q int, v string")
    fixes = spark.createDataFrame([(1, 1, "A", "B"), (1, 2, "B", "C"), (2, 1, "A", "X"), (3, 1, None, "Z")], "q int, ord int, was string, becomes string")
    done, refused = keyed.guarded_update(rows, fixes, "q", "v")
    assert rows_of(done) == [(1, "C"), (2, "B"), (3, "Z")] and rows_of(refused) == [(2, 1)]


def test_permutation_takes_first_equal_option(spark):
    df = spark.createDataFrame([(["a", "b", "a", "z"], ["b", "a"])], "old array<string>, new array<string>")
    assert df.select(keyed.permutation(F.col("old"), F.col("new"))).first()[0] == [1, 0, 1, None]


def test_words_and_keys(spark):
    df = spark.createDataFrame([("<b>BP</b> of 80mmHg (HTA) &amp; Écoles",)], "t string")
    got = df.select(T.words(F.col("t")), T.key(F.col("t")), T.norm(F.col("t"))).first()
    assert got[0] == ["blood", "pressure", "of", "80", "mmhg", "ecole"] and "of" not in got[1] and got[2] == " bp of 80mmhg hta ecoles "


def test_near_words(spark):
    cases = [("haemophilus", "hoemophilus", True), ("psittaci", "psittacci", True), ("hypertension", "hypotension", False), ("left", "lift", False), ("acute", "acuta", False), ("12345", "12346", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.where(T.near(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    assert all(pairing.alike(a, b) == want for a, b, want in cases)


def test_bounded_edits_equal_full_distance():
    r = random.Random(4)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 8))) for _ in range(2))
        for most in (1, 2):
            assert pairing.within(a, b, most) == (full(a, b) <= most)


def test_options_pair_in_any_order():
    option = lambda t: pairing.Text(t.split(), t)
    a = ["fever cough sputum", "chest pain", "weight loss cachexia"]
    for order in itertools.permutations(range(3)):
        assert pairing.pair_options([option(x) for x in a], [option(a[i]) for i in order]) == [order.index(i) for i in range(3)]
    assert pairing.pair_options([option("high fever")], [option("low fever")]) is None


def test_links_survive_broken_codes(spark):
    df = spark.createDataFrame([("WzEsMl0",), ("WzEsMl0=",), ("%%%",), (None,)], "t string")
    assert [r[0] for r in df.select(T.from_base64url(F.col("t"))).collect()] == ["[1,2]", "[1,2]", None, None]


def test_line_kinds_and_segments(spark):
    text = ["Finals 2019", "1. stem", "more", "", "a. x", "b) y", "2) stem", "a. x", "notes: z", "ii. roman"]
    bold = [False, True] + [False] * 4 + [True] + [False] * 3
    df = spark.createDataFrame([(1, i, t, b) for i, (t, b) in enumerate(zip(text, bold))], "d int, i int, t string, b boolean")
    df = df.withColumn("kind", lines.line_kind(F.col("t"), F.col("b")))
    assert "".join(r["kind"] for r in df.orderBy("i").collect()) == "hsteoosonr"
    assert rows_of(lines.segments(df, "d", "i", "kind")) == [(1, 1, 1, 2)]


def test_relabel_compound_cases(spark):
    def kinds(text, paras=None):
        df = spark.createDataFrame([(1, i, p, k) for i, (k, p) in enumerate(zip(text, paras or "a" * len(text)))], "doc int, n int, para string, kind string")
        return "".join(r["kind"] for r in segmenter.relabelled(df).orderBy("n").collect())

    assert kinds("soerr") == "cuerr"
    assert kinds("ssoror") == "ccurur"  # the second sub-stem takes the stem that the first has left
    assert kinds("soror") == "curur"
    assert kinds("stor", "aabb") == "stur"  # another paragraph
    assert kinds("s" + "t" * 10 + "or") == "c" + "t" * 10 + "ur"
    assert kinds("s" + "t" * 11 + "or") == "s" + "t" * 11 + "ur"


def test_parts_follow_the_modes():
    assert segmenter.parts_of("qoo") == "---"  # nothing counts before a topic
    assert segmenter.parts_of("Tqxoox") == "TS+oom"
    assert segmenter.parts_of("TqooNoxk") == "TSooNnnn"
    assert segmenter.parts_of("TqooHN") == "TSooHM"  # notes of a closed question
    assert segmenter.parts_of("TqoHN") == "TSoH-"  # one option is no question
    assert segmenter.parts_of("Tbbqoobq") == "TCcSooCS"
    assert segmenter.parts_of("TqpookN") == "TS+ooK-"[:6] + "M"


def test_questions_of_no_lines_and_nulls(spark):
    schema = "doc int, n int, para int, text string, bold boolean, kind string, case string"
    assert segmenter.questions(segmenter.relabelled(spark.createDataFrame([], schema).drop("case"))).count() == 0
    lines_ = [(1, 0, 0, "Topic", None, "i"), (1, 1, 0, "1. stem", True, "s"), (1, 2, 0, None, None, "o"), (1, 3, 0, "b. y", None, "o"), (1, 4, 0, None, None, "e")]
    got = segmenter.questions(segmenter.relabelled(spark.createDataFrame(lines_, "doc int, n int, para int, text string, bold boolean, kind string")))
    assert rows_of(got.select("topic", "set", "question", "stem", "options", "notes", "case", "chapter")) == [(1, 1, 1, "stem", 2, 0, None, None)]


def test_deletes_win_only_while_newest(spark):
    df = spark.createDataFrame([(1, "a", 1, False), (1, "a", 2, True), (1, "b", 1, True), (1, "b", 2, False)], "u int, k string, t int, deleted boolean")
    assert rows_of(store.latest(df, ["u", "k"], ["t"], "deleted").select("u", "k")) == [(1, "b")]


def test_long_lists_are_refused(spark):
    with pytest.raises(ValueError):
        store.limit(spark.range(3), 51)


def test_a_batch_that_is_sent_again_counts_once(spark, tmp_path):
    from quizloom.streaming import live

    def batch(*rows):
        return spark.createDataFrame([*rows], "id int, n long")

    write = live.upserting(str(tmp_path), lambda old, new: store.increments(old, new, "id", "n"))
    write(batch((1, 1), (2, 5)), 0)
    write(batch((1, 2), (3, 1)), 1)
    write(batch((1, 2), (3, 1)), 1)
    assert rows_of(spark.read.parquet(f"{tmp_path}/1").select("id", "n")) == [(1, 3), (2, 5), (3, 1)]


def test_array_unions_keep_empty_documents(spark):
    old = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k int, x array<string>")
    new = spark.createDataFrame([(1, ["b", "c"]), (1, ["c"]), (3, ["z"])], "k int, x array<string>")
    assert rows_of(store.array_unions(old, new, "k", "x")) == [(1, ["a", "b", "c"]), (2, []), (3, ["z"])]
