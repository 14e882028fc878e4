"""Queries read all their rows: each against brute force on a small fixture."""

import itertools
import math
import random
from collections import Counter

from quizloom.operators import graph, pairing
from quizloom.plans import registry
from quizloom.plans.match import SYNONYMS


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return sorted(tuple(r) for r in registry.queries()[name](spark, str(folder)).collect())


def one_edit(a, b):
    """Whether at most one insertion, deletion or replacement makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_names_too_close_sends_no_customers_through_the_driver(spark, sf):
    """Whatever the size at which joins become broadcasts: the customers and their forms are no small tables."""
    plan = registry.queries()["names_too_close"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3


def test_names_too_close_compares_all_customers(spark, tmp_path):
    names = ["Anna", "anna", "Ana", "Hanna", "Bob", "Rob", "Robb", "", "x", "xy", "aab", "aba", "abab", "Ann a", "Zoë", "zoe"]
    rows = [(id_, name) for i, name in enumerate(names) for id_ in (i + 1, 395 + 7 * i)] + [(9001, None)]
    key = {id_: "".join(c for c in name.lower().replace("ë", "e") if c.isalnum()) for id_, name in rows if name is not None}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(key), 2) if one_edit(key[a], key[b]))
    assert run(spark, tmp_path, "names_too_close", customer=(rows, "c_custkey long, c_name string")) == want


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts):
    """The documents table of (doc_id, lang, text)."""
    return [(i, text, lang, "s", len(text)) for i, lang, text in texts], DOCUMENTS


def test_similarity_join_reads_long_documents(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("bdfgklmnprtv") + r.choice("aeiou") for _ in range(3)) for _ in range(60)]
    texts = {i: [r.choice(vocabulary) for _ in range(r.choice([12, 30, 700]))] for i in range(14)}
    texts |= {i + 20: [r.choice(vocabulary) if r.random() < 0.2 else w for w in texts[i]] for i in range(14)}
    lang = {i: "en" if i % 20 < 10 else "de" for i in texts}
    assert sum(len(" ".join(t)) >= 2500 for t in texts.values()) >= 6
    want = []
    for group in ("en", "de"):
        own = {i: Counter(t) for i, t in texts.items() if lang[i] == group}
        df = Counter(w for c in own.values() for w in c)
        vector = {i: {w: (1 + math.log(n)) * (math.log((1 + len(own)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in own.items()}
        length = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
        for a, b in itertools.combinations(sorted(own), 2):
            cosine = sum(x * vector[b].get(w, 0) for w, x in vector[a].items()) / length[a] / length[b]
            if cosine >= 0.62:
                want.append((group, a, b, round(cosine, 4)))
    got = run(spark, tmp_path, "similarity_join", documents=documents(*[(i, lang[i], " ".join(t)) for i, t in texts.items()]))
    assert [(g, a, b, round(c, 4)) for g, a, b, c in got] == sorted(want)


def linked_questions():
    """Questions of many and long lines, and the pairs (a, b, option map, conflict) by comparing all with all."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("bdfgklmnprtv") + r.choice("aeiou") for _ in range(5))
    texts = {}
    for k, (n, wide) in enumerate([(3, 2), (5, 2), (7, 2), (9, 60), (2, 180)]):
        lines = [" ".join(word() for _ in range(wide)) for _ in range(n)]
        head = f"bado{k} " + " ".join(word() for _ in range(6))
        shuffled = r.sample(lines, n)
        for j, own in enumerate([lines, lines, shuffled, lines[:-1] + [word() + " " + word()], lines[:-1], lines + [word()]]):
            texts[10 * k + j] = [head, *own]
    assert sum(len("\n".join(t)) >= 3000 for t in texts.values()) >= 6
    text = lambda line: pairing.Text(line.split(), line)
    want = []
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = texts[a], texts[b]
        if x[0] == y[0] and len(x) == len(y) and (found := pairing.pair_options([text(o) for o in x[1:]], [text(o) for o in y[1:]])) is not None:
            want.append((a, b, ",".join(map(str, found)), found[a % 2] != b % 2))
    return documents(*[(i, "en", "\n".join(t)) for i, t in texts.items()]), sorted(want)


def test_constellations_compare_all_options_of_all_documents(spark, tmp_path):
    table, want = linked_questions()
    assert (20, 21, "0,1,2,3,4,5,6", True) in want and not any((a, b) == (20, 23) for a, b, *_ in want)
    assert run(spark, tmp_path, "constellation_pairs", documents=table) == want
    assert run(spark, tmp_path, "constellations") == components((a, b) for a, b, _, conflict in want if not conflict)


def components(edges):
    """(node, the smallest node linked to it) of all edges' nodes."""
    lead = {}

    def root(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        lead[y] = x
    return sorted((x, root(x)) for x in list(lead))


def tags(lang, text):
    """(concept, score, place) of a text in lower case without marks, by looking at every place of every term."""
    stem, *rest = [line for line in text.split("\n") if line.strip()] or [""]
    found = lambda term, words: sum(" ".join(words[i : i + len(term.split())]) in (term, term + "s", term + "es") for i in range(len(words)))
    score, order, parents = Counter(), {}, {}
    for i, (module, concept, parent, term) in enumerate(SYNONYMS):
        order.setdefault(concept, i)
        parents[concept] = parent
        if module == lang:
            score[concept] += (300 + len(term)) * (found(term, stem.split()) > 0) + 100 * min(2, found(term, " ".join(rest).split()))
    score = {c: n for c, n in score.items() if n}
    best = max(score.values(), default=0)
    kept = {c for c, n in score.items() if n >= 300 or (best < 300 and n >= best)}
    kept = {c for c in kept if not any(parents[x] == c for x in kept)} or kept
    return [(c, score[c], k + 1) for k, c in enumerate(sorted(kept, key=lambda c: (-score[c], order[c]))[:3])]


def test_dictionary_tags_reads_whole_texts(spark, tmp_path):
    filler = "bado kelu mira " * 120
    texts = [
        ("en", f"{filler}are\n{filler}"), ("en", f"bado\n{filler}\n{filler} of the things\nand the tion"), ("en", "and the\n\nthing thing thing"), ("en", "bado"), ("en", ""),
        ("en", f"\n \n{'x' * 299} the\nof the"), ("de", f"bado\n{filler}\nist die\ndie der"), ("fr", f"bado\n{filler}de la\n{filler}\nde la"), ("es", f"{filler}que de los\nen"),
    ]
    want = sorted((i, *row) for i, (lang, text) in enumerate(texts) for row in tags(lang, text))
    assert run(spark, tmp_path, "dictionary_tags", documents=documents(*[(i, *t) for i, t in enumerate(texts)])) == want


LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date, o_orderstatus string, o_totalprice double"
CUSTOMER = "c_custkey long, c_mktsegment string"


def bank(options, status):
    """Tables of questions (number: texts of two letters, the line's status and flag, in order) in two modules."""
    lines = [(q, 1, 1, i, 1.0, 1.0, 0.5, t[1], t[0]) for q, opts in options.items() for i, t in enumerate(opts)]
    orders = [(q, 1 + q // 30, "5-LOW", None, status[q], 1.0) for q in options]
    return {"lineitem": (lines, LINEITEM), "orders": (orders, ORDERS), "customer": ([(1, "BUILDING"), (2, "MACHINERY")], CUSTOMER)}


def test_twins_of_any_number_of_options(spark, tmp_path):
    r = random.Random(7)
    kinds = [[r.choice("OF") + r.choice("RAN") for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 7)]
    opts = {q: r.sample(k, len(k)) if r.random() < 0.5 else k for q in range(60) for k in [r.choice(kinds)]}
    opts[31], opts[32] = kinds[4], kinds[4][::-1]
    status = {q: r.choice("FOP") for q in opts}
    stem = {q: q // 30 for q in opts}
    loose = {q: (stem[q], sorted(o)) for q, o in opts.items()}
    first = lambda rows: min(rows, default=None)
    merge = {q: first(o for o in opts if o % 2 and stem[o] == stem[q] and opts[o] == opts[q]) for q in opts if q % 2 == 0}
    merge = {q: first(o for o in opts if o % 2 and loose[o] == loose[q]) if m is None else m for q, m in merge.items()}
    fill = [(q, status[q] != "P", first(o for o in opts if status[o] != "P" and loose[o] == loose[q]) if status[q] == "P" else None) for q in opts]
    rep = {q: min((o for o in opts if loose[o] == loose[q]), key=lambda o: ("FO".find(status[o]) % 4, o)) for q in opts}
    run_ = lambda name, **tables: run(spark, tmp_path, name, **tables)
    assert dict(run_("keyed_text_merge", **bank(opts, status))) == merge
    assert {x[0]: x for x in map(tuple, registry.queries()["twin_fill"](spark, str(tmp_path)).collect())} == {x[0]: x for x in fill}
    assert run_("option_permutation") == sorted((q, ",".join(str(sorted(o).index(x)) for x in o)) for q, o in opts.items())
    same = run_("multiset_equality")
    assert same == [(q, q + 1) for q in range(59) if sorted(opts[q]) == sorted(opts[q + 1])] and (31, 32) in same
    assert run_("exact_duplicates") == sorted((q, x) for q, x in rep.items() if q != x and q % 3 == x % 3)


def test_components_take_links_from_every_line(spark, tmp_path):
    r = random.Random(9)
    lines = [(r.randrange(1, 400), r.randrange(1, 400), 1, 1, float(r.randrange(1, 51)), 1.0, r.randrange(11) / 100, "R", "O") for _ in range(150)]
    links = [(a, p * 7 % 15000) for a, p, *_ in lines]
    want = components([x for x in links if x[0] != x[1] and x[0] % 97 and x[1] % 97] + [(97, 194), (97, 291)])
    orders = [(q, 1 + q % 2, "5-LOW", None, "F", 1.0) for q in range(400)]
    got = run(spark, tmp_path, "components_of_links", lineitem=(lines, LINEITEM), orders=(orders, ORDERS), customer=([(1, "BUILDING"), (2, "MACHINERY")], CUSTOMER))
    assert got == want
    sets = {c: [1 + q % 2 for q, x in want if x == c and q < 400] for c in {c for _, c in want}}
    assert run(spark, tmp_path, "repeated_clusters") == sorted((c, 2, len(s)) for c, s in sets.items() if len(set(s)) == 2)


def test_must_know_lists_every_valid_item(spark, tmp_path):
    asked = {1: 25, 2: 3, 3: 1, 4: 30, 5: 3}
    lines = [(q, part, 1, 1, 1.0, 1.0, 0.0, "R", "O") for part, n in asked.items() for q in range(n)]
    parts = [(part, 5 if part == 4 else 20) for part in (*asked, 6)]
    got = run(spark, tmp_path, "must_know", lineitem=(lines, LINEITEM), part=(parts, "p_partkey long, p_size int"))
    assert got == [(1, 25, 1), (2, 3, 2), (3, 1, 4), (5, 3, 3)]


def test_components_send_each_edge_through_one_round_only(spark, monkeypatch):
    """Edges within what a round has found are gone, so all look-ups together are about those of the first round."""
    totals, real = [], graph.look_up
    monkeypatch.setattr(graph, "look_up", lambda left, groups, key, count, values, total: totals.append(total) or real(left, groups, key, count, values, total))
    r = random.Random(6)
    edges = list({(a, b) for a, b in ((r.randrange(80) + 80 * k, r.randrange(80) + 80 * k) for k in range(2) for _ in range(3000)) if a < b})
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(tuple(x) for x in got.collect()) == components(edges) and sum(totals) < 3 * len(edges)
