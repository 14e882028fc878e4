"""op11: alignment against whole-text encoding and loops over tokens, and the cases of the contract."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from quizloom.llm import align
from quizloom.session import read_table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text, both):
    """(id, end) of either side for the whole text at once; none where the bytes differ."""
    if not text:
        return [], []
    sides = []
    for ids, size in ((both.a.encode(f" {text}", add_special_tokens=False).ids, both.bytes_a), (both.b.encode(text, num_threads=1), both.bytes_b)):
        if b"".join(size[i] for i in ids) != f" {text}".encode():
            return [], []
        at, side = 0, []
        for i in ids:
            at += len(size[i])
            side.append((i, at))
        sides.append(side)
    return sides


def brute(rows):
    both, out, held, links_of = align.tokenizers(A, B), [], Counter(), []
    for _, text in rows:
        a, b = tokens(text, both)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(([i for i, e in a if low < e <= c], [i for i, e in b if low < e <= c]))
            low = c
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        links_of.append((links, len(a), len(b), groups))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for (doc_id, _), (links, n_a, n_b, groups) in zip(rows, links_of, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(m for p, m in links.items() if held[p] == top[p[0]])
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, sum(m * held[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\na", "a \nb", "a\n b", "  lead and trail  ", "tab\there\r\nthere", "<|endoftext|> <s> </s> <unk> <0x0A>x",
    "don't we'll they've", "I 'll", "café naïve Ångström", "é ́x", "你好 世界", "\U0001f600 \U0001f468‍\U0001f469", "▁ is ▁mark", "x▁y z", "a b 　c", "​ a ​b",
    "\x00 \x01a\x7f b", "\x1c a\x1d b\x85 c", "᠎ x ᠎y", "1234567 890 12,345.67", "((( ))) --- === …", "https://a.org/b?c=d&e=f", "x" * 3000, "ab " * 2000, "the the the the", "߽࢘ \U00011f04 Ᲊ", "﻿bom text", "fiﬁ ½ ①",
]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [align.HEAD, 5, 0])
def test_odd_texts(spark, head):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the cat"), (None, "the cat"), (5, "the cat sat"), (5, None)]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS a", "2 AS row"), A, B, head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == brute(rows)


def test_documents(spark, sf):
    docs = read_table(spark, sf, "documents")
    assert rows_of(align.align(docs, A, B, 1000)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_memory_is_bounded(monkeypatch):
    """A task that forgets its stretches and hands on counts early comes to the same."""
    both, texts = align.tokenizers(A, B), [t for t in ODD if t] * 2
    whole = align.Aligner(both)
    rows, pairs = whole.align(texts)
    monkeypatch.setattr(align, "MEMO_CHUNKS", 3)
    small, again, counts = align.Aligner(both), [], Counter()
    for t in texts:
        again += small.align([t])[0]
        for r in small.counted().to_pylist():
            counts[r["a"], r["b"]] += r["n"]
    assert again == rows and counts == {(r["a"], r["b"]): r["n"] for r in whole.counted().to_pylist()}


def test_ranks_equal_the_library(sf):
    """On ASCII stretches, ids as ranks give what the library's whole encoding gives."""
    import random

    import pyarrow.parquet as pq

    both = align.tokenizers(A, B)
    assert both.ranks is not None and both.may_split
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() if t]
    known = sorted({c for t in texts for c in both.split(t) if c.isascii()})
    r = random.Random(4)
    known += ["".join(r.choice(" \nabcdeABZ0123'.,-_<|>\t\x00\x1c\x7f") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    assert len(known) > 5000
    assert [both.ranks.encode_ordinary(c) for c in known] == [e.ids for e in both.a.encode_batch_fast(known, add_special_tokens=False)]


def test_stretches_together_and_apart():
    both = align.tokenizers(A, B)
    chunks = list(dict.fromkeys(c for t in ODD if t for c in both.split(t)))
    good, a, b, bad = both.encode_all(chunks)
    assert sorted([*good, *bad]) == sorted(chunks)
    one = [both.encode([c], False) for c in good]
    assert a == [i for x, _ in one for i in x[0]] and b == [i for _, y in one for i in y[0]]
