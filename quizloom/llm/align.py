"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece BPE (B) over the same bytes.

1. A text (behind one space) is split where neither tokenizer can have a token across: before a single space or line feed between
   two characters that are no white space. A's pattern never continues over such a place, and B has no piece that does (its
   vocabulary is examined; with another one, or another pre-tokenizer of A, texts stay whole). So a stretch has the same tokens
   wherever it stands, and every task encodes and aligns each distinct stretch once.
   New stretches are encoded many at a time, as one text whose tokens fall apart at their edges. For stretches of ASCII, whose
   classes no edition of Unicode changes, A runs on its vocabulary as ranks; its merges are checked to be in that order.
2. New stretches are aligned in DuckDB, inside the task: tables of token intervals; ASOF joins find tokens that end where one of
   the other side ends; window sums of those cuts number the groups; a range join finds each group's stretch; a join of the
   two sides' groups counts id pairs.
3. Documents are bags of stretches: a join gives each document's distinct id pairs with their number of links. Pairs are summed
   over the task's documents, and these partial counts are merged in Spark.
4. Counts return to the documents' pairs: the most frequent HEAD pairs by a broadcast join, all others by a shuffled one. A pair
   outside the head stands in few documents, so no key of that join is hot.

A worker holds MEMO_CHUNKS known stretches at most beside a slice's own (then it forgets them) and a slice of texts; a text is split and
digested as a whole, so the longest one has to fit in a worker. All tables are in the shared folder.

Contract of the cases: texts that are null or empty, or whose tokens of either side do not spell space + text byte by byte,
have no tokens: zeros, and an empty groups_sha256. Special tokens' strings in a text are plain text. Repeated rows and null
doc_ids are documents of their own, also for the counts. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.batches import slices
from quizloom.session import cut, scoped

#: Pairs whose counts are broadcast (a long and a row of three values each).
HEAD = 500_000
#: Distinct stretches that a task knows before it forgets them, and their characters.
MEMO_CHUNKS, MEMO_CHARS = 150_000, 1 << 25
#: Rows of partial counts that a task gathers before it hands them on, and pairs in a row that it hands on.
PARTIAL_ROWS, PARTIAL_SLICE = 500_000, 50_000
#: Bytes of text that are aligned at a time, unless one text alone has more.
SLICE_BYTES = 1 << 20
#: Texts are split before a space or line feed that stands alone between characters that no edition of Unicode calls white space.
_EDGE = r"\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2060-\u2064\u2581\ufeff"
SPLIT = re.compile(rf"(?<=[^{_EDGE}])(?=[ \n][^{_EDGE}])")
#: Stretches whose edges are such places on either side.
LOOSE = re.compile(rf"[ \n][^{_EDGE}](?:.*[^{_EDGE}])?", re.S)
#: Characters of stretches that are encoded together.
TOGETHER = 1 << 13

ALIGN_SQL = """
CREATE OR REPLACE TEMP TABLE side_a AS
SELECT i, id, s, e, CAST(coalesce(sum(is_cut) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
FROM (SELECT x.*, CAST(y.e IS NOT DISTINCT FROM x.e AS INTEGER) AS is_cut FROM tokens_a x ASOF LEFT JOIN tokens_b y ON x.e >= y.e);
CREATE OR REPLACE TEMP TABLE side_b AS
SELECT i, id, s, e, CAST(coalesce(sum(is_cut) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g
FROM (SELECT x.*, CAST(y.e IS NOT DISTINCT FROM x.e AS INTEGER) AS is_cut FROM tokens_b x ASOF LEFT JOIN tokens_a y ON x.e >= y.e);
CREATE OR REPLACE TEMP TABLE grouped AS
SELECT c.chunk, g.g, g.n_a, h.n_b
FROM (SELECT g, count(*) AS n_a, min(s) AS s, max(e) AS e FROM side_a GROUP BY g) g
JOIN (SELECT g, count(*) AS n_b FROM side_b GROUP BY g) h USING (g)
JOIN chunks c ON g.s >= c.s AND g.e <= c.e;
INSERT INTO known_pairs
SELECT chunk, a, b, CAST(sum(n * m) AS BIGINT) FROM grouped
JOIN (SELECT g, id AS a, count(*) AS n FROM side_a GROUP BY ALL) USING (g) JOIN (SELECT g, id AS b, count(*) AS m FROM side_b GROUP BY ALL) USING (g)
GROUP BY chunk, a, b;
"""
CHUNK_SQL = """
SELECT chunk, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b, count(*) AS n_groups, CAST(sum(n_a * n_b) AS BIGINT) AS n_links
FROM grouped GROUP BY chunk"""
DOC_SQL = """
SELECT doc, a, b, CAST(sum(n * m) AS BIGINT) AS m FROM uses JOIN known_pairs USING (chunk) GROUP BY doc, a, b ORDER BY doc, a, b"""


#: Fixed value: the pattern of byte-level pre-tokenizers, which ids as ranks need in words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and whether texts may be split."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            # added tokens are no byte-level text: their strings are plain text and never become these ids
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        spec = json.loads(self.a.to_str())
        level = spec.get("pre_tokenizer") or {}
        apart = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and spec.get("normalizer") is None
        crossing = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.may_split = apart and not crossing
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))

        # after the single bytes, each merge makes the next id: then ids are ranks
        model = spec["model"]
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i < 256 + len(made)}
        self.ranks = None
        if self.may_split and made == list(range(256, 256 + len(made))) and sorted(map(len, self.bytes_a[:256])) == [1] * 256 and not model.get("ignore_merges"):
            import tiktoken

            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        return SPLIT.split(f" {text}") if self.may_split else [f" {text}"]

    def encode(self, texts: list[str], ascii_: bool) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of either side for texts that begin with a space or a line feed."""
        if ascii_ and self.ranks:
            a = [self.ranks.encode_ordinary(t) for t in texts]
        else:
            a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B adds a space: for the one that a text begins with, or as a token of its own before a line feed
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return a, [y if t[0] == " " else y[1:] for t, y in zip(texts, b, strict=True)]

    def spells(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = text.encode()
        return b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole

    def encode_all(self, chunks: list[str]) -> tuple[list[str], list[int], list[int], list[str]]:
        """The stretches that both sides spell, in an order of their own, both sides' ids for all of them one after another, and the other stretches."""
        loose = [[], []]
        alone = []
        for c in chunks:
            (loose[c.isascii()] if self.may_split and LOOSE.fullmatch(c) else alone).append(c)
        good, bad, a, b = [], [], [], []
        for ascii_ in (True, False):
            parts, size = [[]], 0
            for c in loose[ascii_]:
                if size > TOGETHER:
                    parts.append([])
                    size = 0
                parts[-1].append(c)
                size += len(c)
            joined = ["".join(p) for p in parts if p]
            for part, text, x, y in zip(parts, joined, *self.encode(joined, ascii_), strict=False):
                if self.spells(text, x, y):
                    good += part
                    a += x
                    b += y
                else:
                    alone += part
        for c, x, y in zip(alone, *self.encode(alone, False), strict=True):
            if self.spells(c, x, y):
                good.append(c)
                a += x
                b += y
            else:
                bad.append(c)
        return good, a, b, bad


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, end_b: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each stretch, which ends at the bytes ends, its groups as a1,a2|b1;a3|b2: every token is a cell of digits and what follows it."""
    n = len(a) + len(b)
    at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    value = np.empty(n, dtype=np.int64)
    value[at_a], value[at_b] = a, b
    width = len(str(int(value.max(initial=0))))
    cells = np.zeros((n, width + 1), dtype=np.uint8)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        cells[:, k] = np.where((value >= power) | (power == 1), 48 + value // power % 10, 0)
    last = lambda group: np.append(group[1:] != group[:-1], True)
    cells[at_a, width] = np.where(last(group_a), ord("|"), ord(","))
    closing = np.searchsorted(end_b, ends)  # B's last token of each stretch
    after = np.where(last(group_b), ord(";"), ord(","))
    after[closing] = 0
    cells[at_b, width] = after
    flat = cells.ravel()
    upto = np.cumsum((cells != 0).sum(axis=1))[at_b[closing]]
    text = flat[flat != 0].tobytes()
    return [text[s:e] for s, e in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]


class Aligner:
    """What one task knows: its stretches, their alignments in DuckDB, and partial counts of pairs."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '256MB'")
        self.drop_counts()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, spelt
        self.ids: list[bytes] = []
        self.chars = 0
        self.db.execute("CREATE OR REPLACE TABLE known_pairs (chunk BIGINT, a INTEGER, b INTEGER, m BIGINT)")

    def drop_counts(self) -> None:
        self.db.execute("CREATE OR REPLACE TABLE partial (a INTEGER, b INTEGER, n BIGINT)")
        self.n_partial = 0

    def with_tables(self, **tables: pa.Table) -> None:
        for name, table in tables.items():
            self.db.register(name, table)

    def learn(self, chunks: list[str]) -> None:
        """Aligns stretches that are not known yet."""
        first = len(self.index)
        good, a, b, bad = self.both.encode_all(chunks)
        self.index |= {c: first + i for i, c in enumerate([*good, *bad])}
        self.chars += sum(map(len, chunks))
        numbers, ids = np.zeros((len(chunks), 5), dtype=np.int64), [b""] * len(chunks)
        if good:
            ends = np.cumsum([len(c.encode()) for c in good])
            known = pa.table({"chunk": np.arange(first, first + len(good)), "s": np.append(0, ends[:-1]), "e": ends})
            sides = [(np.array(a), self.both.size_a), (np.array(b), self.both.size_b)]
            tables = []
            for flat, sizes in sides:
                at = np.cumsum(sizes[flat])
                tables.append(pa.table({"i": np.arange(len(flat)), "id": flat.astype(np.int32), "s": at - sizes[flat], "e": at}))
            self.with_tables(tokens_a=tables[0], tokens_b=tables[1], chunks=known)
            for step in ALIGN_SQL.split(";\n")[:-1]:
                self.db.execute(step)
            got = self.db.sql(CHUNK_SQL).to_arrow_table()
            at = np.array(got.column("chunk")) - first
            for j, c in enumerate(("n_a", "n_b", "n_groups", "n_links")):
                numbers[at, j] = np.array(got.column(c))
            numbers[: len(good), 4] = 1
            groups = [np.array(self.db.sql(f"SELECT g FROM {side} ORDER BY i").to_arrow_table().column("g")) for side in ("side_a", "side_b")]
            ids[: len(good)] = written(sides[0][0], sides[1][0], *groups, np.array(tables[1].column("e")), ends)
        self.numbers = np.concatenate([self.numbers, numbers])
        self.ids += ids

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, int, str]], pa.Table]:
        """n_a, n_b, n_groups, n_links, digest for each text; and a table doc, a, b, m of the distinct pairs."""
        if len(self.index) > MEMO_CHUNKS or self.chars > MEMO_CHARS:
            self.forget()
        split = [self.both.split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.index))
        if new:
            self.learn(new)
        rows, docs, used, times = [], [], [], []
        for doc, chunks in enumerate(split):
            at = [self.index[c] for c in chunks]
            numbers = self.numbers[at]
            if not at or not numbers[:, 4].all():
                rows.append((0, 0, 0, 0, ""))
                continue
            text = b";".join([self.ids[i] for i in at])
            rows.append((*numbers[:, :4].sum(axis=0).tolist(), hashlib.sha256(text).hexdigest()))
            bag = Counter(at)
            docs += [doc] * len(bag)
            used += bag.keys()
            times += bag.values()
        self.with_tables(uses=pa.table({"doc": pa.array(docs, pa.int64()), "chunk": pa.array(used, pa.int64()), "n": pa.array(times, pa.int64())}))
        pairs = self.db.sql(DOC_SQL).to_arrow_table()
        self.with_tables(pairs=pairs)
        self.db.execute("INSERT INTO partial SELECT a, b, count(*) FROM pairs GROUP BY a, b")
        self.n_partial += pairs.num_rows
        return rows, pairs

    def counted(self) -> pa.Table:
        """The partial counts since the last call."""
        out = self.db.sql("SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM partial GROUP BY a, b").to_arrow_table()
        self.drop_counts()
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def own_aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner, which keeps its stretches from one task to the next; counts of a task that broke off are dropped."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(tokenizers(path_a, path_b))
    out = _aligners[path_a, path_b]
    out.drop_counts()
    return out


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"]
KINDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For every document its numbers and its pairs (a, b, n: links); and rows without n_a that hold partial counts (n: documents)."""

    def lists(table: pa.Table, ends: np.ndarray, last: str) -> list[pa.Array]:
        offsets = pa.array(ends, pa.int32())
        flat = lambda c, kind: table.column(c).combine_chunks().cast(kind)
        return [pa.ListArray.from_arrays(offsets, flat(c, kind)) for c, kind in (("a", pa.int32()), ("b", pa.int32()), (last, pa.int64()))]

    def counts(aligner: Aligner) -> Iterator[pa.RecordBatch]:
        table = aligner.counted()
        ends = np.append(np.arange(0, table.num_rows, PARTIAL_SLICE), table.num_rows)
        nulls = [pa.nulls(len(ends) - 1, kind) for kind in (*[pa.int64()] * 5, pa.string())]
        if table.num_rows:
            yield pa.RecordBatch.from_arrays([*nulls, *lists(table, ends, "n")], FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = own_aligner(path_a, path_b)
        for batch in slices(batches, size=SLICE_BYTES):
            rows, pairs = aligner.align(batch.column("text").to_pylist())
            of_doc = np.bincount(np.array(pairs.column("doc"), dtype=np.int64), minlength=len(rows))
            numbers = [pa.array([r[j] for r in rows], pa.int64()) for j in range(4)]
            digests = pa.array([r[4] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, digests, *lists(pairs, np.append(0, np.cumsum(of_doc)), "m")], FIELDS)
            if aligner.n_partial > PARTIAL_ROWS:
                yield from counts(aligner)
        yield from counts(aligner)

    return docs.select("doc_id", "text").mapInArrow(run, KINDS)


def key_of() -> F.Column:
    return F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (no pair of its A id stands in more), from aligned's partial counts."""
    parts = found.where("n_a IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("_p")).select("_p.*")
    counts = cut(parts.groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # as many rows as A's vocabulary has, at most
    return cut(counts.join(F.broadcast(top), "a").select(key_of().alias("pair"), "n", (F.col("n") == F.col("top")).alias("best")))


def line_below(counts: DataFrame, head: int) -> int:
    """The smallest power of two such that no more than head pairs stand in so many documents or more."""
    steps = counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("step")).agg(F.count("*").alias("pairs")).collect()  # 64 rows at most
    line, sum_ = 64, 0
    for step, pairs in sorted(((r.step, r.pairs) for r in steps), reverse=True):
        sum_ += pairs
        if sum_ > head:
            break
        line = step
    return 1 << line if line < 63 else (1 << 63) - 1


@scoped
def align(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document."""
    found = cut(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(found)
    line = line_below(counts, head)
    links = found.where("n_a > 0").select("row", F.explode(F.arrays_zip("a", "b", F.col("n").alias("m"))).alias("_p")).select("row", F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), "_p.m")
    links = links.select("row", "m", key_of().alias("pair"))
    frequent, rare = counts.where(F.col("n") >= line), counts.where(F.col("n") < line)
    sums = [F.sum(F.col("m") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best")]
    told = links.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    if not rare.isEmpty():
        rest = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
        told = told.unionByName(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    own = found.where("n_a IS NOT NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(told, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
