"""BPE encoding and decoding with a public vocabulary of word-end tokens.

Each word is merged over one contiguous array of part boundaries with the rank of every adjacent pair beside it: scan for
the smallest rank (the leftmost on ties), delete that boundary, refresh the two neighbouring ranks, until no pair has a
rank. Words are short, so the scan beats a heap; words of one length are merged side by side as rows of one matrix. Words
repeat, so each worker keeps what it has merged in a bounded memo. Words of more than MEMO_BYTES bytes are merged one by one,
with a heap in place of the scan, as the scan would cost the square of their length; the merges are the same.

Contract of the cases: a null text counts as empty; an empty text has no tokens and decodes to the empty text; a text of
any length is encoded whole; repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quizloom.llm.batches import slices

#: Words kept by a worker's memo before it is emptied.
MEMO_WORDS = 150_000
#: Words of more UTF-8 bytes than this are merged alone and not kept.
MEMO_BYTES = 64
#: Characters of text that are encoded together.
SLICE_CHARS = 1_000_000
NO_RANK = 1 << 60
#: Ids are below 2**BITS.
BITS = 24
NEW_ID = (1 << BITS) - 1

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


#: Letters and digits that Unicode 16 added to this Python's 15.1, as first and last code point. The library's
#: words are of that version.
ADDED = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
        (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
        (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
#: First and last capital that Unicode 16 and 17 added, and the first one's small letter. The library's small
#: letters are of version 17.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
LOWER = {first + i: small + i for first, last, small in CAPITALS for i in range(last - first + 1)} | {ord("Σ"): ord("σ")}
_capitals = re.compile("[" + "".join(map(chr, LOWER)) + "]").search
#: White_Space, as first and last code point.
SPACES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def class_ranges(kind: str, end: int) -> str:
    """The code points below end whose general category begins with kind (s: white space), as ranges of a character class."""
    more = SPACES if kind == "s" else ADDED.get(kind, [])
    own = {c for first, last in more for c in range(first, last + 1) if c < end}
    if kind != "s":
        own |= {c for c in range(end) if unicodedata.category(chr(c))[0] == kind}
    out, begin = [], None
    for c in range(end + 1):
        if c in own:
            begin = c if begin is None else begin
        elif begin is not None:
            out.append(f"{re.escape(chr(begin))}-{re.escape(chr(c - 1))}")
            begin = None
    return "".join(out)


def with_classes(pattern: str, end: int) -> str:
    """pattern with \\p{X} and \\s written out for the code points below end; X is the first letter of a general category."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        named = re.match(r"\\p\{(\w)\}|\\(s)", pattern[i:])
        if named:
            ranges = class_ranges(named[1] or named[2], end)
            out.append(ranges if inside else f"[{ranges}]")
            i += len(named[0])
            continue
        step = 2 if pattern[i] == "\\" else 1
        if pattern[i] in "[]":
            inside = pattern[i] == "["
        out.append(pattern[i : i + step])
        i += step
    return "".join(out)


#: Combining marks that Unicode added after the library's edition (10), up to 15.1, and the second half of the one
#: composition added since, as ranges. The library takes them for letters that nothing moves across.
NEWER_MARKS = """07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF
10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97
11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
_NEWER = re.compile("([" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER_MARKS.split()) + "])")


def composed(text: str) -> str:
    """NFC of the library's edition: stretches between newer marks are composed apart."""
    parts = _NEWER.split(text)
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(parts)) if len(parts) > 1 else unicodedata.normalize("NFC", text)


class WordBpe:
    """A tokenizer read from the text of a tokenizers JSON file whose model is BPE with a word-end suffix."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: Of a pair of adjacent ids (one number), its rank and the id of what it becomes (one number: ranks compare first).
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << BITS | self.vocab[b]] = rank << BITS | self.vocab[a + b]
        chars = byte_chars()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # for texts of code points below each end: classes of fewer ranges are faster
        self.ascii_words, self.plane_words, self.words = (re.compile(with_classes(pattern, end)).findall for end in (0x80, 0x10000, 0x110000))
        self.keys = np.array(sorted(self.ranks), dtype=np.int64)
        self.values = np.array([self.ranks[k] for k in self.keys.tolist()], dtype=np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, dtype=np.int64), np.array(self.last, dtype=np.int64)
        self.token_of = {str(i): t for i, t in self.token.items()}
        self.memo: dict[str, str] = {}

    def merge(self, word: str) -> list[int]:
        """The token ids of one word."""
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        rank_of = self.ranks.get
        ranks = [rank_of(a << BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = best & NEW_ID
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << BITS | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << BITS | parts[i + 1], NO_RANK)
        return parts

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """ranks.get for arrays of adjacent ids."""
        key = a << BITS | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def merge_many(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """merge for words of one length at once: pairs of word numbers and their ids, one row a word.

        Every word still at work loses one boundary a step, so the arrays stay rectangular.
        """
        data = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
        at = np.arange(len(words))
        parts = self.inner_ids[data]
        parts[:, -1] = self.last_ids[data[:, -1]]
        ranks = self.rank_of(parts[:, :-1], parts[:, 1:])
        while len(at):
            if not ranks.shape[1]:
                yield at, parts
                return
            i = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), i]
            ended = best == NO_RANK
            if ended.any():
                yield at[ended], parts[ended]
                going = ~ended
                at, parts, ranks, i, best = at[going], parts[going], ranks[going], i[going], best[going]
                if not len(at):
                    return
            row = np.arange(len(at))
            parts[row, i] = best & NEW_ID
            parts = parts[np.arange(parts.shape[1]) != i[:, None] + 1].reshape(len(at), -1)
            ranks = ranks[np.arange(ranks.shape[1]) != i[:, None]].reshape(len(at), -1)
            left, right = i > 0, i < ranks.shape[1]
            ranks[row[left], i[left] - 1] = self.rank_of(parts[row[left], i[left] - 1], parts[row[left], i[left]])
            ranks[row[right], i[right]] = self.rank_of(parts[row[right], i[right]], parts[row[right], i[right] + 1])

    def learn(self, words: set[str]) -> dict[str, str]:
        """The ids, joined by spaces, of these words: from the memo or merged now."""
        memo = self.memo
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(words)
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, str] = {}
        for w in new:
            data = w.encode()
            if len(data) > MEMO_BYTES:
                out[w] = " ".join(map(str, self._merge_long(w)))
            else:
                by_length.setdefault(len(data), []).append((w, data))
        for group in by_length.values():
            for at, ids in self.merge_many([data for _, data in group]):
                for k, found in zip(at.tolist(), ids.tolist()):
                    memo[group[k][0]] = " ".join(map(str, found))
        return memo | out if out else memo

    def _merge_long(self, word: str) -> list[int]:
        """The same merges for a word of thousands of bytes, with a heap in place of the scan."""
        import heapq

        data = word.encode()
        parts: list[int | None] = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.ranks.get(parts[i] << BITS | parts[j])):
                heapq.heappush(heap, (hit >> BITS, i, hit & NEW_ID, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = new, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, white space dropped, lower case character by character."""
        if text.isascii():
            return self.ascii_words(text.lower())
        text = composed(text)
        if _capitals(text):
            text = text.translate(LOWER)
        text = text.lower()
        below = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return self.plane_words(text) if below else self.words(text)

    def encoded(self, texts: list[str]) -> list[str]:
        """For each text, its ids joined by spaces."""
        split = [self.cut.split(t) if self.cut and any(x in t for x in self.special) else [t] for t in texts]
        words = [[self.split(part) if k % 2 == 0 else part for k, part in enumerate(parts)] for parts in split]
        ids_of = self.learn({w for parts in words for part in parts[::2] for w in part}).__getitem__
        out = []
        for parts in words:
            ids = [str(self.special[part]) if k % 2 else " ".join(map(ids_of, part)) for k, part in enumerate(parts)]
            out.append(ids[0] if len(ids) == 1 else " ".join(filter(None, ids)))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encoded([text])[0]
        return [int(i) for i in ids.split(" ")] if ids else []

    def decoded(self, ids: str) -> str:
        """decode for ids joined by spaces, all of which name tokens."""
        return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces; ids that name no token are skipped."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_loaded: dict[str, WordBpe] = {}


def _tokenizer(text: str) -> WordBpe:
    """One tokenizer a worker process, so that its memo lives from task to task."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(text)
    return _loaded[key]


def encoded_in_slices(bpe: WordBpe, texts: pa.Array) -> Iterator[str]:
    """encoded, over slices of about SLICE_CHARS characters, so that few words are in memory at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= SLICE_CHARS:
            yield from bpe.encoded(some)
            some, size = [], 0
    yield from bpe.encoded(some)


def encode_documents(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the number of tokens, the ids (space-joined digest) and the digest of what they decode to.

    tokenizer_path is read on the driver; the file's text (its size is the vocabulary's, not the data's) is broadcast.
    With keep, the ids themselves (array of int) and these columns of docs come too.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keep = keep or []
    fields = {f.name: f.dataType for f in docs.schema}
    own = SCHEMA + "".join(f", `{c}` {fields[c].simpleString()}" for c in keep) + (", ids array<int>" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared.value)
        for batch in slices(batches):
            n, ids_sha, text_sha, ids = [], [], [], []
            for joined in encoded_in_slices(bpe, batch.column("text")):
                n.append(joined.count(" ") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decoded(joined).encode()).hexdigest())
                if keep:
                    ids.append([int(i) for i in joined.split(" ")] if joined else [])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [batch.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32()))]
                names += [*keep, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    wanted = ["doc_id", "text", *[c for c in keep if c != "text"]]
    return docs.select(*wanted).mapInArrow(run, own)
