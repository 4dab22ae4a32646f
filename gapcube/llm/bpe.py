"""Byte-pair encoding and decoding by a pair occurrence index.

A section of a partition (up to `SECTION_BYTES` of text) gives its distinct words. All of them lie in one symbol array
with links to the neighbours; an index maps each pair to all its positions. The active ranks are taken in ascending
order; a rank merges all its positions at once and hands the new neighbouring pairs to their lists. Documents are then
rows of word numbers, and ids and decoded bytes are gathered from flat arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import batches, table, tokenizer_path
from gapcube.llm.packing import byte_alphabet

SECTION_BYTES = 32 << 20
#: How byte-level vocabularies of this family split text. White space is Unicode's, spelled out.
WHITE = r"\t-\r \x85\xA0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
ENCODED = "doc_id long, ids binary, decoded string"


class Vocabulary:
    """Ids, merges in rank order, and bytes of every id, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(SPLIT)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.byte_id = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int32)
        keys = left << 32 | right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                raw[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank_of[i], -1)

    def split(self, text: str) -> list:
        """Words of a text; a special token is its id."""
        if self.parts is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else self.words.findall(part)
        return out


def encode_words(v: Vocabulary, words: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the n + 1 offsets."""
    raw = [w.encode() if isinstance(w, str) else b"\0" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    n = len(data)
    none = n  # the dummy neighbour at both ends of a word
    token = np.append(v.byte_id[data], np.int32(-1))
    for k, w in enumerate(words):
        if not isinstance(w, str):
            token[at[k]] = w
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    if n:
        after[at[1:] - 1], before[at[:-1]] = none, none
    after[none], before[none] = none, none

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def note(places: np.ndarray, ranks: np.ndarray) -> None:
        """Append positions to the lists of their pairs."""
        found = ranks >= 0
        places, ranks = places[found], ranks[found]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
            if r not in index:
                heapq.heappush(active, r)
            index[r].append(p)

    inner = np.flatnonzero(after[:n] != none)
    note(inner, v.ranks(token[inner], token[after[inner]]))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        p = np.unique(np.concatenate(lists))  # neighbours merged together note their pair twice
        a, b, c = v.left[r], v.right[r], v.made[r]
        p = p[(token[p] == a) & (token[after[p]] == b)]
        if a == b and len(p) > 1:  # of a chain of equal symbols take the first, third, ... pair
            start = np.concatenate([[True], after[p[:-1]] != p[1:]])
            i = np.arange(len(p))
            p = p[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
        if not len(p):
            continue
        q = after[p]
        s = after[q]
        token[p], token[q] = c, -2
        after[p] = s
        before[s] = p
        before[none] = none
        left = before[p]
        with_left, with_right = left != none, s != none
        places = np.concatenate([left[with_left], p[with_right]])
        note(places, v.ranks(token[places], token[after[places]]))
    alive = token[:n] >= 0
    return token[:n][alive].astype("<u4"), np.concatenate([[0], np.cumsum(alive)])[at]


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs values[at[i]:at[i + 1]] of all i in `which`, one after the other."""
    size = at[which + 1] - at[which]
    total = int(size.sum())
    shift = np.repeat(at[which] - (np.cumsum(size) - size), size)
    return values[shift + np.arange(total)]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    return gather(v.bytes, v.at, ids.astype(np.int64)).tobytes().decode("utf-8", "replace")


def encode_section(v: Vocabulary, texts: list[str | None]) -> list[np.ndarray]:
    number: dict = defaultdict()
    number.default_factory = number.__len__
    rows = [np.fromiter(map(number.__getitem__, v.split(t or "")), np.int64) for t in texts]
    ids, at = encode_words(v, list(number))
    return [gather(ids, at, r) for r in rows]


def sections(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches(it):
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def coded(path: str, limit: int, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        for held in sections(it, limit):
            number: dict = defaultdict()
            number.default_factory = number.__len__
            rows = [np.fromiter(map(number.__getitem__, v.split(t or "")), np.int32) for b in held for t in b.column(1).to_pylist()]
            ids, at = encode_words(v, list(number))
            del number
            k = 0
            for b in held:
                out = []
                for _ in range(b.num_rows):
                    mine = gather(ids, at, rows[k].astype(np.int64))
                    out.append((mine.tobytes(), decode(v, mine)))
                    k += 1
                if digest:
                    cols = [pa.array([len(x) // 4 for x, _ in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in out]),
                            pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in out])]
                    yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    cols = [pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.string())]
                    yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "ids", "decoded"])
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           section_bytes: int = SECTION_BYTES, digest: bool = False) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) of every text and the text decoded from them, or digests of both.

    Null and empty texts have no ids. Repeated rows give repeated rows; other columns are ignored; empty input gives
    empty output. A text that names a special token has that token's id there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else ENCODED
    return rows.mapInArrow(coded(tokenizer or tokenizer_path(), section_bytes, digest), schema)


def op9_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), digest=True)
