"""Scores of whole documents by a gated recurrent language model that learns from the documents themselves.

1. Tasks cut their documents into segments of bounded text size, each with a dictionary of its words, and store tokens as
   numbers of the dictionary. Words of all dictionaries are counted over all training documents.
2. Dictionaries are joined with the counts, and every document gets its count-based sums and its codes for the network:
   the most frequent words have a code each; the others share codes by the power of two of their count and a hash.
3. The network (`gru.py`) learns in rounds: in each, every task goes on from the common weights over its own share of the
   training documents, and weights are averaged in proportion to tokens, by a tree of grouped sums. The rounds use every
   training document once. The first rounds are small, so tasks stay close to each other.
4. Tasks score all documents with the state carried through the whole text.

A word of the tail has the probability of its class times its share of the class's count. Words that training lacks are
one more type in the class of words seen once; its share follows from the numbers of words seen once and twice.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.llm import gru
from gapcube.llm.common import crc_of_id, flat, table
from gapcube.session import written

#: Bytes of text of a segment (a longer document is one of its own), and of a document split into words at a time.
SEGMENT_BYTES, SLICE_BYTES = 8 << 20, 4 << 20
#: Words with a code of their own, and their classes; codes of each class of the tail; classes of the tail (powers of two).
WORDS, CLASSES, BUCKETS, TAIL = 512, 16, 32, 64
#: Documents of a segment are dealt over so many parts; the parts that end each round. All parts are learnt from.
PARTS, ROUNDS = 64, (2, 8, 24, 64)
#: Tokens that a task holds at a time when it learns or scores; a longer document is held whole.
TOKENS = 1 << 22
#: Floats of a piece of the weights, and pieces that meet in one step of the averaging.
PIECE, FAN_IN = 1 << 14, 64

END = b""  # no word is empty
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENT = "segment long, id long, learn boolean, held_out boolean, part int, low binary, high binary, words array<binary>, counts array<long>"
CODED = "id long, learn boolean, held_out boolean, part int, n_tokens long, n_known long, base_score double, tail_score double, codes binary"


def number_words(text: bytes, names: dict[bytes, int]) -> array:
    """The text's words and the end as numbers; new words are added to `names`. Split in slices that end at white space."""
    out, at = array("I"), 0
    while at < len(text):
        part = text[at:at + SLICE_BYTES]
        at += len(part)
        while at < len(text) and not part[-1:].isspace():
            more = text[at:at + 4096]
            cut = next((i + 1 for i in range(len(more)) if more[i:i + 1].isspace()), len(more))
            part += more[:cut]
            at += cut
        out.extend([names.setdefault(w, len(names)) for w in part.translate(LOWERED).split()])
    out.append(names.setdefault(END, len(names)))
    return out


def segment_rows(segment: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents (tokens in two planes of 16 bits, frequent words first) and one of the dictionary."""
    names: dict[bytes, int] = {}
    tokens = [number_words(text, names) for _, _, text in held]
    flat_ = np.frombuffer(b"".join(t.tobytes() for t in tokens), np.uint32)
    size = np.array([len(t) for t in tokens])
    order = np.argsort(-np.bincount(flat_, minlength=len(names)), kind="stable")
    rank = np.empty(len(names), np.uint32)
    rank[order] = np.arange(len(names))
    flat_ = rank[flat_]
    ends = np.cumsum(size)
    learn = np.array([not out for _, out, _ in held])
    counts = np.bincount(flat_[np.repeat(learn, size)], minlength=len(names))
    planes = [[v[e - s:e].tobytes() for s, e in zip(size, ends)] for v in ((flat_ & 0xFFFF).astype("<u2"), (flat_ >> 16).astype("<u2"))]
    words = list(names)
    n = len(held)
    labels = [f.split()[0] for f in SEGMENT.split(", ")]
    for i in range(0, n, 1024):
        m = min(1024, n - i)
        yield pa.RecordBatch.from_arrays([
            pa.array([segment] * m, pa.int64()), pa.array([h[0] for h in held[i:i + m]], pa.int64()), pa.array(learn[i:i + m]), pa.array(~learn[i:i + m]),
            pa.array(np.arange(i, i + m, dtype=np.int32) % PARTS), *[pa.array(p[i:i + m], pa.binary()) for p in planes],
            pa.nulls(m, pa.list_(pa.binary())), pa.nulls(m, pa.list_(pa.int64()))], names=labels)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    last = [segment, None, None, None, None, None, None, [words[i] for i in order], counts]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, kinds)], names=labels)


def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b in it:
        data, at = flat(b.column(2))
        for i, (doc_id, out) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            text = data[at[i]:at[i + 1]].tobytes()
            if held and size + len(text) > SEGMENT_BYTES:
                yield from segment_rows(segment, held)
                segment, held, size = segment + 1, [], 0
            held.append((doc_id, out, text))
            size += len(text) + 64
    if held:
        yield from segment_rows(segment, held)


@dataclass(frozen=True)
class Corpus:
    """Counts over all training documents: tokens, types, most frequent words, and words and tokens of every tail class;
    the share of its class that a word without count has."""
    tokens: int
    types: int
    top: list[tuple[bytes, int]]
    tail_words: np.ndarray
    tail_tokens: np.ndarray
    unseen: float

    def layout(self) -> gru.Layout:
        """Ranges of frequent words with about equal sums of square roots of counts, and the tail classes in use."""
        weight = np.sqrt([c for _, c in self.top])
        place = np.minimum((np.cumsum(weight) - weight) / max(weight.sum(), 1) * CLASSES, CLASSES - 1).astype(int)
        edges = np.concatenate([np.flatnonzero(np.diff(place, prepend=-1)), [len(place)]]) if len(place) else np.zeros(1, int)
        there = (self.tail_words > 0) | (np.arange(TAIL) == 0)
        return gru.Layout(edges, np.where(there, np.cumsum(there) - 1, -1), BUCKETS)

    def weights(self, layout: gru.Layout) -> dict[str, np.ndarray]:
        counts = np.array([c for _, c in self.top], float)
        head = np.add.reduceat(counts, layout.edges[:-1]) if len(counts) else np.zeros(0)
        tail = self.tail_tokens[(self.tail_words > 0) | (np.arange(TAIL) == 0)]
        share = np.concatenate([head, tail]) + 1
        return layout.start(share / share.sum(), counts / np.repeat(head, np.diff(layout.edges)) if len(counts) else counts)


def corpus_of(counts: DataFrame) -> Corpus:
    """`counts` has (word, c), c > 0. The driver takes sums, WORDS words and at most TAIL classes."""
    whole = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    top = [(bytes(r[0]), r[1]) for r in counts.orderBy(F.desc("c"), "word").limit(WORDS).collect()]
    words, tokens = np.zeros(TAIL), np.zeros(TAIL)
    for k, n, c in counts.groupBy(tail_class().alias("k")).agg(F.count("*"), F.sum("c")).collect():
        words[k], tokens[k] = n, c
    for _, c in top:
        words[c.bit_length() - 1] -= 1
        tokens[c.bit_length() - 1] -= c
    again = 2 * (whole[3] + 1) / (whole[2] + 1)  # expected further count of a word seen once
    return Corpus(whole[0] or 0, whole[1], top, words, tokens, 1 / (1 + again) if words[0] > 0 else 1.0)


def tail_class() -> Column:
    """The power of two of a count: 0 for 0 and 1."""
    return (F.length(F.bin(F.greatest("c", F.lit(1)))) - 1).cast("int")


def coder(corpus: Corpus):
    """Codes and sums of the documents of a segment, from its tokens and its dictionary (place, c, head, bucket)."""
    def run(key: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        c, head, bucket = (np.empty(len(place), np.int64) for _ in range(3))
        for to, name in ((c, "c"), (head, "head"), (bucket, "bucket")):
            to[place] = words.column(name).to_numpy()
        kind = np.maximum(np.int64(0), np.frexp(np.maximum(c, 1).astype(float))[1] - 1)
        own = head >= 0
        code = np.where(own, head, len(corpus.top) + kind * BUCKETS + bucket)
        base = np.log10((c + 1) / (corpus.tokens + corpus.types + 1))
        share = c / np.maximum(corpus.tail_tokens[kind], 1)
        share = np.where(kind == 0, np.where(c > 0, share * (1 - corpus.unseen), corpus.unseen), share)
        tail = np.where(own, 0.0, np.log10(np.where(own, 1.0, share)))
        out: list[list] = [[], [], [], [], []]
        for low, high in zip(docs.column("low"), docs.column("high")):
            t = np.frombuffer(low.as_buffer(), "<u2") + (np.frombuffer(high.as_buffer(), "<u2").astype(np.int64) << 16)
            for to, v in zip(out, (len(t), int((c[t] > 0).sum()), math.fsum(base[t]), math.fsum(tail[t]), code[t].astype("<u2").tobytes())):
                to.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([*[docs.column(n) for n in ("id", "learn", "held_out", "part")], *[pa.array(v, t) for v, t in zip(out, kinds)]], names=[f.split()[0] for f in CODED.split(", ")])
    return run


def coded_documents(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> tuple[Corpus, DataFrame]:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("out"), F.col(text_col).alias("text"))
    stored = written(rows.mapInArrow(segments, SEGMENT), "segments")
    words = stored.filter("words IS NOT NULL").select("segment", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("segment", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "word-counts")
    corpus = corpus_of(counts)
    heads = docs.sparkSession.createDataFrame([(w, i) for i, (w, _) in enumerate(corpus.top)], "word binary, head int")
    known = words.join(counts, "word", "left").join(F.broadcast(heads), "word", "left")  # WORDS rows at most
    known = known.select("segment", "place", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("head", F.lit(-1)).alias("head"), F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket"))
    texts = stored.filter("words IS NULL").select(F.col("segment").alias("at"), "id", "learn", "held_out", "part", "low", "high")
    return corpus, written(texts.groupBy("at").cogroup(known.groupBy("segment")).applyInArrow(coder(corpus), CODED), "coded")


def held_batches(it: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches together with their codes, some TOKENS tokens at a time."""
    rows, codes, size = [], [], 0
    for b in it:
        start = 0
        for i, v in enumerate(b.column(column)):
            codes.append(np.frombuffer(v.as_buffer(), "<u2").astype(np.int64))
            size += len(codes[-1])
            if size >= TOKENS:
                yield [*rows, b.slice(start, i + 1 - start)], codes
                rows, codes, size, start = [], [], 0, i + 1
        if start < b.num_rows:
            rows.append(b.slice(start))
    if codes:
        yield rows, codes


def averaged(pieces: DataFrame, folder: str) -> dict[int, np.ndarray]:
    """Weighted means of pieces (task, piece, weight, values) by piece; FAN_IN tasks meet in one step."""
    def add(group: pa.Table) -> pa.Table:
        total, weight = 0.0, 0.0
        for w, v in zip(group.column("weight").to_pylist(), group.column("values")):
            total = total + w * np.frombuffer(v.as_buffer(), "<f8")
            weight += w
        return pa.table([group.column("task").slice(0, 1).cast(pa.int64()), group.column("piece").slice(0, 1), pa.array([weight]), pa.array([(total / weight).astype("<f8").tobytes()], pa.binary())], names=["task", "piece", "weight", "values"])

    while True:
        pieces = written(pieces.withColumn("task", F.expr(f"task DIV {FAN_IN}")).groupBy("task", "piece").applyInArrow(add, "task long, piece int, weight double, values binary"), folder)
        if not pieces.agg(F.max("task")).first()[0]:
            return {r["piece"]: np.frombuffer(r["values"], "<f8") for r in pieces.select("piece", "values").collect()}


def trained(coded: DataFrame, corpus: Corpus, rounds: tuple[int, ...] = ROUNDS) -> tuple[gru.Layout, dict[str, np.ndarray]]:
    """The network after rounds over all documents to learn from; without any it gives the corpus shares."""
    layout = corpus.layout()
    weights = corpus.weights(layout)
    state = [weights, {n: np.zeros_like(v) for n, v in weights.items()}]
    shapes = [(k, n, v.shape, v.size) for k in (0, 1) for n, v in sorted(weights.items())]
    begin = 0
    for end in rounds:
        start = np.concatenate([state[k][n].ravel() for k, n, _, _ in shapes])

        def learn(it: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            at, mine = 0, ({}, {})
            for k, n, shape, size in shapes:
                mine[k][n] = start[at:at + size].reshape(shape).copy()
                at += size
            tokens = 0
            for _, codes in held_batches(it, 0):
                gru.learn(*mine, layout, codes)
                tokens += sum(map(len, codes))
            if tokens:
                whole = np.concatenate([mine[k][n].ravel() for k, n, _, _ in shapes]).astype("<f8")
                parts = [whole[i:i + PIECE].tobytes() for i in range(0, len(whole), PIECE)]
                m, task = len(parts), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([task] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([float(tokens)] * m), pa.array(parts, pa.binary())], names=["task", "piece", "weight", "values"])

        some = coded.filter(F.col("learn") & (F.col("part") >= begin) & (F.col("part") < end)).select("codes")
        found = averaged(some.mapInArrow(learn, "task long, piece int, weight double, values binary"), "weights")
        begin = end
        if found:
            whole, at = np.concatenate([found[i] for i in range(len(found))]).astype(np.float32), 0
            for k, n, shape, size in shapes:
                state[k][n] = whole[at:at + size].reshape(shape)
                at += size
    return layout, state[0]


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Null and empty texts are the end alone. Where `held_out` is null or false a row is learnt from. Null ids and repeated
    rows are rows like others, and repeated rows count as often. If nothing is learnt from, all words are one unknown
    type of probability 1. Other columns are ignored.
    """
    corpus, coded = coded_documents(docs, id_col, text_col, held_out)
    layout, weights = trained(coded, corpus)
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "tail_score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes in held_batches(it, len(names)):
            got, at = gru.score(weights, layout, codes) / math.log(10), 0
            for b in rows:
                total = got[at:at + b.num_rows] + b.column(len(names) - 1).to_numpy()
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names) - 1], pa.array(total)], names=[*names[:-1], "score"])

    out = coded.select(*names, "codes").mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(corpus.tokens).cast("long"))


def op13_lm_scoring(spark, sf_dir):
    out = scored(table(spark, sf_dir, "documents"), crc_of_id() % 7 == 2)
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
