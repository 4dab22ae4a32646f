"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Tasks turn their documents into segments (shards) of bounded text size. A segment holds one row per term: its postings
in blocks of compressed document numbers, term counts and lengths, and for every block the (count, length) pairs that no
other pair of the block beats, so the block's largest score is known exactly once the corpus statistics are, without
unpacking it. All rows and all terms are indexed in one pass; statistics are sums over the index.

A search joins the index with the terms of the items, and walks each segment in windows of documents. Lists are ordered
by their bound in the window; those whose bounds together can't reach the heap's least score are not essential: only
documents of essential lists are candidates, and the others are asked for the candidates that block maxima don't rule
out, unpacking only the blocks of those. Segment heaps are merged at the end.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.llm.common import LOWER, UPPER, flat, table
from gapcube.session import written

TOP = 10
#: Bytes of text of a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 8 << 20
#: Bytes of a document that are split into terms at a time.
SLICE_BYTES = 4 << 20
#: Postings of a block; documents of a window.
BLOCK, WINDOW = 128, 2048
#: Items that are searched together in one group; more items make more groups.
ITEMS = 512
#: Length and saturation of the score, in hundredths and in eighths of a count (fixed values of the formula).
SHARE, SLOPE, UNIT = 75, 8, 1_000_000_000

#: Letters, digits and bytes of other characters are terms, A-Z in lower case; all else separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = ("segment long, term binary, df int, data binary, starts array<int>, last array<int>, size array<int>, wide array<int>, "
         "peaks array<long>, pairs array<int>, ids array<long>, docs long, terms long")
LISTS = ["starts", "last", "size", "wide", "peaks", "pairs"]


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a text, split in slices that end at a separator."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        part = text[at:at + SLICE_BYTES].translate(TERM_BYTES)
        at += len(part)
        while at < len(text) and part[-1:] != b" ":
            more = text[at:at + 4096].translate(TERM_BYTES)
            cut = more.find(b" ") + 1 or len(more)
            part += more[:cut]
            at += cut
        found.update(part.split())
    return found


def widths(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes (1, 2, 4 or 8) that the largest value of each block needs; `first` are the blocks' first places."""
    top = np.maximum.reduceat(values, first)
    return np.select([top < 1 << 8, top < 1 << 16, top < 1 << 32], [1, 2, 4], 8)


def packed(fields: list[np.ndarray], first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, blocks' first bytes and the end, widths as 4-bit digits) of non-negative fields, block by block and in a
    block field by field, little-endian in the width of the block's largest value."""
    wide = [widths(v, first) for v in fields]
    at = np.concatenate([[0], np.cumsum(size * sum(wide))])
    out = np.zeros(int(at[-1]), np.uint8)
    inside = np.arange(len(fields[0])) - np.repeat(first, size)
    begin = at[:-1]
    for v, w in zip(fields, wide):
        each = np.repeat(w, size)
        place = np.repeat(begin, size) + inside * each
        for k in range(int(w.max())):
            some = each > k
            out[place[some] + k] = (v[some] >> 8 * k) & 255
        begin = begin + size * w
    return out, at, wide[0] | wide[1] << 4 | wide[2] << 8


def peaks_of(tf: np.ndarray, n: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, length) pairs, flat, that no other pair of their block has at least the count and at most the length of;
    and the number of pairs of each block."""
    order = np.lexsort((n, -tf, block))
    far = int(n.max()) + 1  # later blocks start below all earlier ones, so one running minimum serves all
    least = np.minimum.accumulate(n[order] - block[order] * far)
    new = order[np.concatenate([[True], least[1:] < least[:-1]])]
    return np.stack([tf[new], n[new]], 1).ravel(), np.bincount(block[new], minlength=int(block[-1]) + 1)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def segment_rows(segment: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Index rows of the documents of one segment; documents are numbered by id (null last), then as they came."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    names: dict[bytes, int] = {}
    term, doc, tf, n = array("i"), array("i"), array("q"), np.zeros(len(ids), np.int64)
    for k, i in enumerate(order):
        counts = term_counts(texts[i])
        n[k] = counts.total()
        term.extend([names.setdefault(t, len(names)) for t in counts])
        tf.extend(counts.values())
        doc.extend([k] * len(counts))
    head = [[segment], [None], [0], [None], *[[None]] * 6, [[ids[i] for i in order]], [int((n > 0).sum())], [int(n.sum())]]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    labels = [f.split()[0] for f in INDEX.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(head, kinds)], names=labels)
    if not names:
        return
    term, doc, tf = np.frombuffer(term, np.int32), np.frombuffer(doc, np.int32), np.frombuffer(tf, np.int64)
    by = np.argsort(term, kind="stable")
    doc, tf = doc[by].astype(np.int64), tf[by]
    df = np.bincount(term)
    begin = np.cumsum(df) - df
    blocks = -(-df // BLOCK)
    inside = np.arange(len(doc)) - np.repeat(begin, df)
    block = np.repeat(np.cumsum(blocks) - blocks, df) + inside // BLOCK
    first = np.flatnonzero(inside % BLOCK == 0)
    size = np.diff(first, append=len(doc))
    gap = np.diff(doc, prepend=0)
    gap[begin] = doc[begin]
    long_ = n[doc]
    data, at, wide = packed([gap, tf, long_], first, size)
    peaks, pairs = peaks_of(tf, long_, block)
    head_block = np.cumsum(blocks) - blocks
    starts = at[:-1] - np.repeat(at[head_block], blocks)
    edges = at[np.concatenate([head_block, [len(first)]])]
    binary = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    small = pa.int32()
    columns = [pa.array(np.full(len(df), segment)), pa.array(list(names), pa.binary()), pa.array(df, small), binary, ragged(starts, blocks, small),
               ragged(doc[first + size - 1], blocks, small), ragged(size, blocks, small), ragged(wide, blocks, small),
               ragged(peaks, 2 * np.add.reduceat(pairs, head_block), pa.int64()), ragged(pairs, blocks, small),
               pa.nulls(len(df), pa.list_(pa.int64())), pa.nulls(len(df), pa.int64()), pa.nulls(len(df), pa.int64())]
    whole = pa.RecordBatch.from_arrays(columns, names=labels)
    for i in range(0, len(df), 1 << 14):
        yield whole.slice(i, 1 << 14)


def segments(segment_bytes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, ids, texts, held = (TaskContext.get().partitionId() << 32), [], [], 0
        for b in it:
            data, at = flat(b.column(1))
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                text = data[at[i]:at[i + 1]].tobytes()
                if held and held + len(text) > segment_bytes:
                    yield from segment_rows(segment, ids, texts)
                    segment, ids, texts, held = segment + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 64
        if ids:
            yield from segment_rows(segment, ids, texts)
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of all rows. One row per segment and term, and one per segment (term null) with its ids, its
    number of documents with a term, and of terms. Null texts have no terms; other columns are ignored."""
    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(segments(segment_bytes), INDEX), "index")


def unpack(row: dict, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, counts and lengths of a block of a list."""
    size, wide, at = row["size"][block], row["wide"][block], row["starts"][block]
    out = []
    for shift in (0, 4, 8):
        w = wide >> shift & 15
        out.append(np.frombuffer(row["data"], f"<u{w}", size, at).astype(np.int64))
        at += w * size
    return np.cumsum(out[0]) + (row["last"][block - 1] if block else 0), out[1], out[2]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Score of a term of weight 1, in integers; lengths beyond 64 bits go through Python's integers."""
    if int(n.max(initial=0)) * SHARE * docs < 1 << 62:
        m = 100 - SHARE + (SHARE * n * docs) // terms
    else:
        m = np.array([100 - SHARE + SHARE * int(v) * docs // terms for v in n], np.int64)
    return (UNIT * tf) // (1000 * tf + SLOPE * m)


class Postings:
    """A term's list in a segment: block bounds at hand, blocks unpacked on demand and kept while the segment lasts."""

    def __init__(self, row: dict, docs: int, terms: int):
        self.row, self.docs, self.terms, self.open = row, docs, terms, {}
        peaks, pairs = np.array(row["peaks"], np.int64).reshape(-1, 2), np.array(row["pairs"])
        self.peak = np.maximum.reduceat(impacts(peaks[:, 0], peaks[:, 1], docs, terms), np.cumsum(pairs) - pairs)
        self.last = np.array(row["last"])

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            doc, tf, n = unpack(self.row, k)
            self.open[k] = doc, impacts(tf, n, self.docs, self.terms)
        return self.open[k]

    def span(self, low: int, high: int) -> tuple[int, int]:
        """Blocks that may hold documents low to high - 1."""
        a = int(np.searchsorted(self.last, low))
        return a, min(int(np.searchsorted(self.last, high)) + 1, len(self.last))


def best_of(lists: list[tuple[Postings, int]], docs: int, top: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, scores) of the `top` best of a segment for an item given as (postings, weight)."""
    best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, docs, window):
        high = min(low + window, docs)
        least = int(best[-1]) if len(best) == top else 0
        mine = []
        for p, weight in lists:
            a, b = p.span(low, high)
            if a < b:
                mine.append((weight * int(p.peak[a:b].max()), weight, p, a, b))
        mine.sort(key=lambda x: x[0])
        reach = np.cumsum([x[0] for x in mine])  # what the first lists can give together
        if not len(reach) or reach[-1] <= least:
            continue
        first = int(np.searchsorted(reach, least, side="right"))  # lists before it are not essential
        total, hit = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for _, weight, p, a, b in mine[first:]:
            for k in range(a, b):
                doc, score = p.block(k)
                inside = (doc >= low) & (doc < high)
                total[doc[inside] - low] += weight * score[inside]
                hit[doc[inside] - low] = True
        found = np.flatnonzero(hit)
        for i in range(first - 1, -1, -1):
            _, weight, p, a, b = mine[i]
            found = found[total[found] + reach[i] > least]
            if not len(found):
                break
            block = np.searchsorted(p.last, found + low)
            may = block < b
            block = np.minimum(block, len(p.last) - 1)
            bound = np.where(may, weight * p.peak[block], 0) + (reach[i - 1] if i else 0)
            stays = total[found] + bound > least
            found, block, may = found[stays], block[stays], may[stays]
            for k in np.unique(block[may]).tolist():
                doc, score = p.block(k)
                ask = found[may & (block == k)]
                at = np.minimum(np.searchsorted(doc, ask + low), len(doc) - 1)
                there = doc[at] == ask + low
                total[ask[there]] += weight * score[at[there]]
        found = found[total[found] > least]
        all_doc, all_ = np.concatenate([best_doc, found + low]), np.concatenate([best, total[found]])
        order = np.lexsort((all_doc, -all_))[:top]
        best_doc, best = all_doc[order], all_[order]
    return best_doc, best


def heaps(docs: int, terms: int, top: int):
    """The best documents of one segment for the items of one group: (item, segment, place, score)."""
    def run(group: pa.Table) -> pa.Table:
        items: dict[int, list[tuple[Postings, int]]] = {}
        size = 0
        for b in group.to_batches():
            for row in b.to_pylist():
                p = Postings(row, docs, terms)
                size = max(size, int(p.last[-1]) + 1)
                for user in row["users"]:
                    items.setdefault(user["item"], []).append((p, row["weight"] * user["times"]))
        out: list[list] = [[], [], []]
        for item, lists in items.items():
            doc, score = best_of(lists, size, top)
            out[0] += [item] * len(doc)
            out[1] += doc.tolist()
            out[2] += score.tolist()
        segment = group.column("segment")[0].as_py()
        return pa.table([pa.array(out[0], pa.int64()), pa.array([segment] * len(out[0]), pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=["item", "segment", "place", "score"])
    return run


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, item_text, rank, id, score): for every item the `top` documents of highest positive score.

    Equal scores come by ascending id (null last), then segment and place. Items with equal id and text are one; items
    of one id and different texts are ranked apart. Items without terms, null items and an empty index give no rows. A
    repeated document is ranked as often as it stands. Other columns are ignored.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(text_col, F.lit("")).alias("item_text")).distinct()
    key = F.xxhash64("item_id", "item_text")
    asked = written(asked.withColumn("item", key), "items")
    whole = index.filter("term IS NULL").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    docs, terms = whole["docs"] or 0, whole["terms"] or 0
    # groups of about ITEMS items, by hash
    groups = max(1, -(-asked.count() // ITEMS))
    words = asked.select("item", F.pmod("item", F.lit(groups)).alias("part"), F.explode(terms_of(F.col("item_text"))).alias("t")).groupBy("item", "part", F.col("t").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    users = words.groupBy("part", "term").agg(F.collect_list(F.struct("item", "times")).alias("users"))
    lists = index.filter("term IS NOT NULL").drop("ids", "docs", "terms").join(users.select("term").distinct(), "term", "left_semi")
    lists = written(lists, "lists")
    weight = F.floor(1000 * F.log((2 * F.lit(docs).cast("double") + 2) / (2 * F.col("total").cast("double") + 1))).cast("long").alias("weight")
    weights = lists.groupBy("term").agg(F.sum("df").alias("total")).select("term", weight)
    asked_lists = lists.join(users.join(weights, "term"), "term").select("segment", "part", "data", *LISTS, "weight", "users")
    found = asked_lists.groupBy("segment", "part").applyInArrow(heaps(docs, max(terms, 1), top), "item long, segment long, place int, score long")
    names = index.filter("term IS NULL").select("segment", "ids")
    named = written(found, "heaps").join(names, "segment").select("item", "segment", "place", "score", F.get("ids", F.col("place")).alias("id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "segment", "place")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(asked, "item").select("item_id", "item_text", "rank", "id", "score")


def op12_ranked_lexical_search(spark, sf_dir):
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'TERM')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'TERM')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN l ON l.doc_id = p.doc_id, c GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""".replace("UPPER", UPPER).replace("LOWER", LOWER).replace("TERM", TERM)
