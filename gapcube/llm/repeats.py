"""Removal of every byte inside a string of `WINDOW` bytes that also starts elsewhere, by suffix arrays of shards.

1. Anchors: of every window the rightmost smallest hash of its `GRAM`-byte strings is selected. Equal windows select
   the same anchor at the same place, so two occurrences always meet under one anchor. An anchor's context (`REACH`
   bytes to its left, `WINDOW` from it on) holds every window that selects it. Only hashes and places are sent.
2. Anchors that occur once are dropped; equal contexts collapse before the exchange, so a group of copies with a third
   of all rows is one row per context. A context that occurs twice is repeated as a whole.
3. The bytes of contexts that differ under one anchor go to shards of bounded size. A shard's suffix array (induced
   sorting) and its common prefixes give the windows that stand at two different places. An anchor with more than
   a shard of different contexts is split: its windows are grouped by digest instead, which is exact too.
4. Places get their spans back by (anchor, context), documents by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcube.llm.common import batches, flat, table, text_or_empty
from gapcube.llm.suffix import common_prefixes, suffix_array
from gapcube.session import settled, written

WINDOW, GRAM = 200, 64
#: Bytes of the contexts of one anchor that are sorted at once; smaller anchors share shards of half as many.
SHARD_BYTES = 2 << 20

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, U(b))
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[base] = tuple(made)
    return _powers[base]


class Hashes:
    """Hashes of all substrings of a byte array by prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[:len(self.sums)][a])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(29))


def anchors(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context hash, row and place of the anchors of all rows of a flat string column."""
    w = window - gram + 1
    none = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(data) - gram + 1
    if m < w:
        return none
    one = Hashes(data, BASES[0])
    h = one.of(slice(0, m), slice(gram, gram + m))
    blocks = np.concatenate([h, np.full(-m % w, U(2 ** 64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - w + 1
    least = np.minimum(behind[:n], ahead[w - 1:w - 1 + n])
    enters = h[w - 1:w - 1 + n] == least
    new = enters.copy()
    new[1:] |= least[1:] != least[:-1]
    begins = at[:-1][(at[1:] - at[:-1]) >= window]
    new[begins] = True
    s = np.flatnonzero(new)
    row = np.searchsorted(at, s, side="right") - 1
    inside = s + window <= at[row + 1]
    s, row = s[inside], row[inside]
    p = s + w - 1
    for i in range(0, len(s), 4096):  # where the smallest one is not the last: look back through the window
        part = slice(i, i + 4096)
        old = np.flatnonzero(~enters[s[part]]) + i
        if len(old):
            near = h[p[old][:, None] - np.arange(w)[None, :]] == least[s[old]][:, None]
            p[old] -= near.argmax(1)
    keep = np.ones(len(p), bool)
    keep[1:] = p[1:] != p[:-1]
    p, row = p[keep], row[keep]
    a, b = np.maximum(p - (window - gram), at[row]), np.minimum(p + window, at[row + 1])
    two = Hashes(data, BASES[1])
    context = mixed(two.of(a, b) + (p - a).astype(U) * U(BASES[0]) + (b - p).astype(U))
    return h[p], context, row, p - at[row]


def occurrences(window: int, gram: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1 << 18, text=2):
            data, at = flat(b.column(2))
            fp, ctx, row, place = anchors(data, at, window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), b.column(0).take(pa.array(row)),
                                              b.column(1).take(pa.array(row)), pa.array(place.astype(np.int32))], names=["fp", "ctx", "doc", "twin", "place"])
    return run


def context_bytes(window: int, gram: int):
    """Cut the asked contexts out of their documents."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, text=2):
            asked = b.column(3)
            rows = np.repeat(np.arange(b.num_rows), np.asarray(asked.value_lengths().fill_null(0)))
            want = asked.flatten()
            place = want.field("place").to_numpy().astype(np.int64)
            data, at = flat(b.column(2))
            p = at[rows] + place
            lo, hi = np.maximum(p - (window - gram), at[rows]), np.minimum(p + window, at[rows + 1])
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([want.field("fp"), want.field("ctx"), want.field("n"), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)),
                                              want.field("place"), pa.array((p - lo).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())],
                                             names=["fp", "ctx", "n", "doc", "twin", "place", "left", "bytes"])
    return run


SPANS = "fp long, ctx long, spans array<struct<a:int,b:int>>"


def merged(start: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows that begin at `start`, by group (both sorted): group, begin, end."""
    if not len(start):
        return group, start, start
    new = np.ones(len(start), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > start[:-1] + window)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(start) - 1)
    return group[first], start[first], start[last] + window


def spans_table(fp: np.ndarray, ctx: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row per context in `group` with its spans."""
    who, first = np.unique(group, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(group)).astype(np.int32)),
                                     pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"]))
    return pa.RecordBatch.from_arrays([pa.array(fp[who]), pa.array(ctx[who]), lists], names=["fp", "ctx", "spans"])


def shards_of(t: pa.Table, limit: int, last: bool) -> Iterator[tuple[int, int]]:
    """Row ranges of contexts sorted by anchor that end where an anchor ends: as many anchors as fit `limit` bytes, or one.
    Unless they are the `last` rows, the final range is left, as its anchor may go on."""
    fp = t["fp"].to_numpy()
    ends = np.append(np.flatnonzero(fp[1:] != fp[:-1]) + 1, [len(fp)] * last).astype(int).tolist()
    lengths = np.cumsum(np.concatenate([[0], np.asarray(pc.binary_length(t["bytes"]))]))
    i = j = 0
    for e in ends:
        if j > i and lengths[e] - lengths[i] > limit:
            yield i, j
            i = j
        j = e
    if last and j > i:
        yield i, j


def shard_spans(window: int, gram: int, shard_bytes: int):
    """Repeated windows of the contexts of a partition, by the suffix array of each shard."""
    def one(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        data, at = flat(t["bytes"].combine_chunks() if t["bytes"].num_chunks != 1 else t["bytes"].chunk(0))
        size = at[1:] - at[:-1]
        starts = at[:-1] + np.arange(len(size))  # every context is followed by a separator, which no UTF-8 text has
        text = np.full(len(data) + len(size), 255, np.uint8)
        inner = np.ones(len(text), bool)
        inner[starts + size] = False
        text[inner] = data
        symbols = np.zeros(len(text) + 1, np.uint16)
        symbols[:-1] = text
        symbols[:-1] += 1
        sa = suffix_array(symbols, 257)[1:]
        del symbols, inner
        fresh = np.zeros(len(text), bool)
        fresh[starts] = True
        group = np.cumsum(common_prefixes(text, sa, 2 * window - gram, fresh)[sa] < window, dtype=sa.dtype)
        size = size.astype(sa.dtype)
        which = np.repeat(np.arange(len(size), dtype=sa.dtype), size + 1)
        offset = np.arange(len(text), dtype=sa.dtype) - starts.astype(sa.dtype)[which]
        ok = (offset + window <= size[which])[sa]
        x, group = sa[ok], group[ok]
        del text, fresh, sa, ok
        if not len(x):
            return None
        c = which[x]
        doc = np.unique(np.rec.fromarrays([t["doc"].to_numpy(), t["twin"].to_numpy()]), return_inverse=True)[1].astype(x.dtype)[c]
        here = (t["place"].to_numpy() - t["left"].to_numpy())[c] + offset[x]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        moves = np.append(False, (doc[1:] != doc[:-1]) | (here[1:] != here[:-1]))  # stands elsewhere than the one before it
        moves[cut] = False
        copied = (t["n"].to_numpy() > 1)[c]
        twice = np.logical_or.reduceat(moves | copied, cut)
        hit = np.repeat(twice, np.diff(np.append(cut, len(x)))) & ~copied
        del c, doc, here, group
        y = np.sort(x[hit])
        who, a, b = merged(offset[y], which[y], window)
        left = t["left"].to_numpy()
        return spans_table(t["fp"].to_numpy(), t["ctx"].to_numpy(), who, a - left[who], b - left[who]) if len(y) else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for b in it:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([b])])
            done = 0
            for i, j in shards_of(t, shard_bytes // 2, False):
                out = one(t.slice(i, j - i))
                if out is not None:
                    yield out
                done = j
            pending = t.slice(done)
        if pending is not None:
            for i, j in shards_of(pending, shard_bytes // 2, True):
                out = one(pending.slice(i, j - i))
                if out is not None:
                    yield out
    return run


def windows_of(window: int):
    """Digest of every window of a context, for anchors with too many contexts for a shard."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1 << 18, text=6):
            data, at = flat(b.column(6))
            left = b.column(5).to_numpy()
            count = np.maximum(at[1:] - at[:-1] - window + 1, 0)
            row = np.repeat(np.arange(b.num_rows), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = at[row] + offset
            pick = pa.array(row)
            one, two = (Hashes(data, base).of(begin, begin + window).view(np.int64) for base in BASES)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), b.column(2).take(pick), pa.array((offset - left[row]).astype(np.int32)), pa.array(one), pa.array(two)],
                                             names=["fp", "ctx", "n", "offset", "one", "two"])
    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the row key (doc, twin): the id, and a hash that tells rows with the same id apart. Equal rows share it."""
    text = text_or_empty(text_col)
    return docs.withColumns({"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_twin": F.hash(text, F.col(id_col).isNull()), "_text": text})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(_doc, _twin, spans) of the rows that have repeated strings; spans are byte places, unordered, and may overlap."""
    hot = shard_bytes // (2 * window - gram)  # contexts that fill a shard
    rows = keyed(docs, id_col, text_col).select("_doc", "_twin", "_text")
    occ = written(rows.filter(F.octet_length("_text") >= window).mapInArrow(occurrences(window, gram), "fp long, ctx long, doc long, twin int, place int"), "anchors")
    twice = written(occ.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "twice")  # stored, so that a skewed join can be split
    cand = written(occ.join(twice, "fp", "left_semi"), "repeated")
    ctx = written(cand.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "twin", "place")).alias("at")), "contexts")
    many = ctx.groupBy("fp").agg(F.count(F.lit(1)).alias("contexts"))
    whole = ctx.filter("n > 1").select("fp", "ctx", F.array(F.struct(F.lit(gram - window).alias("a"), F.lit(window).alias("b"))).alias("spans"))
    # contexts that differ: fetch their bytes, one trip per document
    differ = ctx.join(many.filter("contexts > 1"), "fp").select("fp", "ctx", "n", "contexts", F.col("at.doc").alias("_doc"), F.col("at.twin").alias("_twin"), F.col("at.place").alias("place"))
    asked = differ.groupBy("_doc", "_twin").agg(F.collect_list(F.struct("fp", "ctx", "n", "place")).alias("asked"))

    cut = rows.join(asked, ["_doc", "_twin"]).mapInArrow(context_bytes(window, gram), "fp long, ctx long, n long, doc long, twin int, place int, left int, bytes binary")
    cut = written(cut, "bytes")
    total, most = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0, many.agg(F.max("contexts")).first()[0] or 0
    hot_fp = many.filter(F.col("contexts") > hot).select("fp")
    cool = cut.join(hot_fp, "fp", "left_anti") if most > hot else cut
    shards = max(1, -(-total // shard_bytes))
    marks = whole.unionByName(cool.repartition(shards, "fp").sortWithinPartitions("fp").mapInArrow(shard_spans(window, gram, shard_bytes), SPANS))
    if most > hot:
        w = written(cut.join(hot_fp, "fp", "left_semi").select("fp", "ctx", "n", "doc", "place", "left", "bytes").mapInArrow(windows_of(window), "fp long, ctx long, n long, offset int, one long, two long"), "windows")
        key = ["fp", "offset", "one", "two"]
        again = w.groupBy(*key).agg(F.sum("n").alias("times")).filter("times > 1").select(*key)
        marks = marks.unionByName(w.filter("n = 1").join(again, key, "left_semi").groupBy("fp", "ctx").agg(
            F.collect_list(F.struct(F.col("offset").alias("a"), (F.col("offset") + window).alias("b"))).alias("spans")))
    marks = written(marks, "marks")
    hits = cand.join(marks, ["fp", "ctx"]).select(F.col("doc").alias("_doc"), F.col("twin").alias("_twin"), F.expr("transform(spans, s -> struct(place + s.a AS a, place + s.b AS b))").alias("s"))
    return hits.groupBy("_doc", "_twin").agg(F.flatten(F.collect_list("s")).alias("spans"))


def runs_of(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs covered by (a, b) pairs, clipped to 0 .. n."""
    if not len(spans):
        return []
    a, b = np.clip(spans[:, 0], 0, n), np.clip(spans[:, 1], 0, n)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    first = np.flatnonzero(new)
    return list(zip(a[first].tolist(), b[np.append(first[1:] - 1, len(a) - 1)].tolist()))


def cut_out(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    if spans is None or not len(spans):
        return raw, []
    runs = runs_of(np.array([(s["a"], s["b"]) for s in spans], np.int64), len(raw))
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]), runs


def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = (text or "").encode()
            kept, runs = cut_out(raw, spans)
            out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        n, removed, count, sha = zip(*out)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the column `_spans` (null where nothing repeats).

    Matches never cross rows; null texts are empty. Rows with the same id and text count as two places of one text, and
    both lose what repeats. Texts below the window are never touched.
    """
    spans = settled(lambda: repeated_spans(docs, id_col, text_col, **how), "spans").withColumnRenamed("spans", "_spans")
    return keyed(docs, id_col, text_col).join(spans, ["_doc", "_twin"], "left")


@F.pandas_udf(T.StringType())
def remaining(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Text without the spans; bytes of characters that were cut in two go as well."""
    return pd.Series([cut_out((t or "").encode(), s)[0].decode("utf-8", "ignore") if s is not None else t for t, s in zip(text, spans)], dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, with repeated strings removed from the text."""
    names = docs.columns
    out = with_spans(docs, id_col, text_col, **how).withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(remaining("_text", "_spans")))
    return out.select(*names)


def op7_suffix_array_dedup(spark, sf_dir):
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "_text", "_spans").mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
