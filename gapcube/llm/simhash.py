"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints are computed in numpy over whole texts. Equal fingerprints collapse first, so copies are one row. Bits
that move together on a sample are grouped into the same partition (correlated bits share a part, so parts differ from
each other as much as they can). If two fingerprints differ in at most D bits, then for thresholds t_i with
sum(t_i + 1) = D + 1 some part i differs in at most t_i bits; dynamic programming picks the t_i that cost least by the
sampled candidate counts. Each part is probed with all values within t_i bits, and pairs are verified inside the join,
so only true links leave it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import batches, flat, table, text_or_empty
from gapcube.llm.components import connected
from gapcube.session import written

DISTANCE, WORDS, SEED = 3, 3, 42
#: Fingerprints that the bit groups and thresholds are estimated on (a bound; results don't depend on the draw).
SAMPLE = 4096
PARTS = (2, 3)  # parts of 21 bits at least: with 16 bits, pairs grow with the square early
#: Cost of a candidate pair relative to that of a key sent.
PAIR_COST = 4.0

U = np.uint64
#: The multipliers of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the substrings data[start:start + size], lane by lane over all of them."""
    with np.errstate(over="ignore"):
        raw = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
        four = np.ndarray((len(data) + 5,), "<u4", raw, strides=(1,))
        s, at, left = U(seed), start.copy(), size.copy()
        h = np.full(len(start), s + P5)
        long_ = np.flatnonzero(size >= 32)
        if len(long_):
            acc = [np.full(len(long_), v) for v in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(long_))
            while len(live):
                rows = long_[live]
                for k in range(4):
                    acc[k][live] = rotate(acc[k][live] + eight[at[rows] + 8 * k] * P2, 31) * P1
                at[rows] += 32
                left[rows] -= 32
                live = live[left[rows] >= 32]
            x = rotate(acc[0], 1) + rotate(acc[1], 7) + rotate(acc[2], 12) + rotate(acc[3], 18)
            for k in range(4):
                x = (x ^ (rotate(acc[k] * P2, 31) * P1)) * P1 + P4
            h[long_] = x
        h += size.astype(U)
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = rotate(h[live] ^ (rotate(eight[at[live]] * P2, 31) * P1), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        h[live] = rotate(h[live] ^ (four[at[live]].astype(U) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            h[live] = rotate(h[live] ^ (raw[at[live]].astype(U) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


#: A-Z to lower case, the white space 9-13 to the space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def shingle_hashes(data: np.ndarray, at: np.ndarray, words: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows of a flat string column, and the n + 1 offsets of the rows. A row with fewer
    words is one shingle, a row without words has none."""
    n = len(at) - 1
    x = FOLD[data]
    blank = x == 32
    edge = np.zeros(len(x) + 1, bool)
    edge[at] = True
    word_begins = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])) if len(x) else np.zeros(0, np.int64)
    word_ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1 if len(x) else np.zeros(0, np.int64)
    sizes = word_ends - word_begins
    # words of all rows again, each followed by one space
    to = np.concatenate([[0], np.cumsum(sizes + 1)])
    packed = np.full(int(to[-1]), 32, np.uint8)
    src = np.repeat(word_begins - to[:-1], sizes + 1) + np.arange(len(packed))
    inner = np.ones(len(packed), bool)
    inner[to[1:] - 1] = False
    packed[inner] = x[src[inner]]
    first = np.searchsorted(word_begins, at)  # word number where each row starts
    count = first[1:] - first[:-1]
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    base = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(n), shingles)
    begin = first[row] + np.arange(len(row)) - base[row]
    end = begin + np.minimum(words, count[row])
    return xxh64(packed, to[begin], to[end] - 1 - to[begin], seed), base


def fingerprints(data: np.ndarray, at: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of the rows of a flat string column."""
    h, base = shingle_hashes(data, at, words, seed)
    shingles = base[1:] - base[:-1]
    out = np.zeros(len(at) - 1, U)
    some = np.flatnonzero(shingles)
    for i in range(0, len(some), 512):  # bit sums of a few rows at a time: 64 bytes a shingle
        rows = some[i:i + 512]
        a, b = base[rows[0]], base[rows[-1] + 1]
        bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, base[rows] - a, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > shingles[rows][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def marks(words: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1 << 18):
            data, at = flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(data, at, words, seed).view(np.int64)), b.column(2)], names=["id", "fp", "check"])
    return run


def group_bits(fps: np.ndarray, parts: int) -> list[list[int]]:
    """Equal parts of the 64 bits; each takes a seed bit and then those that correlate most with its members."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(0)
    norm = np.sqrt((centred ** 2).sum(0)) + 1e-9
    alike = np.abs(centred.T @ centred / norm[:, None] / norm[None, :])
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        seed = max(sorted(left), key=lambda b: alike[b, sorted(left)].sum())
        mine = [seed]
        left.remove(seed)
        while len(mine) < size:
            best = max(sorted(left), key=lambda b: alike[b, mine].sum())
            mine.append(best)
            left.remove(best)
        out.append(sorted(mine))
    return out


def part_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), U)
    for k, b in enumerate(bits):
        out |= ((fps >> U(b)) & U(1)) << U(k)
    return out


def thresholds(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Least total cost of thresholds t_i >= -1 with sum(t_i + 1) = distance + 1, by dynamic programming over parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t in range(-1, min(distance - spent, len(part) - 2) + 1):
                new = (c + part[t + 1], [*chosen, t])
                if spent + t + 1 not in step or new[0] < step[spent + t + 1][0]:
                    step[spent + t + 1] = new
        best = step
    return best[distance + 1]


def plan(fps: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Parts (bits, threshold) that are expected to cost least over `total` distinct fingerprints."""
    best: tuple[float, list] | None = None
    pairs = max(len(fps) * (len(fps) - 1) / 2, 1)
    for m in PARTS:
        groups = group_bits(fps, m)
        cost = []
        for bits in groups:
            value = part_value(fps, bits)
            seen = np.zeros(3)
            for i in range(0, len(value), 256):
                d = np.bitwise_count(value[i:i + 256, None] ^ value[None, :])
                upper = np.arange(len(value))[None, :] > np.arange(i, min(i + 256, len(value)))[:, None]
                seen += [int(((d <= t) & upper).sum()) for t in range(3)]
            near = [np.sum([comb(len(bits), k) for k in range(t + 1)]) / 2.0 ** len(bits) for t in range(3)]
            scale = total * (total - 1) / 2
            cost.append([0.0] + [total * (1 + sum(comb(len(bits), k) for k in range(t + 1))) + PAIR_COST * scale * max(seen[t] / pairs, near[t]) for t in range(3)])
        c, ts = thresholds(cost, distance)
        if best is None or c < best[0]:
            best = c, [(g, t) for g, t in zip(groups, ts) if t >= 0]
    return best[1]


def comb(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def keys_of(parts: list[tuple[list[int], int]], probe: bool):
    """(part, key, fp, node): a fingerprint's value in each part; as a probe all values within the threshold."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps, node = b.column(0).to_numpy().view(U), b.column(1)
            for i, (bits, t) in enumerate(parts):
                value = part_value(fps, bits)
                for k in range(t + 1 if probe else 1):
                    for flip in itertools.combinations(range(len(bits)), k):
                        mask = U(sum(1 << f for f in flip))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array((value ^ mask).view(np.int64)), b.column(0), node], names=["part", "key", "fp", "node"])
    return run


def links_of(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) of rows (fp, node) whose fingerprints differ in at most `distance` bits."""
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    share = min(1.0, SAMPLE / total)
    drawn = distinct.filter(F.pmod(F.xxhash64("fp", F.lit("plan")), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("fp").collect()
    parts = plan(np.sort(np.array([r[0] for r in drawn], np.int64)).view(U), total, distance)
    rows = distinct.select("fp", "node")
    schema = "part int, key long, fp long, node long"
    x = rows.mapInArrow(keys_of(parts, True), schema).alias("x")
    y = rows.mapInArrow(keys_of(parts, False), schema).alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    return x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & close) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, fp (the fingerprint as a long), component_id, text_check, first.

    Words and shingles as in the module text; null and empty texts have fingerprint 0 and are linked like any other. A
    null id belongs to its component but never names it (unless all ids are null). `first` marks the rows with the
    component's smallest (id, text_check). Repeated rows give repeated rows; other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("check"))
    rows = written(rows.mapInArrow(marks(words, seed), "id long, fp long, check long"), "fingerprints")
    # a fingerprint stands for its rows; the fingerprint itself is the node of the graph
    distinct = written(rows.groupBy("fp").agg(*smallest()), "distinct")
    return verdict(rows, distinct, connected(links_of(distinct.select("fp", F.col("fp").alias("node")), distance)), "fp")


def smallest() -> list[Column]:
    """Of the rows (id, check) of a node: the smallest id, and the row that is kept."""
    return [F.min("id").alias("low"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "check")).alias("first")]


def verdict(rows: DataFrame, distinct: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Every row (id, check, `by`) with its component: id, `by`, component_id, text_check, first."""
    of = distinct.join(found.withColumnRenamed("node", by), by, "left").withColumn("component", F.coalesce("component", by))
    named = of.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    known = written(of.select(by, "component").join(named, "component").select(by, "component_id", "first"), "named")
    # rows of one node may be a third of all: spread them and repeat the verdict
    salt = 16
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id", "check"), F.lit(salt)).cast("int"))
    right = known.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(salt)])))
    first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.check") == F.col("check"))
    return left.join(right, [by, "salt"]).select("id", by, "component_id", F.col("check").alias("text_check"), first.alias("first"))


def op2_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
