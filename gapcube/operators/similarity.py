"""Near duplicates by cosine of character 3-5-gram TF-IDF vectors, exact above a threshold.

Equal texts are collapsed first, so a group of copies is one vector. Grams are ordered rare first in levels of document
frequency; a text's prefix ends at the first level from which the norm of the rest is below the threshold. Two texts
share all their common grams below the lower of both cuts, so the dot product of the prefixes plus the product of the
norms that are left there is an upper bound of the cosine. Only pairs whose bound reaches the threshold are compared on
whole vectors: nothing is approximated or capped. Texts are normalised keys (ASCII), so a gram is an exact number of at
most five bytes.

Two bounds that cost little per pair come first. Grams are put into groups by the clusters of a sample in which they weigh
most (a language, say): a cosine is at most the product of the texts' norms per group, summed. And it is at most the norm
of the k heaviest grams of one text, if the other has k grams. Blocks hold texts of one cluster and about one size, so most
texts of a task have nothing to look for in a block. The bounds hold for any groups; the sample only makes them tight.

Vectors are stored once as ranks and counts of grams. The texts searched in are stored in blocks in the shared folder;
every task keeps a bounded number of the texts to search for and reads one block after the other, compares and passes on
only the best pairs. So time grows with the number of pairs, but neither disk, exchanges nor memory do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, hash32
from gapcube.operators.filters import text_digest
from gapcube.session import written
from gapcube.sources.io import file_system

# fixed values: limits of the reported strata and bands
STRATA = ((0.0, 0.5), (0.5, 0.8), (0.8, 1.01))
BANDS = ((0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 0.999), (0.999, 1.01))
EPS = 1e-9
TIE = 2e-9  # sims this close to the best are passed on, as results are rounded to nine decimals
LEFT_ROWS, LEFT_GRAMS = 2048, 1 << 21  # texts and grams that a task holds to search for
BLOCK_ROWS, BLOCK_GRAMS = 1024, 1 << 21  # texts and grams of a block (bound memory, drop nothing)
SLICE = 1 << 19  # products formed at a time inside a block
LEVELS, STEP = 96, 1.25  # levels of document frequency and their ratio
#: A block's row is a page of its own and row groups are checked after each row; by default, Parquet looks at sizes only
#: every hundred rows, and then a hundred blocks are held at once by whoever writes or reads.
ONE_BY_ONE = {"parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
              "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}
#: Groups of grams, texts of the sample that they are drawn from, and its turns (results don't depend on them).
GROUPS, DRAWN, TURNS = 16, 512, 4
#: Numbers of heaviest grams whose norm is kept for each text.
HEAVIEST = np.unique(np.ceil(2.0 ** (np.arange(33) / 2)).astype(np.int64))
#: Added to bounds that are summed in single precision: above its error for tens of thousands of terms.
SLACK = 1e-3
LAYOUT = {"rep": "i8", "at": "i8", "g": "i4", "tf": "i4", "norm": "f8", "tail": "f8", "cut": "i8", "order": "i4", "profile": "f4", "heavy": "f4"}


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character 3- to 5-grams inside words padded with one space on each side, as numbers, with their counts."""
    b = np.frombuffer((" " + text + " ").encode("ascii"), dtype=np.uint8).astype(np.int64)
    space = b == 32
    found = []
    for n in (3, 4, 5):
        size = len(b) - n + 1
        if size <= 0 or not text:
            continue
        code, inner = np.zeros(size, np.int64), np.zeros(size, bool)
        for k in range(n):
            code = (code << 8) | b[k:k + size]
            if 0 < k < n - 1:
                inner |= space[k:k + size]
        found.append(code[~inner])
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, df) of rows (copies, text_norm), summed over about a million grams at a time."""
    held, weight, size = [], [], 0

    def summed() -> pa.RecordBatch:
        gram, place = np.unique(np.concatenate(held), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.bincount(place, np.concatenate(weight)).astype(np.int64))], names=["gram", "df"])
    for b in it:
        for copies, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            g, _ = count_grams(text)
            held.append(g)
            weight.append(np.full(len(g), copies, float))
            size += len(g)
            if size > 1 << 20:
                yield summed()
                held, weight, size = [], [], 0
    if size:
        yield summed()


def representatives(corpus: DataFrame) -> DataFrame:
    """(k, rep, copies): the smallest id of every distinct normalised text."""
    return corpus.groupBy(text_digest().alias("k")).agg(F.min("item_num").alias("rep"), F.count(F.lit(1)).alias("copies"))


def gram_weights(corpus: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, g, tf): grams of the distinct texts as ranks, rare first, and their counts; the metadata of `g` name the
    stored frequencies.

    A gram's rank is its place by document frequency over all rows (copies included). The different grams of an alphabet
    of 37 characters are a bounded table, which tasks hold as two arrays.
    """
    spark = corpus.sparkSession
    texts = corpus.select(F.col("item_num").alias("rep"), "text_norm").filter("text_norm <> ''").join(reps.select("rep", "copies"), "rep")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() // 4096))
    texts = written(texts.repartition(parts, "rep"), "texts")
    found = texts.select("copies", "text_norm").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    vocabulary = written(found.withColumn("n", corpus.agg(F.count(F.lit(1)).alias("n")).scalar()), "vocabulary")
    gram, df, _ = vocabulary_of(vocabulary)
    order = np.argsort(gram)
    shared = spark.sparkContext.broadcast((gram[order], order.astype(np.int32)))

    def ranked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ranks = shared.value
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for text in part.column(1).to_pylist():
                    g, tf = count_grams(text)
                    rank = ranks[np.searchsorted(grams, g)]
                    rare = np.argsort(rank)
                    out.append((rank[rare], tf[rare].astype(np.int32)))
                ends = pa.array(np.cumsum([0, *[len(g) for g, _ in out]]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate([o[i] for o in out]), pa.int32())) for i in (0, 1)]], names=["rep", "g", "tf"])
    made = texts.select("rep", "text_norm").mapInArrow(ranked, "rep long, g array<int>, tf array<int>")
    return written(made.withColumn("g", F.col("g").alias("g", metadata={"vocabulary": vocabulary.inputFiles()})), "weights")


def vocabulary_of(stored: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Grams and frequencies, rare first, and the number of rows of the corpus."""
    t = stored.toArrow()
    gram, df = t.column("gram").to_numpy(), t.column("df").to_numpy()
    order = np.lexsort((gram, df))
    return gram[order], df[order], t.column("n")[0].as_py() if len(gram) else 0


@dataclass(frozen=True)
class Scale:
    """Per rank: smoothed inverse document frequency, level and group; the threshold."""
    idf: np.ndarray
    level: np.ndarray
    threshold: float
    group: np.ndarray

    @classmethod
    def of(cls, weights: DataFrame, threshold: float) -> "Scale":
        files = weights.schema["g"].metadata["vocabulary"]
        stored = weights.sparkSession.read.schema("gram long, df long, n long").parquet(*files)
        _, df, n = vocabulary_of(stored)
        idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
        return cls(idf, np.minimum(np.log(df) / np.log(STEP), LEVELS - 1).astype(np.int64), threshold, groups_of(weights, idf))

    def side(self, rep: np.ndarray, at: np.ndarray, g: np.ndarray, tf: np.ndarray) -> dict[str, np.ndarray]:
        """Norms; per level, the norm of the grams from it on; the level that ends the prefix; the places of the prefix
        grams by gram."""
        n = len(rep)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        x = (1.0 + np.log(tf)) * self.idf[g]
        norm = np.sqrt(np.bincount(row, x * x, n))
        level = self.level[g]
        w = x / norm[row]
        part = np.bincount(row.astype(np.int64) * LEVELS + level, w * w, n * LEVELS).reshape(n, LEVELS)
        del x
        tail = np.sqrt(np.concatenate([np.cumsum(part[:, ::-1], 1)[:, ::-1], np.zeros((n, 1))], 1))
        cut = np.argmax(tail < self.threshold - EPS, 1)
        prefix = np.flatnonzero(level < cut[row])
        profile = np.sqrt(np.bincount(row.astype(np.int64) * GROUPS + self.group[g], w * w, n * GROUPS)).reshape(n, GROUPS).astype("f4")
        heavy = np.ones((n, len(HEAVIEST) + 1), "f4")
        ends = np.cumsum(np.concatenate([[0.0], (w * w)[np.lexsort((-w, row))]]))
        heavy[:, :-1] = np.sqrt(np.maximum(ends[np.minimum(at[:-1, None] + HEAVIEST, at[1:, None])] - ends[at[:-1, None]], 0.0))
        return {"profile": profile, "heavy": heavy, "rep": rep, "at": at, "g": g, "tf": tf, "norm": norm, "tail": tail, "cut": cut, "order": prefix[np.argsort(g[prefix], kind="stable")]}

    def weights(self, side: dict[str, np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, weights and ranks of the grams at some places."""
        row = (np.searchsorted(side["at"], places, "right") - 1).astype(np.int32)
        g = side["g"][places]
        return row, (1.0 + np.log(side["tf"][places])) * self.idf[g] / side["norm"][row], g


def groups_of(weights: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The group of each rank: of some clusters of a sample of texts, the one in which it weighs most."""
    share = min(1.0, DRAWN / max(weights.count(), 1))
    drawn = weights.filter(F.pmod(F.xxhash64("rep", F.lit("groups")), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("rep", "g", "tf").orderBy("rep").toArrow()
    rows = []
    for g, tf in zip(drawn.column("g"), drawn.column("tf")):
        g = g.values.to_numpy()
        if len(g):
            w = (1.0 + np.log(tf.values.to_numpy())) * idf[g]
            rows.append((g, (w / np.sqrt((w * w).sum())).astype("f4")))
    centre = np.zeros((len(idf), GROUPS), "f4")
    for k, (g, w) in enumerate(rows[:GROUPS]):
        centre[g, k] = w
    for _ in range(TURNS if rows else 0):
        near = [int(np.argmax(w @ centre[g])) for g, w in rows]
        centre[:] = 0
        for k, (g, w) in zip(near, rows):
            centre[g, k] += w
        centre /= np.sqrt((centre * centre).sum(0)) + 1e-9
    return np.argmax(centre, 1).astype(np.int16)


def kinds_of(scale):
    """Rows (rep, g, tf, grp) with their heaviest group and number of grams."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rep, at, g, tf = arrays_of(b)
            row = np.repeat(np.arange(len(rep), dtype=np.int64), np.diff(at))
            w = (1.0 + np.log(tf)) * scale.value.idf[g]
            kind = np.argmax(np.bincount(row * GROUPS + scale.value.group[g], w * w, len(rep) * GROUPS).reshape(-1, GROUPS), 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind.astype(np.int32)), pa.array(np.diff(at).astype(np.int32))], names=["rep", "g", "tf", "grp", "kind", "size"])
    return run


def pieces_of(it: Iterator[pa.RecordBatch], rows: int, grams: int, kind: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (rep, g, ...) in pieces of at most `rows` rows and, but for single rows, about `grams` grams. A piece of an
    eighth of the rows also ends where the column `kind` changes."""
    held, n, size, last = [], 0, 0, None
    for b in it:
        length = np.diff(b.column(1).offsets.to_numpy())
        start = 0
        kinds = b.column(kind).to_numpy() if kind is not None else np.zeros(len(length), np.int32)
        for i, k in enumerate(length):
            if n and (n >= rows or size + k > grams or (n >= rows // 8 and kinds[i] != last)):
                held.append(b.slice(start, i - start))
                yield pa.concat_batches(held)
                held, n, size, start = [], 0, 0, i
            n, size, last = n + 1, size + k, kinds[i]
        held.append(b.slice(start))
    if n:
        yield pa.concat_batches(held)


def arrays_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = b.column(1).offsets.to_numpy().astype(np.int64)
    return b.column(0).to_numpy(), at - at[0], b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()


def blocks_of(scale: Scale):
    """Blocks of rows (rep, g, tf, grp, kind), one row each: arrays as bytes and the groups."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(it, BLOCK_ROWS, BLOCK_GRAMS, 4):
            side = scale.side(*arrays_of(b))
            cells = [pa.array([side[k].astype("<" + t).tobytes()], pa.binary()) for k, t in LAYOUT.items()]
            yield pa.RecordBatch.from_arrays([*cells, pa.array([b.column(3).to_pylist()], pa.list_(pa.string()))], names=[*LAYOUT, "grp"])
    return run


def stored_blocks(files: Sequence[str]) -> Iterator[tuple[dict[str, np.ndarray], list[str]]]:
    for path in files:
        system, name = file_system(path)
        with system.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                if b.num_rows:
                    side = {k: np.frombuffer(b.column(k)[0].as_buffer(), "<" + t) for k, t in LAYOUT.items()}
                    for k, width in (("tail", LEVELS + 1), ("profile", GROUPS), ("heavy", len(HEAVIEST) + 1)):
                        side[k] = side[k].reshape(-1, width)
                    yield side, b.column("grp")[0].as_py()


def bounded_pairs(scale: Scale, left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, bound) of pairs of different texts whose upper bound reaches the threshold, by left row.

    Grams that many texts of the block share are columns of a dense product, the others are looked up one by one.
    """
    may = possible(scale.threshold, left, right)
    if not may.any():
        return
    if "prefix" not in left:
        left["prefix"] = scale.weights(left, np.sort(left["order"]))
    prefix = scale.weights(right, right["order"])
    # texts with something to look for in much of the block meet all of it, others only what they may be like
    share = may.mean(1)
    for chosen in (np.flatnonzero(share > 0.2), np.flatnonzero((share > 0) & (share <= 0.2))):
        others = np.flatnonzero(may[chosen].any(0))
        if len(others):
            yield from rectangle(scale, left, right, prefix, may, chosen, others)


def rectangle(scale: Scale, left: dict[str, np.ndarray], right: dict[str, np.ndarray], prefix: tuple[np.ndarray, np.ndarray, np.ndarray], may: np.ndarray,
              chosen: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of some rows on both sides; `prefix` holds rows, weights and ranks of the right side's prefixes, by rank."""
    n = len(others)
    place = np.full(len(right["rep"]), -1, np.int32)
    place[others] = np.arange(n)
    col = place[prefix[0]]
    some = np.flatnonzero(col >= 0)
    col, rweight, rgram = col[some], prefix[1][some], prefix[2][some]
    names, start, size = np.unique(rgram, return_index=True, return_counts=True)
    if not len(names):
        return
    dense = size >= max(n // 16, 1)
    column = np.where(dense, np.cumsum(dense) - 1, -1)
    held = np.repeat(column, size)
    matrix = np.zeros((int(dense.sum()), n), "f4")
    matrix[held[held >= 0], col[held >= 0]] = rweight[held >= 0]
    place = np.full(len(left["rep"]), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    row = place[left["prefix"][0]]
    at_of = np.full(len(scale.idf), -1, np.int32)
    at_of[names] = np.arange(len(names))
    some = np.flatnonzero((row >= 0) & (at_of[left["prefix"][2]] >= 0))
    wanted = row[some], left["prefix"][1][some], at_of[left["prefix"][2][some]]
    step = max(1, SLICE // n)
    for i in range(0, len(chosen), step):
        rows = min(step, len(chosen) - i)
        x, end = np.searchsorted(wanted[0], [i, i + step])
        row, weight, at = (part[x:end] for part in wanted)
        row = row - i
        thick = column[at] >= 0
        common = np.zeros((rows, len(matrix)), "f4")
        common[row[thick], column[at[thick]]] = weight[thick]
        dots = (common @ matrix).ravel().astype(float)
        row, weight, low, count = row[~thick].astype(np.int64) * n, weight[~thick], start[at[~thick]], size[at[~thick]]
        before = np.concatenate([[0], np.cumsum(count)])
        x, end = 0, len(row)
        while x < end:  # a slice of products at a time
            y = min(end, max(x + 1, int(np.searchsorted(before, before[x] + SLICE, "right")) - 1))
            c = count[x:y]
            found = np.repeat(low[x:y] - (before[x:y] - before[x]), c) + np.arange(before[y] - before[x])
            dots += np.bincount(np.repeat(row[x:y], c) + col[found], np.repeat(weight[x:y], c) * rweight[found], len(dots))
            x = y
        hit = np.flatnonzero((dots > 0) & may[np.ix_(chosen[i:i + rows], others)].ravel())
        a, b = chosen[hit // n + i], others[hit % n]
        cut = np.minimum(left["cut"][a], right["cut"][b])
        bound = dots[hit] + left["tail"][a, cut] * right["tail"][b, cut] + SLACK
        ok = (bound >= scale.threshold - EPS) & (left["rep"][a] != right["rep"][b])
        if ok.any():
            yield a[ok], b[ok], bound[ok]


def possible(threshold: float, left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
    """Of all pairs, whether the bounds by groups and by numbers of grams allow the threshold."""
    least = threshold - EPS - SLACK
    of_left, of_right = (np.searchsorted(HEAVIEST, np.diff(side["at"])) for side in (left, right))
    may = left["profile"] @ right["profile"].T >= least
    may &= left["heavy"][:, of_right] >= least
    may &= right["heavy"][:, of_left].T >= least
    return may


def whole_dots(scale: Scale, dense: np.ndarray, right: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Dot products of a vector with rows of a block."""
    size = np.diff(right["at"])[rows]
    ends = np.cumsum(size)
    places = np.repeat(right["at"][rows] - (ends - size), size) + np.arange(ends[-1])
    _, weight, g = scale.weights(right, places)
    return np.add.reduceat(weight * dense[g], ends - size)


def search(scale, files: Sequence[str]):
    """(l, r, sim) of the best pairs of each text (rep, g, tf) in every group of the stored blocks, and what lies within
    TIE of them."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale_ = scale.value
        dense = np.zeros(len(scale_.idf))
        for b in pieces_of(it, LEFT_ROWS, LEFT_GRAMS):
            left = scale_.side(*arrays_of(b))
            best: dict[str, np.ndarray] = {}
            found: dict[str, list] = {}
            for right, groups in stored_blocks(files):
                names, group = np.unique(np.array(groups, object).astype(str), return_inverse=True)
                for name in names:
                    best.setdefault(name, np.full(len(left["rep"]), scale_.threshold - EPS + TIE))
                for rows, cols, bound in bounded_pairs(scale_, left, right):
                    starts = np.flatnonzero(np.diff(rows, prepend=-1))
                    for i, j in zip(starts, np.append(starts[1:], len(rows))):
                        a, c = rows[i], cols[i:j]
                        top = np.array([best[name][a] for name in names])
                        c = c[bound[i:j] >= top[group[c]] - TIE - EPS]
                        if not len(c):
                            continue
                        _, weight, g = scale_.weights(left, np.arange(left["at"][a], left["at"][a + 1]))
                        dense[g] = weight
                        for k in range(0, len(c), 256):
                            some = c[k:k + 256]
                            sim = whole_dots(scale_, dense, right, some)
                            for e, name in enumerate(names):
                                near = (group[some] == e) & (sim >= best[name][a] - TIE)
                                if near.any():
                                    best[name][a] = max(best[name][a], sim[near].max())
                                    found.setdefault(name, []).append((np.full(near.sum(), a), right["rep"][some[near]], sim[near]))
                        dense[g] = 0.0
            for name, parts in found.items():
                a, r, sim = (np.concatenate(x) for x in zip(*parts))
                near = sim >= best[name][a] - TIE
                yield pa.RecordBatch.from_arrays([pa.array(left["rep"][a[near]]), pa.array(r[near]), pa.array(sim[near])], names=["l", "r", "sim"])
    return run


def candidates(scale, files: Sequence[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(it, LEFT_ROWS, LEFT_GRAMS):
            left = scale.value.side(*arrays_of(b))
            for right, _ in stored_blocks(files):
                for rows, cols, _ in bounded_pairs(scale.value, left, right):
                    yield pa.RecordBatch.from_arrays([pa.array(left["rep"][rows]), pa.array(right["rep"][cols])], names=["l", "r"])
    return run


def compared(how, schema: str, weights: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    scale = Scale.of(weights, threshold)
    shared = weights.sparkSession.sparkContext.broadcast(scale)
    grp = "grp" if "grp" in right.columns else F.lit("").alias("grp")
    rows = weights.join(right.select("rep", grp), "rep").select("rep", "g", "tf", "grp")
    conf = weights.sparkSession.conf
    records = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")  # a row holds the grams of a text
    try:
        kinds = rows.mapInArrow(lambda it: kinds_of(shared)(it), "rep long, g array<int>, tf array<int>, grp string, kind int, size int")
        n = right.count()
        parts = max(1, min(max(weights.sparkSession.sparkContext.defaultParallelism, n // (4 * BLOCK_ROWS)), -(-n // BLOCK_ROWS)))
        rows = kinds.repartitionByRange(parts, "kind", "size", "rep").sortWithinPartitions("kind", "size", "rep").select("rep", "g", "tf", "grp", "kind")
        blocks = written(rows.mapInArrow(lambda it: blocks_of(shared.value)(it), ", ".join([*[f"{k} binary" for k in LAYOUT], "grp array<string>"])), "blocks", ONE_BY_ONE)
        files = sorted(blocks.inputFiles())
        return written(weights.join(left.select("rep"), "rep", "left_semi").select("rep", "g", "tf").mapInArrow(how(shared, files), schema), "pairs")
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)


def candidate_pairs(weights: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r) of all pairs of distinct texts whose cosine can reach the threshold. `left`, `right` hold `rep`."""
    return compared(candidates, "l long, r long", weights, left, right, threshold)


def best_pairs(weights: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, sim): for every text of `left` (rep) and group of `right` (rep, grp) the pair of the largest cosine, if it
    reaches the threshold, and pairs that equal it to nine decimals. A text may be in several groups."""
    return compared(search, "l long, r long, sim double", weights, left, right, threshold)


def max_similarity(corpus: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per pool item (in_R false): the largest cosine to any test item (in_R true) if it reaches the threshold.

    Items with a test copy of the same text have cosine 1; the others are searched.
    """
    keyed = corpus.select("item_id", "item_num", "event", "in_R", text_digest().alias("k"))
    reps = written(corpus.groupBy(text_digest().alias("k")).agg(
        F.min("item_num").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("in_R"), F.col("item_num"))).alias("test_id"),
        F.max((~F.col("in_R")).cast("int")).alias("has_pool")), "reps")
    weights = gram_weights(corpus, reps)
    searched = reps.filter("has_pool = 1 AND test_id IS NULL")
    pairs = best_pairs(weights, searched, reps.filter("test_id IS NOT NULL"), threshold)
    best = pairs.join(reps.select(F.col("rep").alias("r"), F.col("test_id").alias("partner")), "r").groupBy(F.col("l").alias("rep")).agg(
        F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("partner")).alias("p"))).alias("m")).select("rep", "m.sim", (-F.col("m.p")).alias("partner"))
    empty = F.col("k") == F.unhex(F.sha2(F.lit(""), 256))  # an empty text has a zero vector
    exact = reps.filter("has_pool = 1 AND test_id IS NOT NULL").filter(~empty).select("k", F.lit(1.0).alias("sim"), F.col("test_id").alias("partner"))
    found = best.join(reps.select("k", "rep"), "rep").select("k", "sim", "partner").unionByName(exact)
    return keyed.filter("NOT in_R").join(found, "k").select("item_id", "item_num", "event", "sim", "partner")


def near_duplicates(sims: DataFrame, threshold: float = 0.8) -> DataFrame:
    return sims.filter(F.col("sim") >= threshold)


def near_duplicate_counts(sims: DataFrame, corpus: DataFrame, threshold: float = 0.8) -> DataFrame:
    a = sims.agg(F.count(F.when(F.col("sim") >= threshold, 1)).alias("n_near"), F.count(F.when(F.col("sim") >= 0.9999, 1)).alias("n_exact"))
    return a.withColumn("n_pool", corpus.filter("NOT in_R").agg(F.count(F.lit(1)).alias("n")).scalar())


def band(sim: Column, bands: Sequence[tuple[float, float]] = BANDS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in bands:
        out = F.when((sim >= lo) & (sim < hi), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def similarity_bands(sims: DataFrame, samples: int = 4) -> DataFrame:
    """Items per similarity band and a few example ids in hash order."""
    b = sims.withColumn("band", band(F.col("sim"))).filter("band IS NOT NULL").withColumn("draw", hash32("band", F.col("item_id")))
    counts = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("band").orderBy("draw", "item_num"))
    few = b.withColumn("rk", rank).filter(F.col("rk") <= samples).groupBy("band").agg(F.array_join(F.array_sort(F.collect_list("item_num")), ",").alias("examples"))
    return counts.join(few, "band")


def sample_similarity(corpus: DataFrame, samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per (seed, test item): the largest cosine to the seed's training sample, 0 when below the threshold."""
    keyed = corpus.select("item_id", "item_num", "in_R", text_digest().alias("k"))
    reps = written(representatives(corpus), "reps")
    weights = gram_weights(corpus, reps)
    ids = keyed.join(reps.select("k", "rep"), "k").select("item_id", "rep", "in_R")
    test = ids.filter("in_R")
    taken = written(samples.select("seed", "item_id").join(ids.select("item_id", "rep"), "item_id").select("seed", F.col("rep").alias("r")).distinct(), "taken")
    pairs = best_pairs(weights, test.select("rep").distinct(), taken.select(F.col("r").alias("rep"), F.col("seed").cast("string").alias("grp")), threshold)
    same = test.select(F.col("rep").alias("l"), F.col("rep").alias("r"), F.lit(1.0).alias("sim")).distinct().join(weights.select(F.col("rep").alias("r")).distinct(), "r", "left_semi")
    best = pairs.unionByName(same).join(taken, "r").groupBy("seed", F.col("l").alias("rep")).agg(F.max("sim").alias("sim"))
    names = samples.select("seed").distinct().agg(F.collect_list("seed").alias("s"))
    grid = test.select("item_id", "rep").withColumn("s", names.scalar()).select("item_id", "rep", F.explode("s").alias("seed"))
    return grid.join(best, ["seed", "rep"], "left").select("seed", "item_id", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def similarity_strata(sims: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per stratum: pooled present-class macro-F1 of run a minus run b, averaged over seeds. a, b: (seed, item_id, y_true, y_pred)."""
    from gapcube.functions.columns import f1
    rows = a.select("seed", "item_id", "y_true", F.col("y_pred").alias("pa")).join(b.select("seed", "item_id", F.col("y_pred").alias("pb")), ["seed", "item_id"]).join(
        sims.withColumn("stratum", band(F.round("sim", 9), STRATA)), ["seed", "item_id"])
    pairs = rows.select("seed", "stratum", "y_true", F.explode(F.array(F.struct(F.lit("a").alias("arm"), F.col("pa").alias("p")), F.struct(F.lit("b").alias("arm"), F.col("pb").alias("p")))).alias("q")).groupBy(
        "seed", "stratum", "q.arm", "y_true", "q.p").agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select("seed", "stratum", "arm", "n", F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.when(F.col("y_true") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col("y_true") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("y_true") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")))).alias("c"))
    cells = each.groupBy("seed", "stratum", "arm", "c.cls").agg(F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn"))
    m = cells.filter("tp + fn > 0").groupBy("seed", "stratum", "arm").agg(F.avg(f1()).alias("f"), F.sum(F.col("tp") + F.col("fn")).alias("n"))
    s = m.groupBy("seed", "stratum").agg((F.max(F.when(F.col("arm") == "a", F.col("f"))) - F.max(F.when(F.col("arm") == "b", F.col("f")))).alias("d"), F.max("n").alias("n"))
    return s.groupBy("stratum").agg(F.avg("d").alias("pooled_e2_mean"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_seeds"))
