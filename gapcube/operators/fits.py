"""Held-out fits of all events and seeds as grouped work: no loop over runs on the driver.

Words of every text are hashed once; only they are stored and exchanged, tasks make the pairs. The capped sample of a run
is one bounded group: its task counts terms and document frequencies, and fits TF-IDF with multinomial logistic regression
on sparse arrays. Texts to predict are cut into bounded blocks per event; a block meets the models of its event's runs, so
an event with a third of all texts is many groups and each text is read once for all seeds. A task works on a slice of a
block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.operators.models import words_of
from gapcube.session import written

#: Terms that fewer texts of a sample have are left out; iterations and gradient at which a fit ends.
MIN_DF, MAX_ITER, TOLERANCE = 2, 2000, 1e-5
#: Texts of a block, and of a slice of it.
BLOCK, SLICE = 2000, 1000

MODEL = "held_out string, seed string, n_train long, terms array<long>, idf array<double>, weights array<double>, bias array<double>, iterations int, gradient double"


def coded_texts(corpus: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(item_id, event, label, carry, codes): 64-bit hashes of the words of each text, in order."""
    return corpus.select("item_id", "event", "label", *carry, F.transform(words_of(text), lambda t: F.xxhash64(t)).alias("codes"))


def rows_of(codes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every word and pair of neighbours of a list column of word hashes; null lists have none."""
    lists = codes.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, word = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False)
    beside = np.flatnonzero(row[1:] == row[:-1])
    return np.concatenate([row, row[beside]]), np.concatenate([word, pair_codes(word[beside], word[beside + 1])])


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of hashes: an odd multiplier for each place, then the finish of XXH64."""
    h = a.view(np.uint64) * np.uint64(0x9E3779B185EBCA87) + b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x27D4EB2F165667C5)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def tf_of(row: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tf) of the distinct places of each row, by row and place."""
    key, tf = np.unique(row * width + at, return_counts=True)
    return key // max(width, 1), key % max(width, 1), tf


def unit_rows(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(row, x * x, minlength=n))
    return x / np.where(norm > 0, norm, 1.0)[row]


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, memory: int = 10) -> tuple[np.ndarray, int, float]:
    """L-BFGS with backtracking on a smooth convex function; (x, iterations, largest entry of the gradient)."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tolerance:
            return x, k, float(np.abs(g).max(initial=0.0))
        d, kept = -g, []
        for s, y, r in reversed(steps):
            a = r * (s @ d)
            d = d - a * y
            kept.append(a)
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(kept)):
            d = d + s * (a - r * (y @ d))
        slope, size = g @ d, 1.0 if steps else 1.0 / max(np.linalg.norm(g), 1.0)
        for _ in range(40):
            new, g_new = f(x + size * d)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x, k, float(np.abs(g).max())
        s, y = size * d, g_new - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps[1 - memory:], (s, y, 1.0 / (s @ y))]
        x, value, g = x + s, new, g_new
    return x, max_iter, float(np.abs(g).max())


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def regress(row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, classes: int, c: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Weights (terms x classes) and bias that minimise mean log loss + |weights|^2 / (2 c n); the bias is free."""
    n = len(y)
    first = np.searchsorted(row, np.arange(n))
    some = np.bincount(row, minlength=n) > 0
    by = np.argsort(at, kind="stable")
    row_by, x_by = row[by], x[by, None]
    begin = np.searchsorted(at[by], np.arange(width))  # every term of the vocabulary has a text

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-classes].reshape(width, classes), p[-classes:]
        s = np.zeros((n, classes))
        if width:
            s[some] = np.add.reduceat(x[:, None] * w[at], first[some])
        q = softmax(s + b)
        loss = -np.log(np.maximum(q[np.arange(n), y], 1e-300)).mean() + (w * w).sum() / (2 * c * n)
        q[np.arange(n), y] -= 1
        q /= n
        gw = (np.add.reduceat(x_by * q[row_by], begin) if width else w) + w / (c * n)
        return float(loss), np.concatenate([gw.ravel(), q.sum(0)])

    p, k, g = minimise(f, np.zeros(width * classes + classes))
    return p[:-classes].reshape(width, classes), p[-classes:], k, g


def fitter(labels: Sequence[str], c: float):
    def run(key: tuple, sample: pa.Table) -> pa.Table:
        row, code = rows_of(sample.column("codes"))
        terms, at = np.unique(code, return_inverse=True)
        row, at, tf = tf_of(row, at, len(terms))
        df = np.bincount(at, minlength=len(terms))
        kept = df >= MIN_DF
        n = sample.num_rows
        idf = np.log((1.0 + n) / (1.0 + df[kept])) + 1.0
        some = kept[at]
        row, at, tf = row[some], (np.cumsum(kept) - 1)[at[some]], tf[some]
        x = unit_rows(row, (1.0 + np.log(tf)) * idf[at], n)
        y = np.array([labels.index(v) for v in sample.column("label").to_pylist()])
        seen = np.unique(y)
        w, b, k, g = regress(row, at, x, np.searchsorted(seen, y), len(idf), len(seen), c)
        weights, bias = np.zeros((len(idf), len(labels))), np.full(len(labels), -np.inf)  # a class that training lacks has probability 0
        weights[:, seen], bias[seen] = w, b
        values = [key[0].as_py(), key[1].as_py(), n, terms[kept], idf, weights.ravel(), bias, k, g]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3, pa.int32(), pa.float64()]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[p.split()[0] for p in MODEL.split(", ")])
    return run


def fit_runs(samples: DataFrame, coded: DataFrame, labels: Sequence[str], c: float = 1.0) -> DataFrame:
    """One model per (held_out, seed) of the capped samples (held_out, seed, item_id); ids of `coded` are unique."""
    rows = samples.select("held_out", "seed", "item_id").join(coded.select("item_id", "label", "codes"), "item_id")
    return written(rows.select("held_out", "seed", "label", "codes").groupBy("held_out", "seed").applyInArrow(fitter(list(labels), c), MODEL), "models")


def predictor(labels: Sequence[str]):
    def slice_of(texts: pa.Table, models: pa.Table, parts: list[pa.Table]) -> None:
        row, code = rows_of(texts.column("codes"))
        n = texts.num_rows
        for m in models.to_batches():
            for i in range(m.num_rows):
                terms, idf, weights, bias = (m.column(c)[i].values.to_numpy() for c in ("terms", "idf", "weights", "bias"))
                s = np.tile(bias, (n, 1))
                if len(terms) and len(code):
                    at = np.minimum(np.searchsorted(terms, code), len(terms) - 1)
                    known = terms[at] == code
                    r, a, tf = tf_of(row[known], at[known], len(terms))
                    x = unit_rows(r, (1.0 + np.log(tf)) * idf[a], n)
                    w = weights.reshape(len(terms), len(labels))
                    first = np.flatnonzero(np.diff(r, prepend=-1))
                    if len(r):
                        s[r[first]] += np.add.reduceat(x[:, None] * w[a], first)
                p = softmax(s)
                best = [labels[k] for k in p.argmax(1)]
                probability = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(labels), pa.int32()), pa.array(p.ravel()))
                parts.append(pa.table([pa.array([m.column("seed")[i].as_py()] * n, pa.string()), texts.column("item_id"), texts.column("event"), texts.column("label"), pa.array(best, pa.string()), probability],
                                      names=["seed", "item_id", "event", "y_true", "y_pred", "pr"]))

    def run(key: tuple, texts: pa.Table, models: pa.Table) -> pa.Table:
        parts: list[pa.Table] = []
        for at in range(0, texts.num_rows, SLICE):
            slice_of(texts.slice(at, SLICE), models, parts)
        kinds = pa.schema([(c, pa.string()) for c in ("seed", "item_id", "event", "y_true", "y_pred")] + [("pr", pa.list_(pa.float64()))])
        return pa.concat_tables(parts).cast(kinds) if parts else kinds.empty_table()
    return run


def predict_runs(models: DataFrame, coded: DataFrame, labels: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(run_key, seed, item_id, event, y_true, y_pred, p): every text of an event by every model that held it out.

    p maps each class to its probability. An event without a model has no rows.
    """
    blocks = written(coded.groupBy("event").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    texts = coded.join(blocks, "event").withColumn("block", F.expr("pmod(xxhash64(item_id, 'block'), blocks)"))
    wanted = models.select(F.col("held_out"), "seed", "terms", "idf", "weights", "bias").join(blocks.withColumnRenamed("event", "held_out"), "held_out")
    wanted = wanted.withColumn("part", F.explode(F.expr("sequence(0L, blocks - 1L)"))).drop("blocks")
    rows = texts.select("event", "block", "item_id", "label", "codes").groupBy("event", "block").cogroup(wanted.groupBy("held_out", "part")).applyInArrow(
        predictor(list(labels)), "seed string, item_id string, event string, y_true string, y_pred string, pr array<double>")
    return rows.select(F.concat(F.lit("loeo:"), "event").alias("run_key"), "seed", "item_id", "event", "y_true", "y_pred", F.map_from_arrays(class_array(labels), "pr").alias("p"))


def class_array(labels: Sequence[str]) -> Column:
    return F.array(*map(F.lit, labels))


def heldout_fit_predict(corpus: DataFrame, samples: DataFrame, labels: Sequence[str], c: float = 1.0) -> DataFrame:
    """Fits of all runs (held_out, seed) of `samples` and predictions of every text of their held-out events.

    `corpus` (item_id, event, label, text) has unique ids; `labels` is the class list, in the order that breaks ties.
    """
    coded = written(coded_texts(corpus), "coded")
    return predict_runs(fit_runs(samples, coded, labels, c), coded, labels)
