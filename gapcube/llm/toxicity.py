"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of the lower-cased bytes are hashed to `DIMENSIONS` places. Document frequencies of toxic and other labelled
rows give the log-count ratio of every place; the places whose ratio is most certain are kept, and a logistic
regression is fitted on presence times ratio. A text's score adds the weights of the n-grams it has anywhere, so whole
texts are read once and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import chunks, flat, held_out, table

GRAMS = (3, 4, 5, 6)
DIMENSIONS = 1 << 20
#: Bound on the labelled rows that the model learns from (a hash draw; documented in the README).
TRAIN_ROWS = 6_000
FEATURES = 2_000
THRESHOLD = 0.3
SMOOTH, RIDGE, STEPS = 1.0, 1.0, 100

LOWER_TABLE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the hashed place of the n-gram that begins at every byte (the last few read zeros)."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray((len(data),), "<u8", raw, strides=(1,))
    for n in GRAMS:
        x = (words & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        yield n, (x >> np.uint64(44)).astype(np.int32)


def present(data: np.ndarray, at: np.ndarray, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the rows' n-grams; `slot` maps places to features (-1: none), None keeps places."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, place in grams(data.tobytes().translate(LOWER_TABLE)):
        f = place if slot is None else slot[place]
        hit = np.arange(len(f)) if slot is None else np.flatnonzero(f >= 0)
        row = np.searchsorted(at, hit, side="right") - 1
        inside = hit + n <= at[row + 1]
        rows.append(row[inside])
        found.append(f[hit[inside]].astype(np.int64))
    key = np.unique(np.concatenate(rows) << 32 | np.concatenate(found))
    return key >> 32, key & 0xFFFFFFFF


def fit(texts: pa.Array, toxic: np.ndarray) -> dict:
    """Model of a bounded sample: the kept places, their weights, and the intercept."""
    data, at = flat(texts)
    counts = np.zeros((2, DIMENSIONS))
    for i, j in chunks(at, 1 << 17):  # small enough to sort in cache
        row, place = present(data[at[i]:at[j]], at[i:j + 1] - at[i], None)
        for c in (0, 1):
            counts[c] += np.bincount(place[toxic[i:j][row] == c], minlength=DIMENSIONS)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    if not n.all():  # nothing to tell apart: the share of toxic rows is every score
        share = (n[1] + 0.5) / (n.sum() + 1)
        return {"place": [], "weight": [], "bias": float(np.log(share / (1 - share)))}
    rate = (counts + SMOOTH) / (n[:, None] + 2 * SMOOTH)
    ratio = np.log(rate[1] / rate[0])
    certain = np.abs(ratio) / np.sqrt(1 / (counts[1] + SMOOTH) + 1 / (counts[0] + SMOOTH))
    certain[counts.sum(0) < 3] = 0
    place = np.sort(np.argsort(-certain, kind="stable")[:FEATURES])
    slot = np.full(DIMENSIONS, -1, np.int32)
    slot[place] = np.arange(len(place))
    rows, found = [], []
    for i, j in chunks(at):
        r, f = present(data[at[i]:at[j]], at[i:j + 1] - at[i], slot)
        rows.append(r + i)
        found.append(f)
    row, col = np.concatenate(rows), np.concatenate(found)
    value = ratio[place][col]
    w, b = logistic(row, col, value, toxic.astype(float), len(place))
    return {"place": place.tolist(), "weight": (w * ratio[place]).tolist(), "bias": float(b)}


def logistic(row, col, value, y, width) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps over coordinates (row, col, value)."""
    n = len(y)
    step = 1 / (0.25 * (power_norm(row, col, value, n, width) * 1.1 + n) / n + RIDGE / n)
    theta = np.zeros(width + 1)
    theta[-1] = np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    look, old = theta.copy(), theta.copy()
    for t in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * look[col], minlength=n) + look[-1], -35, 35)))
        error = (p - y) / n
        grad = np.append(np.bincount(col, value * error[row], minlength=width) + RIDGE / n * look[:-1], error.sum())
        theta = look - step * grad
        look = theta + t / (t + 3) * (theta - old)
        old = theta
    return theta[:-1], theta[-1]


def power_norm(row, col, value, n, width, steps: int = 12) -> float:
    """Largest eigenvalue of X'X."""
    v, most = np.ones(width), 1.0
    for _ in range(steps):
        u = np.bincount(col, value * np.bincount(row, value * v[col], minlength=n)[row], minlength=width)
        most = float(np.linalg.norm(u)) or 1.0
        v = u / most
    return most


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most about `rows` rows with a label; the draw is a hash of the id, so a repeated task gives the same."""
    known = labelled.filter(F.col(label_col).isNotNull())
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    drawn = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).repartition(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(it), schema=pa.schema([("id", pa.int64()), ("text", pa.string()), ("label", pa.int32())])).combine_chunks()
        got = got.sort_by("id")
        m = fit(got["text"].combine_chunks().cast(pa.string()) if len(got) else pa.array([], pa.string()), got["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m["place"]], pa.list_(pa.int64())), pa.array([m["weight"]], pa.list_(pa.float64())), pa.array([m["bias"]])], names=["place", "weight", "bias"])

    made = sample.select(F.col("id").cast("long"), "text", "label").mapInArrow(run, "place array<long>, weight array<double>, bias double").collect()
    m = made[0].asDict() if made else fit(pa.array([], pa.string()), np.zeros(0, int))
    return {"place": np.array(m["place"], np.int64), "weight": np.array(m["weight"], float), "bias": m["bias"]}


def score(model: dict, text: str | Column = "text") -> Column:
    """Score column, 0 to 1, of whole texts; null and empty texts have the score of a text without n-grams."""
    place, weight, bias = np.asarray(model["place"], np.int64), np.asarray(model["weight"], float), model["bias"]

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slot = np.full(DIMENSIONS, -1, np.int32)
        slot[place] = np.arange(len(place))
        for s in parts:
            data, at = flat(pa.array(s, pa.large_string(), from_pandas=True))
            out = np.full(len(s), float(bias))
            for i, j in chunks(at):
                row, f = present(data[at[i]:at[j]], at[i:j + 1] - at[i], slot)
                out[i:j] += np.bincount(row, weight[f], minlength=j - i) if len(row) else 0.0
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return scored(F.col(text) if isinstance(text, str) else text)


def labelled_rows(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents with a label, without the held-out quarter."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").filter(~held_out())
    return docs.select("doc_id", "text").join(labels, "doc_id")


def op4_toxicity(spark, sf_dir):
    model = train(labelled_rows(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return docs.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
