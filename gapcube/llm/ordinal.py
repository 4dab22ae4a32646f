"""Quality grades by ordinal cumulative-link regression.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector for all grades and ordered thresholds. The features
are hashed byte trigrams of the whole text (square roots of relative frequencies), so every text has a vector of the
same size. A document gets its expected grade and the tail probability P(grade >= CUT), by which it is selected.
Ratings: 0 poor, 1 good but toxic, 2 good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcube.llm.common import flat, held_out, table
from gapcube.llm.toxicity import labelled_rows

DIMENSIONS = 2048
#: Bound on the rated rows that the model learns from (a hash draw).
TRAIN_ROWS = 5_000
CUT, SELECT_AT = 1, 0.4
RIDGE, STEPS = 1e-4, 200


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of a flat string column; the zero vector for fewer than three bytes."""
    out = np.zeros((len(at) - 1, DIMENSIONS), np.float32)
    x = data.astype(np.uint32)
    if len(x) < 3:
        return out
    place = ((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(2654435761)) >> np.uint32(21)
    for i in range(len(out)):
        if at[i + 1] - at[i] >= 3:
            n = np.bincount(place[at[i]:at[i + 1] - 2], minlength=DIMENSIONS)
            out[i] = np.sqrt(n / n.sum())
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient steps on the likelihood; gaps stay positive by exp."""
    n, cuts = max(len(grade), 1), grades - 1
    share = np.clip([(grade <= k).mean() if len(grade) else (k + 1) / grades for k in range(cuts)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    mean = x.mean(0) if len(x) else np.zeros(DIMENSIONS)
    x = x - mean
    w, theta0 = np.zeros(DIMENSIONS), float(first[0])
    m, v = np.zeros(DIMENSIONS + cuts), np.zeros(DIMENSIONS + cuts)
    for t in range(1, STEPS + 1 if len(grade) else 1):
        theta = theta0 + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        s = x @ w.astype(np.float32)
        upper = np.where(grade < cuts, logistic(np.append(theta, 0)[grade] - s), 1.0)
        lower = np.where(grade > 0, logistic(np.append(0, theta)[grade] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of -log p, by threshold
        gw = x.T @ ((du - dl) / n).astype(np.float32) + RIDGE * w
        gt = np.array([-(du[grade == k].sum() - dl[grade == k + 1].sum()) / n for k in range(cuts)])
        g = np.concatenate([gw, [gt.sum()], np.exp(gaps) * np.cumsum(gt[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, theta0, gaps = w - step[:DIMENSIONS], theta0 - step[DIMENSIONS], gaps - step[DIMENSIONS + 1:]
    theta = theta0 + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return w, theta + mean @ w


def train(rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most about `rows` rated rows, drawn by a hash of the id. Without ratings the thresholds are even."""
    known = rated.filter(F.col(grade_col).isNotNull())
    share = min(1.0, rows / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("grades")), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade")).repartition(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows_, got = [], [], []
        for b in it:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            rows_.append(features(*flat(b.column(1))))
            got.append(b.column(2).to_numpy(zero_copy_only=False))
        if not ids:
            return
        order = np.argsort(np.concatenate(ids), kind="stable")
        w, theta = fit(np.concatenate(rows_)[order], np.concatenate(got)[order], grades)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([theta.tolist()], pa.list_(pa.float64()))], names=["weight", "threshold"])

    made = sample.mapInArrow(run, "weight array<double>, threshold array<double>").collect()
    w, theta = (np.array(made[0][0]), np.array(made[0][1])) if made else fit(np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), grades)
    return {"weight": w, "threshold": theta}


def rating(model: dict, text: str | Column = "text", cut: int = CUT) -> Column:
    """struct(expected_grade, tail_probability) of whole texts; null and empty texts have the zero vector."""
    w, theta = model["weight"].astype(np.float32), model["threshold"]
    shape = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])

    @F.pandas_udf(shape)
    def rated(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            data, at = flat(pa.array(s, pa.large_string(), from_pandas=True))
            score = np.concatenate([features(data[at[i]:at[min(i + 256, len(s))]], at[i:i + 257] - at[i]) @ w for i in range(0, len(s), 256)] or [np.zeros(0)])
            tails = 1 - logistic(theta[None, :] - score[:, None])
            yield pd.DataFrame({"expected_grade": tails.sum(1), "tail_probability": tails[:, cut - 1]})

    return rated(F.col(text) if isinstance(text, str) else text)


def op10_quality_classifier(spark, sf_dir):
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model = train(labelled_rows(spark, sf_dir).withColumn("grade", grade))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), rating(model).alias("r"))
    return docs.select("doc_id", "held_out", "r.expected_grade", "r.tail_probability", (F.col("r.tail_probability") >= SELECT_AT).alias("kept"))
