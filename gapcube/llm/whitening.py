"""Embedding whitening by shifted CholeskyQR.

Vectors are put on a grid of integers, so sums are exact in any order. The centred rows are orthogonalised by repeated
Gram passes over the data: each pass takes R from the Cholesky factor of the Gram matrix (shifted in the first pass, so
it exists, and later where the matrix is not safely positive), and rows are divided by all factors so far through
triangular solves. The composed factor R carries the singular values of the rows at full precision, which a covariance
matrix would square away; its singular value decomposition gives the components. Only d x d matrices reach the driver, d being the number of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import table
from gapcube.session import written

COMPONENTS = 8
#: The grid: an entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Gram passes at most; three are enough for full rank, and rows of low rank may need one more.
PASSES = 4
#: Singular values below this share of the largest are rounding noise of rows without full rank.
RANK = 1e-10
#: Rows of a batch that are worked on at a time.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n vectors with integer sums, components as columns, their eigenvalues, the whole variance."""
    n: int
    sums: np.ndarray
    largest: int
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def grid(batch: pa.RecordBatch, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) by length of a batch (id, vector): rows without null or non-finite entries."""
    lists = batch.column(1)
    if pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()  # null lists have no entries here
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    base = np.concatenate([[0], np.cumsum(size)])
    for d in [dims] if dims else np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        for i in range(0, len(rows), ROWS):
            some = rows[i:i + ROWS]
            x = np.floor(flat[base[some][:, None] + np.arange(d)] * SCALE) + OFFSET
            fine = (np.abs(x) < 2.0 ** 53).all(1)  # false for NaN; larger entries are no exact integers
            if fine.any():
                yield some[fine], x[fine].astype(np.int64)


def sums_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, place, n, sum, largest) of the rows of a task, by length of vectors."""
    seen: dict[int, list] = {}
    for b in it:
        for _, x in grid(b):
            at = seen.setdefault(x.shape[1], [0, [0] * x.shape[1], 0])
            at[0] += len(x)
            at[1] = [p + int(q) for p, q in zip(at[1], x.sum(0))]
            at[2] = max(at[2], int(np.abs(x).max()))
    for d, (n, s, top) in seen.items():
        columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                   pa.array([Decimal(v) for v in s], pa.decimal128(38, 0)), pa.array([top] * d, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["dims", "place", "n", "total", "largest"])


def deviations(x: np.ndarray, n: int, sums: np.ndarray, largest: int) -> np.ndarray:
    """n * x - sum, exact: int64, or Python integers where 64 bits are too few."""
    if n * largest < 1 << 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def centred(n: int, sums: np.ndarray, largest: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: deviations(x, n, sums, largest).astype(np.float64) / n


def divided(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y times the inverse of upper triangular r: a triangular solve, column by column for all rows."""
    q = np.empty_like(y)
    for j in range(r.shape[0]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j] if r[j, j] else 0.0
    return q


def gram(vectors: DataFrame, dims: int, rows_of: Callable[[np.ndarray], np.ndarray], out: int) -> np.ndarray:
    """Sum of the outer products of rows_of(x): one partial matrix a task, added by Spark entry by entry."""
    upper = np.triu_indices(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for b in it:
            for _, x in grid(b, dims):
                y = rows_of(x)
                total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    got = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    g = np.zeros((out, out))
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    g[i, j] = v
    g[j, i] = v
    return g


def factor(g: np.ndarray, rows: int, first: bool) -> np.ndarray:
    """Upper triangular R with R'R = g + shift; the first pass is shifted, a later one where it isn't safe without."""
    d = len(g)
    scale = np.linalg.norm(g, 2)
    if scale == 0:
        return np.eye(d)
    shift = 11 * (rows * d + d * (d + 1)) * (np.finfo(float).eps / 2) * scale
    safe = not first and np.linalg.eigvalsh(g)[0] > max(shift, 1e-8 * scale)
    return np.linalg.cholesky(g if safe else g + min(shift, 0.01 * scale) * np.eye(d)).T


def fit(vectors: DataFrame, passes: int = PASSES) -> Whitening | None:
    """Components of rows (id, vector). None if no vector is left. Vectors of another length than the most frequent one
    (ties: the longer) are left out."""
    found = written(vectors.mapInArrow(sums_of, "dims int, place int, n bigint, total decimal(38,0), largest bigint")
                    .groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest")), "vector-sums")
    top = found.filter("place = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return None
    dims, n, largest = top["dims"], top["n"], top["largest"]
    sums = np.array([int(r["total"]) for r in found.filter(F.col("dims") == dims).orderBy("place").collect()], dtype=object)
    centre = centred(n, sums, largest)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        y = centre(x)
        for r in factors:
            y = divided(y, r)
        return y

    whole, trace = np.eye(dims), 0.0
    for k in range(passes):
        g = gram(vectors, dims, orthogonal, dims)
        trace = trace or float(np.trace(g)) / n
        if k and np.abs(g - np.eye(dims)).max() < 1e-13 * dims:
            break
        r = factor(g, n, k == 0)
        factors.append(r)
        whole = r @ whole
    _, s, vt = np.linalg.svd(whole / np.sqrt(n))
    some = s > RANK * s[0] if trace > 0 else np.zeros(len(s), bool)
    return Whitening(n, sums, largest, vt[some].T, s[some] ** 2, trace)


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation (decimal), whitened, explained,
    identity_error.

    A vector that is null, empty, of another length than most, or has a null, non-finite or no longer exact entry
    (2^53 and more on the grid) is neither fitted nor returned. Repeated rows count and come back as often as they
    stand, null ids too. Components without variance are left out: equal vectors, a single one or an empty table give
    no rows. Of equal eigenvalues any basis of their space may come. Other columns are ignored.
    """
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors)
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    dims, k = len(model.sums), min(components, len(model.eigenvalues))
    n, sums, largest = model.n, model.sums, model.largest
    turn = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    share = model.eigenvalues[:k] / model.trace
    centre = centred(n, sums, largest)
    error = float(np.abs(gram(vectors, dims, lambda x: centre(x) @ turn, k) / n - np.eye(k)).max())

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, x in grid(b, dims):
                d = deviations(x, n, sums, largest)
                w = (d.astype(np.float64) / n) @ turn
                if d.dtype == object or float(np.abs(d).max()) ** 2 * dims >= 2.0 ** 62:
                    far = pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in d], pa.decimal128(38, 0))
                else:
                    far = pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                m = len(each)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n)),
                    far.take(each), pa.array(w.ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(m, error))], names=[f.split()[0] for f in schema.split(", ")])

    return vectors.mapInArrow(project, schema)


def op11_embedding_whitening(spark, sf_dir):
    """Null where a deviation needs more than 64 bits (the operator has it as a decimal)."""
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")
