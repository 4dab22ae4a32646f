"""Result tables and regression comparisons (data only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.functions.columns import dbl


def value_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose values differ or that only one side has. Inputs: (key, value)."""
    j = a.select("key", F.col("value").alias("value_a"), F.lit(True).alias("_a")).join(b.select("key", F.col("value").alias("value_b"), F.lit(True).alias("_b")), "key", "full_outer")
    state = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("different")
    return j.filter(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("value_a").eqNullSafe(F.col("value_b"))).select("key", "value_a", "value_b", state.alias("state"))


def close(x: Column, y: Column, rel: float, absolute: float) -> Column:
    both_nan = (x.isNull() | F.isnan(x)) & (y.isNull() | F.isnan(y))
    return both_nan | F.coalesce(F.abs(x - y) <= F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute)), F.lit(False))


def result_diff(a: DataFrame, b: DataFrame, rel: float = 1e-9, absolute: float = 1e-12, ignore: Sequence[str] = ()) -> DataFrame:
    """Summary of a tolerant comparison of two (key, DOUBLE value) results without the ignored keys."""
    keep = ~F.col("key").isin(list(ignore)) if ignore else F.lit(True)
    j = a.filter(keep).select("key", F.col("value").alias("x"), F.lit(1).alias("_a")).join(b.filter(keep).select("key", F.col("value").alias("y"), F.lit(1).alias("_b")), "key", "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & close(F.col("x"), F.col("y"), rel, absolute)
    return j.agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.when(~same, 1)).alias("n_different"),
                 F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("n_missing"), F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("max_abs_diff"))


def flatten(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, value): one row per number of a result table."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), dbl(c).alias("v")) for c in columns]))
    return df.select(*keys, entries.alias("e")).select(F.concat_ws("/", *keys, "e.c").alias("key"), F.col("e.v").alias("value"))


def results_table(point: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per system and label list: pooled, per-event, A and its interval."""
    j = point.join(intervals, "system")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("conv"), F.col(f"pooled_{c}").alias("pooled"), F.col(f"per_event_{c}").alias("per_event"), F.col(f"A_{c}").alias("A"),
                                        F.col(f"A_{c}_lo95").alias("A_lo"), F.col(f"A_{c}_hi95").alias("A_hi")) for c in "PDO"]))
    return j.select("system", rows.alias("r")).select("system", "r.*")


def terms_table(point: DataFrame, intervals: DataFrame, terms: Sequence[str]) -> DataFrame:
    j = point.join(intervals, "system")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("mean"), F.col(f"{t}_lo95").alias("lo"), F.col(f"{t}_hi95").alias("hi")) for t in terms]))
    return j.select("system", rows.alias("r")).select("system", "r.*")


def summary_stats(cells: DataFrame, limit: int = 15) -> DataFrame:
    """Mean F1 of small and other cells, and the smallest class total, per system. `cells` from filters.cell_table."""
    small = F.col("support") < limit
    a = cells.groupBy("system").agg(F.avg(F.when(small, F.col("f1"))).alias("small_f1"), F.avg(F.when(~small, F.col("f1"))).alias("other_f1"), F.count(F.when(small, 1)).alias("n_small"), F.count(F.lit(1)).alias("n_cells"))
    totals = cells.groupBy("system", "cls").agg(F.sum("support").alias("s")).groupBy("system").agg(F.min("s").alias("min_class_total"))
    return a.join(totals, "system")


def exponent(x) -> Column:
    """Smallest power of ten at or above a deviation."""
    return F.ceil(F.log10(F.greatest(dbl(x), F.lit(1e-300)))).cast("bigint")


def scatter_data(cells: DataFrame) -> DataFrame:
    return cells.select("system", "event", "cls", "support", "f1")
