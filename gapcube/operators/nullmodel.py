"""Parametric resampling: the fixed-rate null of the gap, and a stratified instance bootstrap from cell counts.

Both draw counts of reduced cells, never single messages, so their cost does not depend on the number of messages.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, hash32, ratio
from gapcube.operators import cube as C


@F.pandas_udf(T.ArrayType(T.LongType()))
def binomial_udf(n: pd.Series, p: pd.Series, reps: pd.Series, seed: pd.Series) -> pd.Series:
    """`reps` binomial counts per row, seeded by the row's own hash."""
    return pd.Series([np.random.default_rng(int(s)).binomial(int(k), float(q), int(r)) for k, q, r, s in zip(n, p, reps, seed)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def multinomial_udf(counts: pd.Series, seed: pd.Series) -> pd.Series:
    """Resampled cell counts of one stratum, seeded by the row's own hash."""
    out = []
    for c, s in zip(counts, seed):
        c = np.asarray(c, dtype=float)
        out.append(np.random.default_rng(int(s)).multinomial(int(c.sum()), c / c.sum()).astype("int64"))
    return pd.Series(out)


def with_rates(cube: DataFrame, by: Sequence[str], weight: str = "1L") -> DataFrame:
    """Pooled recall and false-positive rate of every class in the (drawn) corpus beside each cell."""
    pool = Window.partitionBy(*by, "cls")
    level = Window.partitionBy(*by, "event")
    m = F.expr(weight)
    s = F.col("tp") + F.col("fn")
    x = cube.select("*", dbl(s).alias("sup"), F.sum(s).over(level).alias("n_e"))
    x = x.select("*", F.sum(m * F.col("sup")).over(pool).alias("s_c"), F.sum(m * F.col("tp")).over(pool).alias("t_c"), F.sum(m * F.col("fp")).over(pool).alias("p_c"), F.sum(m * F.col("n_e")).over(pool).alias("n_all"))
    return x.withColumn("recall", ratio("t_c", "s_c")).withColumn("fpr", F.col("p_c") / F.greatest(F.col("n_all") - F.col("s_c"), F.lit(1.0)))


def simulate(cells: DataFrame, reps: int, *key: str) -> DataFrame:
    """Replicate cells (rep, ..., tp, fp, fn) with counts redrawn under the rates."""
    parts = [F.col(k) for k in key]
    t = binomial_udf(F.col("sup").cast("bigint"), "recall", F.lit(reps), hash32("tp", *parts))
    p = binomial_udf((F.col("n_e") - F.col("sup")).cast("bigint"), "fpr", F.lit(reps), hash32("fp", *parts))
    drop = ("tp", "fp", "fn", "n_e", "s_c", "t_c", "p_c", "n_all", "recall", "fpr", "_t", "_p")
    r = cells.withColumn("_t", t).withColumn("_p", p).select("*", F.posexplode(F.arrays_zip("_t", "_p")).alias("rep", "_z"))
    r = r.drop(*drop).select("*", F.col("_z._t").alias("tp"), F.col("_z._p").alias("fp"))
    return r.withColumn("fn", (F.col("sup") - F.col("tp")).cast("bigint")).drop("sup", "_z")


def fixed_rate_null(cube: DataFrame, reps: int = 200) -> DataFrame:
    """Seed-mean A and T1..T4 of every (system, replicate) if recall and false-positive rates were the same in all events."""
    sim = simulate(with_rates(cube, C.RUN), reps, "system", "seed", "event", "cls")
    keys = ("system", "seed", "rep")
    return C.seed_mean(C.score_cube(sim, keys), ["system", "rep"], ["A_P", "T1", "T2", "T3", "T4"])


def null_summary(values: DataFrame, columns: Sequence[str] = ("A_P", "T1", "T2", "T3", "T4")) -> DataFrame:
    from gapcube.operators.resample import percentiles
    means = values.groupBy("system").agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    return means.join(percentiles(values, ["system"], list(columns)), "system")


def observed_minus_null(cube: DataFrame, event_draw: DataFrame, seed_draw: DataFrame, reps: int = 20) -> DataFrame:
    """Per (draw, system): A of the drawn events minus the mean null A with rates of the same drawn events.

    A drawn event taken m times is simulated m times, each copy with its own counts.
    """
    drawn = cube.join(event_draw, "event")
    rated = with_rates(drawn, ("b", *C.RUN), "m")
    copies = rated.withColumn("copy", F.explode(F.expr("sequence(1, cast(m AS INT))"))).drop("m")
    sim = simulate(copies, reps, "b", "system", "seed", "event", "copy", "cls").withColumn("event", F.concat_ws("#", "event", "copy")).drop("copy")
    keys = ("b", "system", "seed", "rep")
    null = C.score_cube(sim, keys).groupBy("b", "system", "seed").agg(F.avg("A_P").alias("null_A"))
    from gapcube.operators.resample import draw_scores
    seen = draw_scores(C.cell_features(cube), event_draw).select("b", "system", "seed", "A_P")
    j = seen.join(null, ["b", "system", "seed"]).join(seed_draw, ["b", "system", "seed"])
    return j.groupBy("b", "system").agg((F.sum((F.col("A_P") - F.col("null_A")) * F.col("ms")) / F.max("n_seeds")).alias("omn"))


def joint_counts(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, event, y_true, pa, pb, n): two runs' predictions on the same items."""
    on = [*by, "event", "item_id", "y_true"]
    j = a.select(*on, F.col("y_pred").alias("pa")).join(b.select(*on, F.col("y_pred").alias("pb")), on)
    return j.groupBy(*by, "event", "y_true", "pa", "pb").agg(F.count(F.lit(1)).alias("n"))


def stratified_paired_boot(joint: DataFrame, by: Sequence[str], draws: int) -> DataFrame:
    """Draws of the pooled present-class macro-F1 difference, items resampled inside each event.

    Resampling n items with replacement is a multinomial over the joint (true, first, second) counts of the event.
    """
    by = list(by)
    strata = joint.groupBy(*by, "event").agg(F.array_sort(F.collect_list(F.struct("y_true", "pa", "pb", "n"))).alias("cells"))  # at most classes^3 cells
    d = strata.withColumn("b", F.explode(F.expr(f"sequence(0, {draws - 1})")))
    d = d.withColumn("k", multinomial_udf(F.transform("cells", lambda c: c.n), hash32("inst", *[F.col(c) for c in by], F.col("event"), F.col("b"))))
    cells = d.select(*by, "b", F.explode(F.arrays_zip("cells", "k")).alias("z")).select(*by, "b", "z.cells.y_true", "z.cells.pa", "z.cells.pb", F.col("z.k").alias("n")).filter("n > 0")
    pooled = cells.groupBy(*by, "b", "y_true", "pa", "pb").agg(F.sum("n").alias("n"))
    each = pooled.select(*by, "b", "y_true", "n", F.explode(F.array(F.struct(F.lit("a").alias("arm"), F.col("pa").alias("p")), F.struct(F.lit("b").alias("arm"), F.col("pb").alias("p")))).alias("q"))
    zero = F.lit(0).cast("bigint")
    hit = F.col("y_true") == F.col("q.p")
    votes = each.select(*by, "b", "q.arm", F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(~hit, F.col("n")).otherwise(zero).alias("fn")),
        F.struct(F.col("q.p").alias("cls"), zero.alias("tp"), F.when(~hit, F.col("n")).otherwise(zero).alias("fp"), zero.alias("fn")))).alias("c"))
    counts = votes.groupBy(*by, "b", "arm", "c.cls").agg(F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn"))
    f = counts.groupBy(*by, "b", "arm").agg(C.macro("P").alias("f"))
    return f.groupBy(*by, "b").agg((F.max(F.when(F.col("arm") == "a", F.col("f"))) - F.max(F.when(F.col("arm") == "b", F.col("f")))).alias("d"))
