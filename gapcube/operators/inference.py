"""Intervals, tests and decisions on event-by-seed tables of contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl
from gapcube.functions.kernels import (norm_cdf_udf, norm_ppf_udf, t_cdf_udf, t_ppf_udf, t_sf2_udf, wilcoxon_udf)


def event_means(table: DataFrame, by: Sequence[str], column: str = "x") -> DataFrame:
    """Seed-averaged contribution of every event (missing values left out)."""
    return table.groupBy(*by, "event").agg(F.avg(column).alias(column))


def t_stats(x: DataFrame, by: Sequence[str], column: str = "x") -> DataFrame:
    """n, mean and standard error of the non-missing values."""
    return x.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")).select(
        *by, "n", "mean", (F.col("sd") / F.sqrt(dbl("n"))).alias("se"))


def t_interval(x: DataFrame, by: Sequence[str], column: str = "x", levels: Sequence[float] = (0.95, 0.90)) -> DataFrame:
    """t intervals; NULL with fewer than two values."""
    s = t_stats(x, by, column)
    ok = F.col("n") >= 2
    out = []
    for lv in levels:
        h = t_ppf_udf(F.lit(0.5 + lv / 2), F.when(ok, dbl("n") - 1.0)) * F.col("se")
        p = int(round(lv * 100))
        out += [F.when(ok, F.col("mean") - h).alias(f"lo{p}"), F.when(ok, F.col("mean") + h).alias(f"hi{p}")]
    return s.select("*", *out)


def t_test(x: DataFrame, by: Sequence[str], column: str = "x", margin: float = 0.02) -> DataFrame:
    """Two-sided p-value against zero and the larger one-sided p-value of the equivalence test at the margin."""
    s = t_stats(x, by, column).withColumn("df", dbl("n") - 1.0)
    above = 1.0 - t_cdf_udf((F.col("mean") + F.lit(margin)) / F.col("se"), F.col("df"))
    below = t_cdf_udf((F.col("mean") - F.lit(margin)) / F.col("se"), F.col("df"))
    return s.select(*by, "n", "mean", "se", t_sf2_udf(F.col("mean") / F.col("se"), F.col("df")).alias("p"), F.greatest(above, below).alias("p_tost"))


def holm(tests: DataFrame, p: str = "p", tie: str = "test", by: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values over a family of tests."""
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ordered = family.orderBy(p, tie)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(ordered) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn(
        "p_holm", F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def random_effects(table: DataFrame, by: Sequence[str], column: str = "x") -> DataFrame:
    """Crossed events x seeds mean squares, variances of the grand mean and Satterthwaite degrees of freedom."""
    g = Window.partitionBy(*by)
    ge, gs = Window.partitionBy(*by, "event"), Window.partitionBy(*by, "seed")
    y = F.col(column)
    c = table.select(*by, "event", "seed", y.alias("y"), F.avg(y).over(g).alias("m"), F.avg(y).over(ge).alias("me"), F.avg(y).over(gs).alias("ms"))
    a = c.groupBy(*by).agg(
        F.countDistinct("event").cast("double").alias("E"), F.countDistinct("seed").cast("double").alias("S"), F.max("m").alias("mean"),
        F.sum(F.pow(F.col("me") - F.col("m"), 2)).alias("sse"), F.sum(F.pow(F.col("ms") - F.col("m"), 2)).alias("sss"),
        F.sum(F.pow(F.col("y") - F.col("me") - F.col("ms") + F.col("m"), 2)).alias("ssr"))
    # sums run over all cells, so they already carry the factors S and E
    many = F.col("S") >= 2
    q = a.select(*by, "E", "S", "mean", (F.col("sse") / (F.col("E") - 1)).alias("mse"),
                 F.when(many, F.col("sss") / (F.col("S") - 1)).alias("mss"),
                 F.when(many, F.col("ssr") / ((F.col("E") - 1) * (F.col("S") - 1))).alias("msr"))
    n, e1, s1 = F.col("E") * F.col("S"), F.col("E") - 1, F.col("S") - 1
    num = F.col("mse") + F.col("mss") - F.col("msr")
    plain_v, plain_df = F.col("mse") / n, e1
    v = F.when(many, (F.col("mse") + F.col("mss")) / n).otherwise(plain_v)
    df = F.when(many, F.pow(F.col("mse") + F.col("mss"), 2) / (F.pow("mse", F.lit(2)) / e1 + F.pow("mss", F.lit(2)) / s1)).otherwise(plain_df)
    fuller = many & (num > F.col("mse"))
    vu = F.when(fuller, num / n).otherwise(plain_v)
    dfu = F.when(fuller, F.pow(num, 2) / (F.pow("mse", F.lit(2)) / e1 + F.pow("mss", F.lit(2)) / s1 + F.pow("msr", F.lit(2)) / (e1 * s1))).otherwise(plain_df)
    return q.select(*by, "E", "S", "mean", "mse", "mss", "msr", F.sqrt(plain_v).alias("se_events_only"), F.sqrt(v).alias("se"), df.alias("df"),
                    F.sqrt(vu).alias("se_unbiased"), dfu.alias("df_unbiased"))


def random_effects_interval(table: DataFrame, by: Sequence[str], column: str = "x", level: float = 0.95) -> DataFrame:
    r = random_effects(table, by, column)
    h, hu = t_ppf_udf(F.lit(0.5 + level / 2), "df") * F.col("se"), t_ppf_udf(F.lit(0.5 + level / 2), "df_unbiased") * F.col("se_unbiased")
    return r.select(*by, "mean", "se", "df", (F.col("mean") - h).alias("lo"), (F.col("mean") + h).alias("hi"),
                    "se_unbiased", "df_unbiased", (F.col("mean") - hu).alias("lo_unbiased"), (F.col("mean") + hu).alias("hi_unbiased"))


def wilcoxon(x: DataFrame, by: Sequence[str], column: str = "x") -> DataFrame:
    """Signed-rank statistic and p-value of event contributions (one value per event, a short list per group)."""
    group = Window.partitionBy(*by)
    nonzero = x.filter(F.col(column) != 0).withColumn("size", F.abs(column))
    ranked = nonzero.withColumn("rk", average_rank(F.col("size"), by))
    w = ranked.groupBy(*by).agg(F.sum(F.when(F.col(column) > 0, F.col("rk")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n"))
    p = x.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias("v")).select(*by, wilcoxon_udf("v").alias("p"))
    return w.join(p, list(by))


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Rank with ties averaged inside each group."""
    order = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group with its t-based p-value; undefined where a column is constant."""
    ranked = df.select(*by, average_rank(F.col(x), by).alias("rx"), average_rank(F.col(y), by).alias("ry"))
    a = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("r"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    defined = (F.col("n") >= 2) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return a.select(*by, "n", F.when(defined, F.col("r")).alias("rho"))


def with_spearman_p(df: DataFrame) -> DataFrame:
    t = F.col("rho") * F.sqrt((dbl("n") - 2.0) / F.greatest(1.0 - F.col("rho") * F.col("rho"), F.lit(1e-300)))
    return df.withColumn("p", t_sf2_udf(t, dbl("n") - 2.0))


def kendall(df: DataFrame, by: Sequence[str], name: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b over pairs of named rows (systems or events, a short list), with the discordant pairs counted."""
    a, b = df.alias("a"), df.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by] + [F.col(f"a.{name}") < F.col(f"b.{name}")]
    pairs = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col(f"a.{name}").alias("i"), F.col(f"b.{name}").alias("j"),
                                 F.signum(F.round(F.col(f"a.{x}") - F.col(f"b.{x}"), 12)).alias("dx"), F.signum(F.round(F.col(f"a.{y}") - F.col(f"b.{y}"), 12)).alias("dy"))
    return pairs.groupBy(*by).agg(
        (F.sum(F.col("dx") * F.col("dy")) / F.sqrt(F.sum(F.abs("dx")) * F.sum(F.abs("dy")))).alias("tau"), F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(F.col("dx") * F.col("dy") < 0, 1)).alias("opposite"),
        F.count(F.when(F.col("dx") != F.col("dy"), 1)).alias("discordant"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("dx") != F.col("dy"), F.concat("i", F.lit("~"), "j")))), ",").alias("discordant_pairs"))


def decide(intervals: DataFrame, margins: Sequence[float] = (0.01, 0.02, 0.03)) -> DataFrame:
    """Material-positive and equivalent-within flags at every margin. Needs mean, lo95, lo90, hi90."""
    m = F.col("margin")
    return intervals.select("*", F.explode(F.array(*map(F.lit, margins))).alias("margin")).select(
        "*", ((F.col("lo95") > 0) & (F.col("mean") >= m)).alias("material_positive"),
        ((F.col("lo90") > -m) & (F.col("hi90") < m)).alias("equivalent_within"), (F.col("lo95") >= m).alias("material_on_lower_bound"))


def bca(draws: DataFrame, point: DataFrame, jack: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Bootstrap bias and bias-corrected accelerated interval.

    `draws` (by, b, column), `point` (by, column), `jack` (by, left_out, column). The interval endpoints are percentiles at
    data-dependent levels, interpolated between the two neighbouring order statistics.
    """
    by = list(by)
    j = draws.join(point.select(*by, F.col(column).alias("theta")), by)
    s = j.groupBy(*by, "theta").agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("boot_mean"), F.median(column).alias("boot_median"),
        (F.avg((F.col(column) < F.col("theta")).cast("double")) + 0.5 * F.avg((F.col(column) == F.col("theta")).cast("double"))).alias("share"),
        F.sort_array(F.collect_list(column)).alias("v"))  # one double per draw: the number of draws is a parameter
    centred = jack.join(jack.groupBy(*by).agg(F.avg(column).alias("jm")), by).withColumn("d", F.col("jm") - F.col(column))
    acc = centred.groupBy(*by).agg(F.sum(F.pow("d", F.lit(3))).alias("c3"), F.sum(F.pow("d", F.lit(2))).alias("c2")).select(
        *by, F.when(F.col("c2") > 0, F.col("c3") / (6 * F.pow("c2", F.lit(1.5)))).otherwise(0.0).alias("acceleration"))
    edge = 1.0 / (dbl("n") + 1.0)
    z = s.join(acc, by).withColumn("z0", norm_ppf_udf(F.greatest(edge, F.least(dbl("n") * edge, F.col("share")))))
    for name, alpha in (("lo", 0.025), ("hi", 0.975)):
        za = F.col("z0") + norm_ppf_udf(F.lit(alpha))
        z = z.withColumn("_h", (dbl("n") - 1.0) * norm_cdf_udf(F.col("z0") + za / (1.0 - F.col("acceleration") * za)))
        lower = F.floor("_h").cast("int")
        a, b = F.element_at("v", lower + 1), F.element_at("v", F.least(lower + 2, F.col("n").cast("int")))
        z = z.withColumn(f"bca_{name}", a + (b - a) * (F.col("_h") - F.floor("_h")))
    return z.select(*by, F.col("theta").alias(column), "boot_mean", "boot_median", (F.col("boot_mean") - F.col("theta")).alias("bias"), "z0", "acceleration", "bca_lo", "bca_hi")


def seed_spread(per_seed: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, standard deviation and range over seeds."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), (F.max(c) - F.min(c)).alias(f"{c}_range")]
    return per_seed.groupBy(*by).agg(*aggs)


def repeat_variance(repeats: DataFrame, seeds: DataFrame, original: str) -> DataFrame:
    """Spread of repeated runs of one seed beside the spread over seeds.

    `repeats` (label, event, f_id, f_held, e2, sample); `seeds` (seed, event, f_held, e2).
    """
    def spread(df, key, tag):
        per_run = df.groupBy(key).agg(F.avg("e2").alias("m")).agg(F.stddev_samp("m").alias(f"sd_e2_{tag}"), F.min("m").alias(f"min_e2_{tag}"), F.max("m").alias(f"max_e2_{tag}"))
        names = [c for c in ("e2", "f_id", "f_held") if c in df.columns]
        per_event = df.groupBy("event").agg(*[F.stddev_samp(c).alias(c) for c in names]).agg(*[F.avg(c).alias(f"mean_sd_event_{c}_{tag}") for c in names])
        return per_run, per_event
    first = repeats.filter(F.col("label") == original).select("event", F.col("f_id").alias("i0"), F.col("f_held").alias("h0"))
    far = repeats.join(first, "event").agg(
        F.max(F.greatest(F.abs(F.col("f_id") - F.col("i0")), F.abs(F.col("f_held") - F.col("h0")))).alias("max_abs_event_f_diff"),
        (F.countDistinct("sample") == 1).alias("same_training_sample"), F.countDistinct("label").alias("n_replicates"))
    one = F.lit(1).alias("_one")
    out = far.select("*", one)
    for part in (*spread(repeats, "label", "repeats"), *spread(seeds, "seed", "seeds")):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")
