"""Matched-design estimands: in-distribution against held-out runs on the same messages.

Every run of every model is counted once into the arm cube. An arm is a run restricted to one holdout (a: in-distribution
on R, b: held-out on R, c: held-out on whole events, at/bt on T, ad/atd/af deduplicated, am/bm/cm masked, k/n/kk
chronological, size-matched and diversity-matched, fa/fb/fc the same without a sample cap).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, f1, ratio
from gapcube.operators import cube as C
from gapcube.session import written

ARM = ("model", "seed", "arm")
# which arms a run feeds: on all its items, on R items only, on T items only
ARMS = {"id_random": ("a", None, None), "id_random_dedup": ("ad", None, None), "id_random_fuzzydedup": ("af", None, None),
        "id_random_mask": ("am", None, None), "id_random_full": ("fa", None, None), "id_temporal": ("at", None, None),
        "id_temporal_dedup": ("atd", None, None), "loeo": ("c", "b", "bt"), "loeo_mask": ("cm", "bm", None), "loeo_full": ("fc", "fb", None),
        "chrono": ("k", None, "kT"), "loeon": ("n", None, "nT"), "loeok": ("kk", None, None)}


def arm_cube(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """One cube for all arms from one pass over (model, seed, run, item) predictions with holdout flags."""
    pairs = written(C.pair_counts(runs, ("model", "seed", "run", "in_R", "in_T")), "pairs")
    arms = F.lit(None).cast("array<string>")
    for run, (whole, on_r, on_t) in ARMS.items():
        listed = F.array_compact(F.array(F.lit(whole), F.when(F.col("in_R"), F.lit(on_r)), F.when(F.col("in_T"), F.lit(on_t))))
        arms = F.when(F.col("run") == run, listed).otherwise(arms)
    each = pairs.select("model", "seed", F.explode(arms).alias("arm"), "event", "y_true", "y_pred", "n")
    summed = each.groupBy(*ARM, "event", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    cube = written(C.cube_from_pairs(summed, classes, ARM), "arms")
    # a chronological run at full sample size is compared with the plain held-out run
    on = ["model", "seed", "event"]
    wants = cube.filter("arm = 'k'").select(*on).distinct().join(cube.filter("arm = 'n'").select(*on).distinct(), on, "left_anti")
    stand_in = cube.filter("arm IN ('c', 'bt')").join(wants, on, "left_semi").withColumn("arm", F.when(F.col("arm") == "c", "n").otherwise("nT"))
    return cube.unionByName(stand_in.select(*cube.columns))


def long_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, conv, pooled, per_event) from the wide score table."""
    return scores.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("conv"), F.col(f"pooled_{c}").alias("pooled"), F.col(f"per_event_{c}").alias("mean")) for c in C.CONVENTIONS])).alias("s")).select(*by, "s.*")


def _arm(name: str, what: str) -> Column:
    return F.max(F.when(F.col("arm") == name, F.col(what)))


ESTIMANDS = ("E0", "E1", "E1_heldout", "E2", "E3", "E2p", "E4", "DUP", "DUPT", "DUP_F", "E2_dedup", "MC", "E5", "E5_T", "E5_div", "E5_time", "mean_a", "mean_c", "pooled_id",
             "I_order", "E1_sym", "E2_sym", "E0_mask", "E2_mask", "dE0", "dE2", "heldout_benefit_whole", "heldout_benefit_R", "id_benefit_R", "E0_full", "E1_full", "E2_full", "E3_full")


def estimands(scores: DataFrame, by: Sequence[str] = ("model", "seed")) -> DataFrame:
    """All estimands per (by, label list) from per-arm scores; NULL where an arm is missing."""
    long = long_scores(scores, [*by, "arm"])
    arms = ("a", "b", "c", "at", "bt", "ad", "atd", "af", "am", "bm", "cm", "k", "n", "kT", "nT", "kk", "fa", "fb", "fc")
    mc = scores.filter("arm = 'c'").select(*by, (F.col("per_event_P") - F.col("per_event_D")).alias("MC"))
    w = long.groupBy(*by, "conv").agg(*[_arm(a, "mean").alias(f"m_{a}") for a in arms], *[_arm(a, "pooled").alias(f"p_{a}") for a in ("a", "b", "am", "fa")])
    e = w.join(mc, list(by)).selectExpr(
        *by, "conv", "p_a - m_c AS E0", "p_a - m_a AS E1", "p_b - m_b AS E1_heldout", "m_a - m_b AS E2", "m_b - m_c AS E3", "p_a - p_b AS E2p",
        "m_at - m_bt AS E4", "m_a - m_ad AS DUP", "m_at - m_atd AS DUPT", "m_a - m_af AS DUP_F", "m_ad - m_b AS E2_dedup", "MC",
        "m_n - m_k AS E5", "m_nT - m_kT AS E5_T", "m_n - m_kk AS E5_div", "m_kk - m_k AS E5_time", "m_a AS mean_a", "m_c AS mean_c", "p_a AS pooled_id",
        "(p_a - p_b) - (m_a - m_b) AS I_order", "((p_a - m_a) + (p_b - m_b)) / 2D AS E1_sym", "((m_a - m_b) + (p_a - p_b)) / 2D AS E2_sym",
        "p_am - m_cm AS E0_mask", "m_am - m_bm AS E2_mask", "(p_am - m_cm) - (p_a - m_c) AS dE0", "(m_am - m_bm) - (m_a - m_b) AS dE2",
        "m_cm - m_c AS heldout_benefit_whole", "m_bm - m_b AS heldout_benefit_R", "m_am - m_a AS id_benefit_R",
        "p_fa - m_fc AS E0_full", "p_fa - m_fa AS E1_full", "m_fa - m_fb AS E2_full", "m_fb - m_fc AS E3_full")
    return e


def estimands_of(arms: DataFrame) -> DataFrame:
    """Per (model, seed, label list)."""
    return estimands(C.score_cube(arms, ARM))


def residuals(est: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest deviation of E0 = E1 + E2 + E3, and of E0^D = (E1 + E2 + E3 + MC)^P."""
    three = est.groupBy(*by).agg(F.max(F.abs(F.col("E0") - F.col("E1") - F.col("E2") - F.col("E3"))).alias("three_term_residual"))
    keys = [c for c in ("b", "model", "seed") if c in est.columns]
    p = est.filter("conv = 'P'").select(*keys, (F.col("E1") + F.col("E2") + F.col("E3") + F.col("MC")).alias("four"))
    d = est.filter("conv = 'D'").select(*keys, F.col("E0").alias("e0d"))
    by_run = [k for k in by if k != "conv"]
    four = p.join(d, keys).groupBy(*by_run).agg(F.max(F.abs(F.col("e0d") - F.col("four"))).alias("four_term_residual"))
    return three.join(four, by_run)


HEADLINE = ("share_E2", "share_E2p", "share_E2_sym", "share_E1", "share_MC", "remainder", "remainder_p")


def headline_shares(est: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shares of the composite gap under D carried by components under P, draw by draw."""
    by = list(by)
    p = est.filter("conv = 'P'").select(*by, "E1", "E2", "E2p", "E2_sym", "MC")
    d = est.filter("conv = 'D'").select(*by, F.col("E0").alias("E0D"))
    return p.join(d, by).selectExpr(*by, "E2 / E0D AS share_E2", "E2p / E0D AS share_E2p", "E2_sym / E0D AS share_E2_sym", "E1 / E0D AS share_E1", "MC / E0D AS share_MC",
                                    "E0D - E2 AS remainder", "E0D - E2p AS remainder_p")


def event_table(arms: DataFrame) -> DataFrame:
    """(model, seed, arm, event) with macro-F1 per label list, messages and classes present."""
    return C.event_scores(arms, ARM)


def contributions(events: DataFrame, first: str, second: str, conv: str = "P", name: str = "x") -> DataFrame:
    """Per (model, event, seed): F(first) - F(second), for events that have both arms."""
    on = ["model", "seed", "event"]
    a = events.filter(F.col("arm") == first).select(*on, F.col(f"f1_{conv}").alias("fa"))
    b = events.filter(F.col("arm") == second).select(*on, F.col(f"f1_{conv}").alias("fb"))
    return a.join(b, on).select(*on, (F.col("fa") - F.col("fb")).alias(name))


def metric_convention(events: DataFrame) -> DataFrame:
    """Per (model, event): seed-mean effect of the label list on the held-out score, with classes absent."""
    c = events.filter("arm = 'c'")
    return c.groupBy("model", "event").agg(F.avg(F.col("f1_P") - F.col("f1_D")).alias("mc"), F.max(F.col("n_classes") - F.col("n_present")).alias("n_absent"))


def practices(arms: DataFrame) -> DataFrame:
    """Six ways to compare in-distribution and held-out scores, per (model, seed, label list)."""
    s = long_scores(C.score_cube(arms.filter("arm IN ('a', 'b', 'c')"), ARM), [*ARM])
    w = s.groupBy("model", "seed", "conv").agg(*[_arm(a, k).alias(f"{k[0]}_{a}") for a in "abc" for k in ("pooled", "mean")])
    # pooled in-distribution score on all events but one: totals minus the event's own counts
    a = arms.filter("arm = 'a'")
    whole = Window.partitionBy("model", "seed", "cls")
    rest = a.select("model", "seed", "event", "cls", *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    other = C.macro_f1(rest, ["model", "seed", "event"]).groupBy("model", "seed").agg(*[F.avg(f"f1_{c}").alias(c) for c in C.CONVENTIONS])
    other = other.select("model", "seed", F.explode(F.array(*[F.struct(F.lit(c).alias("conv"), F.col(c).alias("others")) for c in C.CONVENTIONS])).alias("o")).select("model", "seed", "o.*")
    return w.join(other, ["model", "seed", "conv"]).selectExpr(
        "model", "seed", "conv", "m_a - m_b AS matched_event", "p_a - p_b AS matched_pooled", "p_a - p_c AS pooled_vs_pooled_whole", "m_a - m_c AS event_vs_event_whole",
        "others - m_c AS different_events_pooled", "p_a - m_c AS composite")


def per_class_gain(arms: DataFrame) -> DataFrame:
    """Per (model, class): F1(in-distribution) - F1(held-out) on R, seed means averaged over events with the class."""
    on = ["model", "seed", "event", "cls"]
    a = arms.filter("arm = 'a' AND tp + fn > 0").select(*on, f1().alias("fa"))
    b = arms.filter("arm = 'b'").select(*on, f1().alias("fb"))
    ev = a.join(b, on).groupBy("model", "cls", "event").agg(F.avg(F.col("fa") - F.col("fb")).alias("d"))
    return ev.groupBy("model", "cls").agg(F.avg("d").alias("gain_mean"), F.count(F.lit(1)).alias("events_with_class"), F.count(F.when(F.col("d") > 0, 1)).alias("events_positive"))


def run_composition(arms: DataFrame, est: DataFrame, rare: str) -> DataFrame:
    """Per (model, seed): gap terms, whether every class is predicted on R, classes never predicted, rare-class F1."""
    pooled = C.pool(arms.filter("arm = 'a'"), ("model", "seed"))
    said = pooled.groupBy("model", "seed").agg(
        F.bool_and(F.col("tp") + F.col("fp") > 0).alias("predicts_every_class"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("tp") + F.col("fp") == 0, F.col("cls")))), ",").alias("never_predicted"),
        F.max(F.when(F.col("cls") == rare, f1())).alias("rare_pooled_id_f1"))
    p = est.filter("conv = 'P'").select("model", "seed", "E1", "E2", "E3", "MC")
    d = est.filter("conv = 'D'").select("model", "seed", F.col("E0").alias("E0D"))
    return said.join(p, ["model", "seed"]).join(d, ["model", "seed"])


RECIPE_TERMS = ("E0D", "E1", "E2", "E3", "MC")


def recipes_on_shared_seeds(rows: DataFrame, contrib: DataFrame, first: str, second: str) -> DataFrame:
    """Two recipes (models) over the seeds that both have: mean terms of each, and over how many events its mean E2 is
    positive. `rows` (model, seed, terms), one per run; `contrib` (model, event, seed, x)."""
    both = rows.filter(F.col("model").isin(first, second))
    shared = both.groupBy("seed").agg(F.countDistinct("model").alias("k")).filter("k = 2").select("seed")
    terms = both.join(shared, "seed").groupBy("model").agg(F.count(F.lit(1)).alias("n_seeds"), *[F.avg(c).alias(c) for c in RECIPE_TERMS])
    events = contrib.filter(F.col("model").isin(first, second)).join(shared, "seed").groupBy("model", "event").agg(F.avg("x").alias("x"))
    positive = events.groupBy("model").agg(F.count(F.when(F.col("x") > 1e-12, 1)).alias("events_positive"), F.count(F.lit(1)).alias("n_events"), F.avg("x").alias("event_mean"))
    return terms.join(positive, "model")


def incomplete_runs(events: DataFrame, complete: DataFrame, unit: str = "system") -> DataFrame:
    """Each run of an incomplete seed beside the mean and range of complete seeds on that event.

    `events` (unit, seed, event, f1_P); `complete` (unit, seed, complete).
    """
    e = events.join(complete.select(unit, "seed", "complete"), [unit, "seed"])
    ref = e.filter("complete").groupBy(unit, "event").agg(F.avg("f1_P").alias("complete_mean"), F.min("f1_P").alias("complete_min"), F.max("f1_P").alias("complete_max"), F.count(F.lit(1)).alias("complete_seeds"))
    return e.filter("NOT complete").select(unit, "seed", "event", "f1_P").join(ref, [unit, "event"])
