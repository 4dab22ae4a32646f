"""Closed forms and splits of the gap between the pooled score and the per-event mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcube.functions.columns import dbl, ratio
from gapcube.operators import cube as C


def closed_forms(cube: DataFrame) -> DataFrame:
    """Per system: deviation of F^O = (c/C) F^P and F^D = c/(c+k) F^P, the two label-list shifts, and k summaries."""
    ev = C.event_scores(cube)
    share, listed = dbl("n_present") / dbl("n_classes"), dbl("n_present") + dbl("k")
    dev = F.greatest(F.abs(F.col("f1_O") - share * F.col("f1_P")), F.abs(F.col("f1_D") - ratio("n_present", listed) * F.col("f1_P")))
    per_seed = ev.groupBy("system", "seed").agg(
        F.max(dev).alias("dev_event"), F.avg((1.0 - share) * F.col("f1_P")).alias("shift_O"),
        F.avg(ratio("k", listed) * F.col("f1_P")).alias("shift_D"), F.avg(dbl("k")).alias("k_mean"), F.max("k").alias("k_max"),
        F.avg((F.col("k") > 0).cast("double")).alias("k_pos"))
    a = C.score_cube(cube).select("system", "seed", "A_P", "A_D", "A_O", "pooled_P", "pooled_D", "pooled_O", "n_pool_classes", "n_classes")
    j = per_seed.join(a, ["system", "seed"]).groupBy("system").agg(
        F.max("dev_event").alias("max_abs_dev_event"), F.avg("shift_O").alias("shift_O"), F.avg("shift_D").alias("shift_D"),
        F.avg("A_P").alias("A_P"), F.avg("A_D").alias("A_D"), F.avg("A_O").alias("A_O"), F.avg("k_mean").alias("k_mean"),
        F.max("k_max").alias("k_max"), F.avg("k_pos").alias("share_events_k_pos"),
        F.min((F.col("n_pool_classes") == F.col("n_classes")).cast("int")).alias("every"),
        F.max(F.greatest(F.abs(F.col("pooled_P") - F.col("pooled_D")), F.abs(F.col("pooled_P") - F.col("pooled_O")))).alias("pool_diff"))
    return j.select(
        "system", "max_abs_dev_event",
        F.greatest(F.abs(F.col("A_O") - F.col("A_P") - F.col("shift_O")), F.abs(F.col("A_D") - F.col("A_P") - F.col("shift_D"))).alias("max_abs_dev_A"),
        (F.col("every") == 1).alias("pooled_has_every_class"), (F.col("pool_diff") < 1e-8).alias("pooled_equal_across_conventions"),
        "shift_O", "shift_D", "k_mean", "k_max", "share_events_k_pos")


def perfect_a_o(meta: DataFrame) -> DataFrame:
    """Gap of a classifier without errors when every class is listed: 1 - mean share of classes present."""
    cells = meta.groupBy("event", "label").agg(F.count(F.lit(1)).alias("n"))
    n_all = cells.agg(F.countDistinct("label").alias("c"))
    return cells.groupBy("event").agg(F.count(F.lit(1)).alias("present")).withColumn("c", n_all.scalar()).agg(
        F.avg(1.0 - dbl("present") / dbl("c")).alias("perfect_A_O"), F.count(F.lit(1)).alias("n_events"))


def nan_macro(cube: DataFrame) -> DataFrame:
    """Macro over all classes with undefined F1 left out, beside label list D: the largest difference per run."""
    from gapcube.functions.columns import f1
    defined = F.col("tp") + F.col("fp") + F.col("fn") > 0
    ev = cube.groupBy("system", "seed", "event").agg(F.avg(F.when(defined, f1())).alias("nan_macro"), C.macro("D").alias("f1_D"))
    return ev.groupBy("system", "seed").agg(F.max(F.abs(F.col("nan_macro") - F.col("f1_D"))).alias("max_abs_diff"), F.count(F.lit(1)).alias("n_events"))


def pool_coverage(cube: DataFrame) -> DataFrame:
    """Whether a run's pool has every class, and whether the pooled score is the same under every label list."""
    s = C.score_cube(cube)
    return s.select("system", "seed", "n_classes", (F.col("n_pool_classes") == F.col("n_classes")).alias("pool_has_every_class"),
                    ((F.abs(F.col("pooled_P") - F.col("pooled_D")) < 1e-8) & (F.abs(F.col("pooled_P") - F.col("pooled_O")) < 1e-8)).alias("pooled_equal"))


def class_recall(cube: DataFrame) -> DataFrame:
    """Per class: recall and F1 pooled over events and as event means, false alarms where the class is absent."""
    from gapcube.functions.columns import f1
    present = F.col("tp") + F.col("fn") > 0
    per_seed = cube.groupBy("system", "seed", "cls").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg(F.when(present, ratio("tp", F.col("tp") + F.col("fn")))).alias("recall_event_mean"),
        F.avg(F.when(present, f1())).alias("f1_event_mean"),
        F.coalesce(F.sum(F.when(~present, F.col("fp"))), F.lit(0)).alias("false_alarms"),
        F.count(F.when(present, 1)).alias("events_present"), F.count(F.when(~present, 1)).alias("events_absent"))
    return per_seed.groupBy("system", "cls").agg(
        F.avg(ratio("tp", F.col("tp") + F.col("fn"))).alias("recall_pooled"), F.avg("recall_event_mean").alias("recall_event_mean"),
        F.avg(f1()).alias("f1_pooled"), F.avg("f1_event_mean").alias("f1_event_mean"), F.avg(dbl("false_alarms")).alias("false_alarms_absent_events"),
        F.max("events_present").alias("events_present"), F.max("events_absent").alias("events_absent"),
        F.max(F.col("tp") + F.col("fn")).alias("support"))


def per_class_record(arms: DataFrame) -> DataFrame:
    """Per model and class: truth, in-distribution and held-out F1 and predictions on the same items; seed means."""
    from gapcube.functions.columns import f1
    p = arms.filter(F.col("arm").isin("a", "b")).groupBy("model", "seed", "arm", "cls").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count(F.when(F.col("tp") + F.col("fn") > 0, 1)).alias("n_events"))
    side = p.select("model", "seed", "arm", "cls", "n_events", (F.col("tp") + F.col("fn")).alias("n_true"), f1().alias("f"),
                    (F.col("tp") + F.col("fp")).alias("n_pred"))
    a = F.col("arm") == "a"
    wide = side.groupBy("model", "seed", "cls").agg(
        F.max(F.when(a, F.col("n_events"))).alias("n_events"), F.max(F.when(a, F.col("n_true"))).alias("n_true"),
        F.max(F.when(a, F.col("f"))).alias("id_f1"), F.max(F.when(a, F.col("n_pred"))).alias("id_n_pred"),
        F.max(F.when(~a, F.col("f"))).alias("heldout_f1"), F.max(F.when(~a, F.col("n_pred"))).alias("heldout_n_pred"))
    return wide.filter("n_true > 0").groupBy("model", "cls").agg(
        F.max("n_events").alias("n_events"), F.avg(dbl("n_true")).alias("n_true"), F.avg("id_f1").alias("id_f1"),
        F.avg(dbl("id_n_pred")).alias("id_n_pred"), F.avg("heldout_f1").alias("heldout_f1"), F.avg(dbl("heldout_n_pred")).alias("heldout_n_pred"),
        F.count(F.when(F.col("id_n_pred") == 0, 1)).alias("n_seeds_no_pred"), F.count(F.lit(1)).alias("n_seeds"))


def max_abs_diff(a: DataFrame, b: DataFrame, on, columns) -> DataFrame:
    """Largest difference between two sets of scores and how many were compared."""
    j = a.alias("a").join(b.alias("b"), on)
    diffs = F.array(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns])
    return j.agg(F.max(F.array_max(diffs)).alias("max_abs_diff"), (F.count(F.lit(1)) * len(columns)).alias("n_scores"))
