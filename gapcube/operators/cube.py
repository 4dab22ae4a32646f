"""Event-class confusion counts and every macro-F1 summary derived from them.

The rows are reduced once to (keys, event, true, predicted) counts; everything after that works on tables whose size is
systems x seeds x events x classes. Every score and every gap term is a function of additive cell sums, so a point
estimate, a bootstrap draw, a jackknife replicate and a filtered corpus all use the same two functions `class_sums` and
`scores`, with a different weight or grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, f1, ratio

RUN = ("system", "seed")
CONVENTIONS = ("P", "D", "O")
TERMS = ("T1", "T2", "T3", "T4", "T2alt", "T3alt", "T3c", "T4c")


def class_list(meta: DataFrame) -> DataFrame:
    """One row holding the sorted label values of the metadata (the corpus ontology, a short list)."""
    labels = meta.groupBy("label").agg(F.lit(1).alias("one"))
    return labels.agg(F.array_sort(F.collect_list("label")).alias("classes"))


def pair_counts(pred: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Rows per (keys, event, y_true, y_pred): the only shuffle whose input is the prediction rows."""
    return pred.groupBy(*keys, "event", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def cube_from_pairs(pairs: DataFrame, classes: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Dense tp, fp, fn per (keys, event, class). Predictions outside the class list count as misses only."""
    hit = F.array(F.struct(F.col("y_true").alias("cls"), F.col("n").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                           F.lit(0).cast("bigint").alias("fn")))
    zero = F.lit(0).cast("bigint")
    miss = F.array(F.struct(F.col("y_true").alias("cls"), zero.alias("tp"), zero.alias("fp"), F.col("n").alias("fn")),
                   F.struct(F.col("y_pred").alias("cls"), zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn")))
    parts = pairs.select(*keys, "event", F.explode(F.when(F.col("y_true") == F.col("y_pred"), hit).otherwise(miss)).alias("c"))
    blank = (
        pairs.select(*keys, "event").distinct()
        .withColumn("classes", classes.scalar())
        .select(*keys, "event", F.explode("classes").alias("cls"))
        .select(*keys, "event", "cls", zero.alias("tp"), zero.alias("fp"), zero.alias("fn"), F.lit(1).alias("listed"))
    )
    cells = parts.select(*keys, "event", "c.*", F.lit(0).alias("listed")).unionByName(blank)
    return (
        cells.groupBy(*keys, "event", "cls")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.max("listed").alias("listed"))
        .filter("listed = 1").drop("listed")
    )


def confusion_cube(pred: DataFrame, classes: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return cube_from_pairs(pair_counts(pred, keys), classes, keys)


def pool(cube: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Counts summed over events."""
    return cube.groupBy(*keys, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def label_mask(convention: str, tp="tp", fp="fp", fn="fn") -> Column:
    """Which classes a macro average lists: present, present or predicted, or all."""
    if convention == "P":
        return F.col(tp) + F.col(fn) > 0
    if convention == "D":
        return F.col(tp) + F.col(fn) + F.col(fp) > 0
    return F.lit(True)


def cell_metrics(cube: DataFrame, convention: str = "P") -> DataFrame:
    """Support, precision, recall, F1 and label-list flag of every cell (zero where undefined)."""
    return cube.select(
        "*", (F.col("tp") + F.col("fn")).alias("support"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        f1().alias("f1"), label_mask(convention).alias("in_label_list"))


def macro(convention: str) -> Column:
    """Aggregate: mean F1 over the listed classes of a level, 0 where none is listed."""
    listed = label_mask(convention)
    return F.sum(F.when(listed, f1()).otherwise(0.0)) / F.greatest(F.sum(listed.cast("double")), F.lit(1.0))


def macro_f1(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro-F1 of every level under the three label lists."""
    return cells.groupBy(*by).agg(*[macro(c).alias(f"f1_{c}") for c in CONVENTIONS])


def event_scores(cube: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Per event: messages, classes present, classes predicted although absent, macro-F1 per label list."""
    present = F.col("tp") + F.col("fn") > 0
    return cube.groupBy(*keys, "event").agg(
        F.sum(F.col("tp") + F.col("fn")).alias("n"), F.sum(present.cast("bigint")).alias("n_present"),
        F.sum((~present & (F.col("fp") > 0)).cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n_classes"),
        *[macro(c).alias(f"f1_{c}") for c in CONVENTIONS])


def cell_features(cube: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Additive columns from which every summary of `scores` follows."""
    level = Window.partitionBy(*keys, "event")
    s, present = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") > 0
    listed = F.col("tp") + F.col("fn") + F.col("fp") > 0
    base = cube.select(
        *keys, "event", "cls", "tp", "fp", "fn", dbl(s).alias("s"), present.cast("double").alias("pres"),
        f1().alias("f"), F.sum(present.cast("double")).over(level).alias("n_pres"),
        F.sum(listed.cast("double")).over(level).alias("n_listed"), F.count(F.lit(1)).over(level).alias("n_cls"),
        F.sum(dbl(s)).over(level).alias("n_e"), listed.cast("double").alias("lst"))
    return base.select(
        "*", (F.col("f") * F.col("pres") / F.greatest("n_pres", F.lit(1.0))).alias("g_P"),
        (F.col("f") * F.col("lst") / F.greatest("n_listed", F.lit(1.0))).alias("g_D"),
        (F.col("f") / dbl("n_cls")).alias("g_O"),
        ratio("pres", "s").alias("w"), ratio("pres", F.greatest("n_pres", F.lit(1.0))).alias("wc"))


SUMS = {
    "tp": "tp", "fp": "fp", "fn": "fn", "fp_in": "fp * pres", "tp_w": "tp * w", "fp_w": "fp * w", "fn_w": "fn * w",
    "s": "s", "sf": "s * f", "fpres": "f * pres", "npres": "pres", "g_P": "g_P", "g_D": "g_D", "g_O": "g_O", "wc": "wc",
    "ng": "n_e * g_P",
}


def class_sums(features: DataFrame, by: Sequence[str], weight: str = "1.0D") -> DataFrame:
    """Weighted sums over events per (by, class); `weight` is the multiplicity of the event in a draw."""
    return features.groupBy(*by, "cls").agg(
        F.sum(F.expr(weight)).alias("n_events"),
        *[F.sum(F.expr(f"({weight}) * ({e})")).alias(k) for k, e in SUMS.items()])


def scores(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """All summaries per group of `by`.

    pooled_*, per_event_*, A_* under the label lists; T1..T4 with both alternate orders; W + N (size weighting);
    scoring + reweighting. Classes of the pool are those with support in a drawn event.
    """
    keep = F.col("s") > 0

    def over(expr):  # mean over classes of the pool
        return F.avg(F.when(keep, expr))

    f_all, f_in, f_eq = f1("tp", "fp", "fn"), f1("tp", "fp_in", "fn"), f1("tp_w", "fp_w", "fn_w")
    swm = F.col("sf") / F.greatest("s", F.lit(1.0))
    eqm = F.col("fpres") / F.greatest("npres", F.lit(1.0))
    w_class = F.col("wc") / F.col("n_events")
    f_bar = ratio("g_P", "wc")
    agg = sums.groupBy(*by).agg(
        F.max("n_events").alias("n_events"), F.count(F.when(keep, 1)).alias("n_pool_classes"),
        F.count(F.lit(1)).alias("n_classes"), F.sum("s").alias("n_messages"),
        *[macro(c).alias(f"pooled_{c}") for c in CONVENTIONS],
        *[(F.sum(f"g_{c}") / F.max("n_events")).alias(f"per_event_{c}") for c in CONVENTIONS],
        over(f_all).alias("m_all"), over(f_in).alias("m_in"), over(f_eq).alias("m_eq"), over(swm).alias("m_swm"),
        over(eqm).alias("m_eqm"), F.sum(F.when(keep, w_class * swm)).alias("m_comp"),
        (F.sum("ng") / F.sum("s")).alias("m_sized"), over(f_all - f_bar).alias("scoring"),
        over(f_bar).alias("m_fbar"), F.sum(F.when(keep, w_class * f_bar)).alias("m_wfbar"))
    f_e = F.col("per_event_P")
    return agg.select(
        *by, "n_events", "n_pool_classes", "n_classes", "n_messages",
        *[F.col(f"pooled_{c}") for c in CONVENTIONS], *[F.col(f"per_event_{c}") for c in CONVENTIONS],
        *[(F.col(f"pooled_{c}") - F.col(f"per_event_{c}")).alias(f"A_{c}") for c in CONVENTIONS],
        (F.col("m_all") - F.col("m_in")).alias("T1"), (F.col("m_in") - F.col("m_swm")).alias("T2"),
        (F.col("m_swm") - F.col("m_eqm")).alias("T3"), (F.col("m_eqm") - f_e).alias("T4"),
        (F.col("m_eq") - F.col("m_eqm")).alias("T2alt"), (F.col("m_in") - F.col("m_eq")).alias("T3alt"),
        (F.col("m_comp") - f_e).alias("T3c"), (F.col("m_swm") - F.col("m_comp")).alias("T4c"),
        (F.col("m_sized") - f_e).alias("W"), (F.col("pooled_P") - F.col("m_sized")).alias("N"),
        "scoring", (F.col("m_fbar") - F.col("m_wfbar")).alias("reweighting"))


def score_cube(cube: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Point estimates: every event once."""
    return scores(class_sums(cell_features(cube, keys), keys), keys)


def seed_mean(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Average over seeds, after the non-linear metric."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def system_scores(cube: DataFrame) -> DataFrame:
    """Seed-mean pooled and per-event scores, A and terms of every system."""
    per_seed = score_cube(cube)
    names = [f"{p}_{c}" for p in ("pooled", "per_event", "A") for c in CONVENTIONS]
    return seed_mean(per_seed, ["system"], names + list(TERMS) + ["W", "N", "scoring", "reweighting"])
