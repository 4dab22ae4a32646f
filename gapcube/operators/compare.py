"""Comparisons between systems, rank agreement and prevalence correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, f1, ratio
from gapcube.operators import cube as C
from gapcube.operators import inference as I
from gapcube.operators.estimands import long_scores
from gapcube.operators.resample import CI, percentiles


def sign(x) -> Column:
    return F.signum(F.round(x, 12))


def rank_agreement(system_scores: DataFrame) -> DataFrame:
    """Kendall's tau between pooled and per-event scores of the systems per label list, with discordant pairs."""
    return I.kendall(long_scores(system_scores, ["system"]), ["conv"], "system", "pooled", "mean").drop("opposite")


def _pairs(long: DataFrame, on: Sequence[str]) -> DataFrame:
    a, b = long.alias("a"), long.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [F.col("a.system") < F.col("b.system")]
    return a.join(b, cond).select(*[F.col(f"a.{k}").alias(k) for k in on], F.col("a.system").alias("i"), F.col("b.system").alias("j"),
                                  (F.col("a.pooled") - F.col("b.pooled")).alias("gp"), (F.col("a.mean") - F.col("b.mean")).alias("ge"))


def paired_bootstrap(point: DataFrame, draws: DataFrame) -> DataFrame:
    """Per pair of systems and label list: gaps, difference of A with its interval, and how often the orders disagree.

    Both inputs are wide score tables; the draws share their events across systems and pair on the draw number.
    """
    p = _pairs(long_scores(point, ["system"]), ["conv"])
    d = _pairs(long_scores(draws, ["b", "system"]), ["b", "conv"]).withColumn("da", F.col("gp") - F.col("ge"))
    share = d.groupBy("conv", "i", "j").agg(F.avg((sign(F.col("gp")) != sign(F.col("ge"))).cast("double")).alias("share_draws_orders_disagree"))
    ci = percentiles(d, ["conv", "i", "j"], ["da"], CI)
    return p.join(share, ["conv", "i", "j"]).join(ci, ["conv", "i", "j"]).select(
        "conv", "i", "j", F.col("gp").alias("gap_pooled"), F.col("ge").alias("gap_per_event"), (F.col("gp") - F.col("ge")).alias("dA"), "da_lo95", "da_hi95",
        "share_draws_orders_disagree", (F.abs(F.col("ge")) < F.abs(F.col("gp") - F.col("ge"))).alias("per_event_gap_below_abs_dA"), (sign(F.col("gp")) != sign(F.col("ge"))).alias("orders_disagree"))


def mixed_summaries(system_scores: DataFrame) -> DataFrame:
    """Pooled score of one system against the per-event mean of another, for pairs whose orders agree."""
    s = system_scores.select("system", F.col("pooled_P").alias("pooled"), F.col("per_event_P").alias("mean"))
    x, y = s.alias("x"), s.alias("y")
    gp, ge = F.col("x.pooled") - F.col("y.pooled"), F.col("x.mean") - F.col("y.mean")
    j = x.join(y, F.col("x.system") != F.col("y.system")).filter(sign(gp) == sign(ge))
    gap = F.col("x.pooled") - F.col("y.mean")
    return j.select(F.col("x.system").alias("pooled_of"), F.col("y.system").alias("per_event_of"), gap.alias("gap"), gp.alias("gap_pooled"), ge.alias("gap_per_event"), (sign(gap) != sign(gp)).alias("reversed"))


def share_f1_spearman(cube: DataFrame) -> DataFrame:
    """Class share in its event against F1 over all present cells, per run; summarised over seeds."""
    cells = C.cell_features(cube).filter("pres > 0").select("system", "seed", (F.col("s") / F.col("n_e")).alias("share"), "f")
    r = I.with_spearman_p(I.spearman(cells, ["system", "seed"], "share", "f"))
    return r.groupBy("system").agg(F.avg("rho").alias("rho_mean"), F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"), F.max("p").alias("max_p"), F.max("n").alias("n_cells"))


def within_class_spearman(cells: DataFrame, by: Sequence[str] = ("system",), y: str = "f1") -> DataFrame:
    """Support against F1 over events, inside each class."""
    return I.spearman(cells, [*by, "cls"], "support", y)


def median_rho(per_class: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    return per_class.groupBy(*by).agg(F.median("rho").alias("median_rho"), F.count("rho").alias("n_classes_defined"))


def within_class_pr_spearman(cube: DataFrame) -> DataFrame:
    """Support against seed-mean precision (never-predicted cells left out) and recall inside each class; at least three cells."""
    said = F.col("tp") + F.col("fp") > 0
    cells = cube.filter("tp + fn > 0").groupBy("system", "event", "cls").agg(
        F.max(F.col("tp") + F.col("fn")).alias("support"), F.avg(F.when(said, ratio("tp", F.col("tp") + F.col("fp")))).alias("precision"), F.avg(ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"))
    out = None
    for name in ("precision", "recall"):
        r = I.spearman(cells.filter(F.col(name).isNotNull()), ["system", "cls"], "support", name)
        r = r.select("system", "cls", F.lit(name).alias("metric"), "n", F.when(F.col("n") >= 3, F.col("rho")).alias("rho"))
        out = r if out is None else out.unionByName(r)
    return out


def prevalence_cells(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prevalence against F1 of present cells, raw and centred within class, and the low-prevalence summary."""
    cells = C.cell_features(cube, keys).filter("pres > 0").select(*keys, "cls", (F.col("s") / F.col("n_e")).alias("prev"), "f", "s")
    cls = Window.partitionBy(*keys, "cls")
    cen = cells.select("*", F.round(F.col("prev") - F.avg("prev").over(cls), 12).alias("pc"), F.round(F.col("f") - F.avg("f").over(cls), 12).alias("fc"))
    raw = I.with_spearman_p(I.spearman(cells, keys, "prev", "f")).withColumnsRenamed({"rho": "spearman", "p": "p"})
    within = I.with_spearman_p(I.spearman(cen, keys, "pc", "fc")).select(*keys, F.col("rho").alias("spearman_within_class"), F.col("p").alias("p_within_class"))
    low = F.col("prev") < 0.05
    med = cells.groupBy(*keys).agg(
        F.avg(low.cast("double")).alias("share_prev_lt_5pct"), F.median(F.when(low, F.col("f"))).alias("median_f1_prev_lt_5pct"),
        F.median(F.when(~low, F.col("f"))).alias("median_f1_prev_ge_5pct"), F.median(F.when(low, F.col("s"))).alias("median_n_prev_lt_5pct"))
    return raw.join(within, list(keys)).join(med, list(keys))


def difficulty_shift(events: DataFrame, hazards: DataFrame) -> DataFrame:
    """How the label list moves the difficulty ranking of events and hazards (held-out scores, seed means)."""
    m = events.groupBy("model", "event").agg(F.avg("f1_D").alias("d"), F.avg("f1_P").alias("p"))
    ranked = m.select("*", F.row_number().over(Window.partitionBy("model").orderBy("d", "event")).alias("rd"), F.row_number().over(Window.partitionBy("model").orderBy("p", "event")).alias("rp"))
    moved = ranked.groupBy("model").agg(F.count(F.when(F.abs(F.col("rd") - F.col("rp")) >= 3, 1)).alias("events_moving_ge3_ranks"),
                                        F.min(F.struct("d", "event")).alias("hd"), F.min(F.struct("p", "event")).alias("hp"), F.count(F.lit(1)).alias("n_events"))
    hz = m.join(hazards, "event").groupBy("model", "hazard").agg(F.avg("d").alias("d"), F.avg("p").alias("p")).groupBy("model").agg(
        F.min(F.struct("d", "hazard")).alias("zd"), F.min(F.struct("p", "hazard")).alias("zp"))
    tau = I.kendall(m, ["model"], "event", "d", "p")
    return tau.join(moved, "model").join(hz, "model").select(
        "model", "tau", "n_events", F.col("opposite").alias("discordant"), "events_moving_ge3_ranks", F.col("hd.event").alias("hardest_D"), F.col("hp.event").alias("hardest_P"),
        F.col("zd.hazard").alias("hardest_hazard_D"), F.col("zp.hazard").alias("hardest_hazard_P"))


def tau_p(events: DataFrame, digits: int = 12) -> DataFrame:
    """(model, n_events, tied, p): significance of Kendall's tau between the difficulty of events under D and P.

    Means are rounded, so values that differ only by the order of a sum are ties. One entry per event meets in a row.
    """
    from gapcube.functions.kernels import kendall_udf
    m = events.groupBy("model", "event").agg(F.round(F.avg("f1_D"), digits).alias("d"), F.round(F.avg("f1_P"), digits).alias("p"))
    lists = m.groupBy("model").agg(F.collect_list("d").alias("d"), F.collect_list("p").alias("p"))
    tied = (F.size(F.array_distinct("d")) < F.size("d")) | (F.size(F.array_distinct("p")) < F.size("p"))
    return lists.select("model", F.size("d").cast("bigint").alias("n_events"), tied.alias("tied"), kendall_udf("d", "p").alias("p"))


def model_difference(contrib: DataFrame, first: str, second: str, level: float = 0.95) -> DataFrame:
    """Paired difference of two models: by event, and by shared seed. `contrib` (model, event, seed, x)."""
    def side(by):
        m = contrib.groupBy("model", by).agg(F.avg("x").alias("x"))
        a, b = m.filter(F.col("model") == first).select(by, F.col("x").alias("xa")), m.filter(F.col("model") == second).select(by, F.col("x").alias("xb"))
        return a.join(b, by).select(F.lit(by).alias("paired_by"), (F.col("xb") - F.col("xa")).alias("x"))
    return I.t_stats(side("event").unionByName(side("seed")), ["paired_by"])


def combined_difference(re: DataFrame, first: str, second: str) -> DataFrame:
    """Difference of two random-effects means with Welch-Satterthwaite degrees of freedom. `re` from random_effects."""
    a = re.filter(F.col("model") == first).select(F.col("mean").alias("m1"), F.col("se").alias("s1"), F.col("df").alias("d1"), F.lit(1).alias("j"))
    b = re.filter(F.col("model") == second).select(F.col("mean").alias("m2"), F.col("se").alias("s2"), F.col("df").alias("d2"), F.lit(1).alias("j"))
    v = F.expr("s1 * s1 + s2 * s2")
    return a.join(b, "j").select((F.col("m2") - F.col("m1")).alias("difference"), F.sqrt(v).alias("se"), (v * v / F.expr("pow(s1, 4) / d1 + pow(s2, 4) / d2")).alias("df"))


def rarest_class(arms: DataFrame, scores: DataFrame) -> DataFrame:
    """Per (model, seed): the class present in the fewest events, its pooled F1 and predictions, and the reweighting term."""
    a = arms.filter("arm = 'a'").groupBy("model", "seed", "cls").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count(F.when(F.col("tp") + F.col("fn") > 0, 1)).alias("n_events")).filter("tp + fn > 0")
    r = a.groupBy("model", "seed").agg(F.min(F.struct("n_events", "cls", "tp", "fp", "fn")).alias("r"))
    out = r.select("model", "seed", F.col("r.cls").alias("cls"), F.col("r.n_events").alias("n_events"), f1(F.col("r.tp"), F.col("r.fp"), F.col("r.fn")).alias("pooled_id_f1"),
                   (F.col("r.tp") + F.col("r.fp")).alias("n_pred"), (F.col("r.tp") + F.col("r.fn")).alias("n_true"))
    return out.join(scores.filter("arm = 'a'").select("model", "seed", "reweighting"), ["model", "seed"]).withColumn("learned", F.col("n_pred") > 0)


def ls_concentration(mc: DataFrame) -> DataFrame:
    """Share of each model's label-list effect carried by the two events with the largest effect over all models."""
    total = mc.groupBy("event").agg(F.sum("mc").alias("t"))
    top = total.withColumn("rk", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("t", 12).desc(), "event"))).filter("rk <= 2").select("event", F.lit(1).alias("top"))
    j = mc.join(top, "event", "left")
    return j.groupBy("model").agg(ratio(F.sum(F.when(F.col("top") == 1, F.col("mc")).otherwise(0.0)), F.sum("mc")).alias("top2_share"),
                                  F.array_join(F.array_sort(F.collect_list(F.when(F.col("top") == 1, F.col("event")))), ",").alias("top2_events"))


def system_ranges(results: DataFrame, columns: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Range over systems of each column, and how many intervals cover zero, are positive or negative."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), (F.max(c) - F.min(c)).alias(f"{c}_spread"), F.count(F.when(F.col(c) < 0, 1)).alias(f"{c}_negative")]
    return results.agg(F.count(F.lit(1)).alias("n_systems"), *aggs, F.count(F.when((F.col(lo) <= 0) & (F.col(hi) >= 0), 1)).alias("ci_covers_zero"),
                       F.count(F.when(F.col(lo) > 0, 1)).alias("ci_positive"), F.count(F.when(F.col(hi) < 0, 1)).alias("ci_negative"))


def deviation_ranges(results: DataFrame, column: str, seeds: str) -> DataFrame:
    """Range of a column and the largest jackknife deviation, over all systems and over those with several seeds."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col(seeds) > 1, "multi_seed")))
    return results.select("*", F.explode(kinds).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_systems"), F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max"),
        (F.max(column) - F.min(column)).alias(f"{column}_spread"), F.max("max_deviation").alias("max_deviation"))


def rare_bands(runs: DataFrame) -> DataFrame:
    """Rare-class F1 against the reweighting term, by F1 band."""
    f = F.col("pooled_id_f1")
    b = F.when(f <= 0, "zero").when(f <= 0.3, "low").when(f <= 0.6, "mid").otherwise("high")
    return runs.groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min(f).alias("f1_min"), F.max(f).alias("f1_max"), F.min("reweighting").alias("rw_min"), F.max("reweighting").alias("rw_max"))
