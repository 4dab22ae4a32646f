"""Queries of the matched-design estimands, inference and system comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapcube.functions.columns import rounded
from gapcube.operators import compare as K
from gapcube.operators import cube as C
from gapcube.operators import estimands as E
from gapcube.operators import filters as FL
from gapcube.operators import inference as I
from gapcube.operators import nullmodel as NM
from gapcube.operators import resample as R
from gapcube.operators import splits as SP
from gapcube.plans import sqlparts as S
from gapcube.plans.core_queries import (B, BOOT, CELLS, JACK, SCORED, WITH, boot_sql, ci_sql, cols, draws)
from gapcube.plans.fixtures import CAP, CUBE, H, RUNS_SQL, cube_sql
from gapcube.plans.registry import query

ARM_ROWS = f"""ar AS MATERIALIZED (
  SELECT model, seed, unnest(CASE run WHEN 'id_random' THEN ['a'] WHEN 'id_random_dedup' THEN ['ad'] WHEN 'id_random_fuzzydedup' THEN ['af'] WHEN 'id_random_mask' THEN ['am']
    WHEN 'id_random_full' THEN ['fa'] WHEN 'id_temporal' THEN ['at'] WHEN 'id_temporal_dedup' THEN ['atd']
    WHEN 'loeo' THEN list_filter(['c', CASE WHEN in_R THEN 'b' END, CASE WHEN in_T THEN 'bt' END], lambda x: x IS NOT NULL)
    WHEN 'loeo_mask' THEN list_filter(['cm', CASE WHEN in_R THEN 'bm' END], lambda x: x IS NOT NULL) WHEN 'loeo_full' THEN list_filter(['fc', CASE WHEN in_R THEN 'fb' END], lambda x: x IS NOT NULL)
    WHEN 'chrono' THEN list_filter(['k', CASE WHEN in_T THEN 'kT' END], lambda x: x IS NOT NULL) WHEN 'loeon' THEN list_filter(['n', CASE WHEN in_T THEN 'nT' END], lambda x: x IS NOT NULL)
    WHEN 'loeok' THEN ['kk'] END) AS arm, event, y_true, y_pred FROM runs
  UNION ALL SELECT model, seed, unnest(list_filter(['n', CASE WHEN in_T THEN 'nT' END], lambda x: x IS NOT NULL)), event, y_true, y_pred
  FROM runs WHERE run = 'loeo' AND event IN (SELECT event FROM pools WHERE chrono_pool_n >= {CAP}))"""
ARMS = "WITH " + RUNS_SQL + ",\n" + ARM_ROWS + ",\n" + cube_sql("arms", "ar", "eclasses", "model, seed, arm")
ARM_SC = ARMS + ",\n" + S.level_scores("asc_", "arms", "model, seed, arm")


def estimand_sql(name, src, by):
    arms = "a b c at bt ad atd af am bm cm k n kT nT kk fa fb fc".split()
    long = " UNION ALL ".join(f"SELECT {by}, arm, '{c}' AS conv, pooled_{c} AS po, per_event_{c} AS pe FROM {src}" for c in "PDO")
    w = ", ".join([f"max(pe) FILTER (arm='{a}') AS m_{a}" for a in arms] + [f"max(po) FILTER (arm='{a}') AS p_{a}" for a in ("a", "b", "am", "fa")])
    return f"""{name} AS MATERIALIZED (SELECT {by}, conv, p_a-m_c AS E0, p_a-m_a AS E1, p_b-m_b AS E1_heldout, m_a-m_b AS E2, m_b-m_c AS E3, p_a-p_b AS E2p, m_at-m_bt AS E4, m_a-m_ad AS DUP,
  m_at-m_atd AS DUPT, m_a-m_af AS DUP_F, m_ad-m_b AS E2_dedup, MC, m_n-m_k AS E5, m_nT-m_kT AS E5_T, m_n-m_kk AS E5_div, m_kk-m_k AS E5_time, m_a AS mean_a, m_c AS mean_c, p_a AS pooled_id,
  p_a-p_b-m_a+m_b AS I_order, (p_a-m_a+p_b-m_b)/2 AS E1_sym, (m_a-m_b+p_a-p_b)/2 AS E2_sym, p_am-m_cm AS E0_mask, m_am-m_bm AS E2_mask, p_am-m_cm-p_a+m_c AS dE0, m_am-m_bm-m_a+m_b AS dE2,
  m_cm-m_c AS heldout_benefit_whole, m_bm-m_b AS heldout_benefit_R, m_am-m_a AS id_benefit_R, p_fa-m_fc AS E0_full, p_fa-m_fa AS E1_full, m_fa-m_fb AS E2_full, m_fb-m_fc AS E3_full
  FROM (SELECT {by}, conv, {w} FROM ({long}) GROUP BY {by}, conv) JOIN (SELECT {by}, per_event_P-per_event_D AS MC FROM {src} WHERE arm='c') USING ({by}))"""


EST = ARM_SC + ",\n" + estimand_sql("es", "asc_", "model, seed")
MEANS = ["E0", "E1", "E2", "E3", "E2p", "MC"]
CONTRIB = ARM_SC + """, xe AS MATERIALIZED (SELECT a.model, a.seed, a.event, a.f1_P-b.f1_P AS x FROM asc__ev a JOIN asc__ev b USING (model, seed, event) WHERE a.arm='{0}' AND b.arm='{1}'), xm AS (SELECT model, event, avg(x) AS x FROM xe GROUP BY ALL)"""
X_AB = CONTRIB.format("a", "b")
# Student t quantiles for 29 degrees of freedom (30 events), two-sided 95 and 90 percent: fixed values
T95, T90 = 2.045229642132703, 1.6991270265334972


def t_tail(t, df, n=2000):
    """Two-sided tail of Student's t in SQL: Simpson's rule on atan(|t|/sqrt(df)) .. pi/2."""
    a, h = f"atan(abs({t})/sqrt({df}))", f"((pi()/2-atan(abs({t})/sqrt({df})))/{n})"
    y = f"pow(greatest(cos({a}+i*{h}),0), {df}-1)"
    return (f"least(1.0, 2*exp(lgamma(({df}+1)/2.0)-lgamma({df}/2.0))/sqrt(pi())*{h}/3*list_sum(list_transform(range({n}+1), lambda i: "
            f"(CASE WHEN i=0 OR i={n} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*{y})))")


def events_of(fx):
    return E.event_table(fx.arms)


def contrib(fx, a="a", b="b", conv="P"):
    return E.contributions(events_of(fx), a, b, conv)


# ---------------------------------------------------------------- ES: estimands
@query("ES1_arm_cube", ARMS + " SELECT model, seed, arm, event, cls, tp, fp, fn FROM arms")
def _(fx):
    return E.arm_cube(fx.run_rows, fx.eclasses)


@query("ES2_estimands", EST + f" SELECT model, conv, {cols(['E0', 'E1', 'E2', 'E3', 'E2p', 'E4', 'mean_a', 'mean_c', 'pooled_id'], 'avg({})')} FROM es GROUP BY model, conv")
def _(fx):
    return rounded(C.seed_mean(E.estimands_of(fx.arms), ["model", "conv"], ["E0", "E1", "E2", "E3", "E2p", "E4", "mean_a", "mean_c", "pooled_id"]))


MC_SQL = ARM_SC + ", mc AS (SELECT model, event, avg(f1_P-f1_D) AS mc, max(n_classes-n_present) AS n_absent FROM asc__ev WHERE arm='c' GROUP BY ALL)"


@query("ES3_metric_convention", MC_SQL + ", " + estimand_sql("es", "asc_", "model, seed") + f""", e AS (SELECT model, avg(E0) AS e0 FROM es WHERE conv='D' GROUP BY model)
 SELECT model, {S.r('avg(mc)', 'MC')}, count(*) FILTER (mc>1e-12) AS events_affected, {S.r('avg(mc)/max(e0)', 'share_of_E0D')} FROM mc JOIN e USING (model) GROUP BY model""")
def _(fx):
    mc = E.metric_convention(events_of(fx)).groupBy("model").agg(F.avg("mc").alias("MC"), F.count(F.when(F.col("mc") > 1e-12, 1)).alias("events_affected"))
    e0 = E.estimands_of(fx.arms).filter("conv = 'D'").groupBy("model").agg(F.avg("E0").alias("e0"))
    return rounded(mc.join(e0, "model").select("model", "MC", "events_affected", (F.col("MC") / F.col("e0")).alias("share_of_E0D")))


@query("ES3_convention_by_absent_classes", MC_SQL + f" SELECT model, n_absent, {S.r('avg(mc)', 'mc_mean')}, count(*) AS n_events FROM mc GROUP BY ALL")
def _(fx):
    return rounded(E.metric_convention(events_of(fx)).groupBy("model", "n_absent").agg(F.avg("mc").alias("mc_mean"), F.count(F.lit(1)).alias("n_events")))


E5 = ["E5", "E5_T", "E5_div", "E5_time"]


@query("ES4_chrono_contrast", EST + f" SELECT model, conv, {cols(E5, 'avg({})')} FROM es GROUP BY model, conv")
def _(fx):
    return rounded(C.seed_mean(E.estimands_of(fx.arms), ["model", "conv"], E5))


@query("ES4_chrono_by_future_share", CONTRIB.format("n", "k") + f""", fs AS (SELECT event, 1-chrono_pool_n/(sum(n) OVER ()-n)::DOUBLE AS s FROM pools),
 g AS (SELECT xm.*, s, CASE WHEN s>=0.25 THEN 'ge_0.25' WHEN s<0.05 THEN 'lt_0.05' ELSE 'between' END AS future FROM xm JOIN fs USING (event))
 SELECT model, future, count(*) AS n_events, {S.r('avg(x)', 'e5_mean')}, {S.r('avg(s)', 'future_share_mean')} FROM g GROUP BY ALL""")
def _(fx):
    x = I.event_means(contrib(fx, "n", "k"), ["model"]).join(SP.future_share(fx.pools), "event")
    s = F.col("future_share")
    return rounded(x.withColumn("future", F.when(s >= 0.25, "ge_0.25").when(s < 0.05, "lt_0.05").otherwise("between")).groupBy("model", "future").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("x").alias("e5_mean"), F.avg("future_share").alias("future_share_mean")))


DUPS = ["DUP", "DUPT", "DUP_F", "E2_dedup", "E2"]


@query("ES5_duplicate_effect", EST + f" SELECT model, conv, {cols(DUPS, 'avg({})')} FROM es GROUP BY model, conv")
def _(fx):
    return rounded(C.seed_mean(E.estimands_of(fx.arms), ["model", "conv"], DUPS))


@query("ES5_duplicate_intervals")
def _(fx):
    return rounded(I.random_effects_interval(contrib(fx, "a", "ad"), ["model"], level=0.90).withColumn("equivalent", (F.col("lo") > -0.02) & (F.col("hi") < 0.02)))


MASKS = ["E0", "E0_mask", "E2", "E2_mask", "dE0", "dE2", "heldout_benefit_whole", "heldout_benefit_R", "id_benefit_R"]


@query("ES6_masking_effect", EST + f" SELECT model, conv, {cols(MASKS, 'avg({})')} FROM es WHERE seed IN ('42','1') GROUP BY model, conv")
def _(fx):
    return rounded(C.seed_mean(E.estimands_of(fx.arms.filter(F.col("seed").isin("42", "1"))), ["model", "conv"], MASKS))


FULL = ["E0_full", "E1_full", "E2_full", "E3_full", "E2"]


@query("ES7_full_pool", EST + f" SELECT model, seed, conv, {cols(FULL)} FROM es")
def _(fx):
    return rounded(E.estimands_of(fx.arms).select("model", "seed", "conv", *FULL))


PRACTICES = ["matched_event", "matched_pooled", "pooled_vs_pooled_whole", "event_vs_event_whole", "different_events_pooled", "composite"]


@query("ES8_practices", ARM_SC + ", oc AS (SELECT l.event AS left_out, x.* FROM arms x JOIN (SELECT DISTINCT event FROM arms) l ON l.event <> x.event WHERE x.arm='a'), "
       + S.pooled("op", "oc", "model, seed, left_out") + ", od AS (SELECT model, seed, avg(pooled_P) AS o_P, avg(pooled_D) AS o_D, avg(pooled_O) AS o_O FROM op GROUP BY ALL), s AS ("
       + " UNION ALL ".join(f"SELECT a.model, a.seed, '{c}' AS conv, a.per_event_{c}-b.per_event_{c} AS matched_event, a.pooled_{c}-b.pooled_{c} AS matched_pooled, a.pooled_{c}-c.pooled_{c} AS pooled_vs_pooled_whole, a.per_event_{c}-c.per_event_{c} AS event_vs_event_whole, o_{c}-c.per_event_{c} AS different_events_pooled, a.pooled_{c}-c.per_event_{c} AS composite FROM asc_ a JOIN asc_ b USING (model, seed) JOIN asc_ c USING (model, seed) JOIN od USING (model, seed) WHERE a.arm='a' AND b.arm='b' AND c.arm='c'" for c in "PDO")
       + f") SELECT model, conv, {cols(PRACTICES, 'avg({})')} FROM s GROUP BY model, conv")
def _(fx):
    return rounded(C.seed_mean(E.practices(fx.arms), ["model", "conv"], PRACTICES))


PER_SEED = ["E0", "E1", "E2", "E3", "E4", "E5", "DUP", "MC", "pooled_id", "mean_c"]


@query("ES9_per_seed_table", EST + f" SELECT model, seed, conv, {cols(PER_SEED)} FROM es WHERE conv IN ('P','D')")
def _(fx):
    return rounded(E.estimands_of(fx.arms).filter("conv <> 'O'").select("model", "seed", "conv", *PER_SEED))


@query("ES10_message_weighted", ARM_SC + f""", x AS (SELECT a.model, a.event, avg(a.f1_P-b.f1_P) AS x2, avg(t.f1_P-u.f1_P) AS x4 FROM asc__ev a JOIN asc__ev b USING (model, seed, event) JOIN asc__ev t USING (model, seed, event) JOIN asc__ev u USING (model, seed, event)
   WHERE a.arm='a' AND b.arm='b' AND t.arm='at' AND u.arm='bt' GROUP BY ALL), w AS (SELECT event, count(*) AS n FROM emeta GROUP BY event)
 SELECT model, {S.r('sum(x2*n)/sum(n)', 'E2_weighted')}, {S.r('sum(x4*n)/sum(n)', 'E4_weighted')} FROM x JOIN w USING (event) GROUP BY model""")
def _(fx):
    n = fx.pools.select("event", "n")
    x2 = I.event_means(contrib(fx, "a", "b"), ["model"]).withColumnRenamed("x", "x2")
    x4 = I.event_means(contrib(fx, "at", "bt"), ["model"]).withColumnRenamed("x", "x4")
    return rounded(x2.join(x4, ["model", "event"]).join(n, "event").groupBy("model").agg(
        (F.sum(F.col("x2") * F.col("n")) / F.sum("n")).alias("E2_weighted"), (F.sum(F.col("x4") * F.col("n")) / F.sum("n")).alias("E4_weighted")))


@query("ES11_per_class_gain", ARMS + f""", f AS (SELECT model, seed, arm, event, cls, tp+fn AS s, {S.f1()} AS f FROM arms WHERE arm IN ('a','b')),
 g AS (SELECT a.model, a.cls, a.event, avg(a.f-b.f) AS d FROM f a JOIN f b USING (model, seed, event, cls) WHERE a.arm='a' AND b.arm='b' AND a.s>0 GROUP BY ALL)
 SELECT model, cls, {S.r('avg(d)', 'gain_mean')}, count(*) AS events_with_class, count(*) FILTER (d>0) AS events_positive FROM g GROUP BY ALL""")
def _(fx):
    return rounded(E.per_class_gain(fx.arms))


@query("ES12_run_composition", EST + f""", p AS (SELECT model, seed, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM arms WHERE arm='a' GROUP BY ALL),
 q AS (SELECT model, seed, bool_and(tp+fp>0) AS predicts_every_class, coalesce(string_agg(cls, ',' ORDER BY cls) FILTER (tp+fp=0), '') AS never_predicted, max({S.f1()}) FILTER (cls='error') AS rf FROM p GROUP BY ALL)
 SELECT q.model, q.seed, predicts_every_class, never_predicted, {S.r('rf', 'rare_pooled_id_f1')}, {S.r('p.E1', 'E1')}, {S.r('p.E2', 'E2')}, {S.r('p.E3', 'E3')}, {S.r('p.MC', 'MC')}, {S.r('d.E0', 'E0D')}
 FROM q JOIN es p USING (model, seed) JOIN es d USING (model, seed) WHERE p.conv='P' AND d.conv='D'""")
def _(fx):
    return rounded(E.run_composition(fx.arms, E.estimands_of(fx.arms), "error"))


@query("ES12_composition_ranges", EST + f", x AS (SELECT p.model, p.seed, d.E0 AS E0D, p.E1, p.E2, p.E3, p.MC FROM es p JOIN es d USING (model, seed) WHERE p.conv='P' AND d.conv='D') SELECT model, "
       + ", ".join(S.r(f"{f}({c})", f"{c}_{f}") for c in ("E0D", "E1", "E2", "E3", "MC") for f in ("min", "max")) + ", count(*) AS n_seeds FROM x GROUP BY model")
def _(fx):
    x = E.run_composition(fx.arms, E.estimands_of(fx.arms), "error")
    return rounded(x.groupBy("model").agg(*[f(c).alias(f"{c}_{n}") for c in ("E0D", "E1", "E2", "E3", "MC") for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("n_seeds")))


@query("ES12_recipes_on_shared_seeds", EST + """, xe AS (SELECT a.model, a.seed, a.event, a.f1_P-b.f1_P AS x FROM asc__ev a JOIN asc__ev b USING (model, seed, event) WHERE a.arm='a' AND b.arm='b'),
 sh AS (SELECT seed FROM es WHERE model IN ('mA', 'mB') GROUP BY seed HAVING count(DISTINCT model)=2), t AS (SELECT p.model, count(*) AS n_seeds, avg(d.E0) AS E0D, avg(p.E1) AS E1, avg(p.E2) AS E2, avg(p.E3) AS E3, avg(p.MC) AS MC FROM es p JOIN es d USING (model, seed) JOIN sh USING (seed) WHERE p.conv='P' AND d.conv='D' GROUP BY ALL),
 v AS (SELECT model, event, avg(x) AS x FROM xe JOIN sh USING (seed) GROUP BY ALL), w AS (SELECT model, count(*) FILTER (x>1e-12) AS events_positive, count(*) AS n_events, avg(x) AS em FROM v GROUP BY ALL)
 SELECT model, n_seeds, """ + ", ".join(S.r(c, c) for c in E.RECIPE_TERMS) + f", events_positive, n_events, {S.r('em', 'event_mean')} FROM t JOIN w USING (model)")
def _(fx):
    rows = E.run_composition(fx.arms, E.estimands_of(fx.arms), "error")
    return rounded(E.recipes_on_shared_seeds(rows, contrib(fx), "mA", "mB"))


INCOMPLETE = "cube WHERE NOT (system='sysB' AND seed='1' AND event >= 'NATION_3')"


@query("ES13_incomplete_runs", WITH + f", part AS (SELECT * FROM {INCOMPLETE}), " + S.events("ev", "part", "system, seed")
       + f""", c AS (SELECT system, seed, count(DISTINCT event) = (SELECT count(DISTINCT event) FROM cube) AS ok FROM part GROUP BY ALL), x AS (SELECT * FROM ev JOIN c USING (system, seed))
 SELECT i.system, i.seed, i.event, {S.r('max(i.f1_P)', 'f1_P')}, {S.r('avg(r.f1_P)', 'complete_mean')}, {S.r('min(r.f1_P)', 'complete_min')}, {S.r('max(r.f1_P)', 'complete_max')}, count(*) AS complete_seeds
 FROM x i JOIN x r ON i.system=r.system AND i.event=r.event AND r.ok WHERE NOT i.ok GROUP BY ALL""")
def _(fx):
    from gapcube.operators.validate import complete_seeds
    part = fx.cube.filter("NOT (system = 'sysB' AND seed = '1' AND event >= 'NATION_3')")
    return rounded(E.incomplete_runs(C.event_scores(part), complete_seeds(part, fx.cube)))


# ---------------------------------------------------------------- C17, FL9, FL10 and G8..G11 on the arms
@query("C17_per_class_record", ARMS + f""", p AS (SELECT model, seed, arm, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (tp+fn>0) AS ne FROM arms WHERE arm IN ('a','b') GROUP BY ALL),
 q AS (SELECT model, seed, arm, cls, ne, tp+fn AS nt, {S.f1()} AS f, tp+fp AS np FROM p)
 SELECT model, cls, CAST(max(a.ne) AS BIGINT) AS n_events, {S.r('avg(a.nt)', 'n_true')}, {S.r('avg(a.f)', 'id_f1')}, {S.r('avg(a.np)', 'id_n_pred')}, {S.r('avg(b.f)', 'heldout_f1')}, {S.r('avg(b.np)', 'heldout_n_pred')},
   count(*) FILTER (a.np=0) AS n_seeds_no_pred, count(*) AS n_seeds FROM q a JOIN q b USING (model, seed, cls) WHERE a.arm='a' AND b.arm='b' AND a.nt>0 GROUP BY ALL""")
def _(fx):
    from gapcube.operators.terms import per_class_record
    return rounded(per_class_record(fx.arms))


@query("FL9_restrict_to_holdout", "WITH " + RUNS_SQL + " SELECT model, seed, event, count(*) AS n, count(*) FILTER (y_true=y_pred) AS n_right FROM runs WHERE run='loeo' AND in_R GROUP BY ALL")
def _(fx):
    items = fx.splits.filter("in_R").select("item_id")
    kept = FL.restrict(fx.runs.filter("run = 'loeo'"), items)
    return kept.groupBy("model", "seed", "event").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y_true") == F.col("y_pred"), 1)).alias("n_right"))


@query("FL10_frequent_classes", ARMS + f""", l AS (SELECT model, seed, event, cls FROM arms WHERE arm='a' AND tp+fn>=5), f AS (SELECT model, seed, arm, event, avg({S.f1()}) AS f FROM arms JOIN l USING (model, seed, event, cls) WHERE arm IN ('a','b') GROUP BY ALL)
 SELECT model, seed, arm, event, {S.r('f', 'f1_frequent')} FROM f""")
def _(fx):
    return rounded(FL.frequent_class_macro(fx.arms.filter("arm IN ('a', 'b')"), "a"))


@query("FL11_stray_on_matched_items", ARMS + " SELECT model, seed, arm, event, CAST(coalesce(sum(fp) FILTER (tp+fn=0),0) AS BIGINT) AS stray_rows, count(*) FILTER (tp+fn=0 AND fp>0) AS stray_classes, count(*) FILTER (tp+fn=0) AS absent_classes FROM arms WHERE arm IN ('a','b','c') GROUP BY ALL")
def _(fx):
    return FL.stray_predictions(fx.arms.filter("arm IN ('a', 'b', 'c')"), E.ARM)


@query("G8_aggregation_on_parts", ARM_SC + f" SELECT model, seed, arm, {S.r('A_P', 'A_P')} FROM asc_ WHERE arm IN ('b','c')")
def _(fx):
    return rounded(C.score_cube(fx.arms.filter("arm IN ('b', 'c')"), E.ARM).select(*E.ARM, "A_P"))


@query("G9_residuals", EST + f""", t AS (SELECT model, conv, max(abs(E0-E1-E2-E3)) AS r FROM es GROUP BY ALL), f AS (SELECT model, max(abs(d.E0-p.E1-p.E2-p.E3-p.MC)) AS r4 FROM es p JOIN es d USING (model, seed) WHERE p.conv='P' AND d.conv='D' GROUP BY model)
 SELECT model, conv, {S.r('r', 'three_term_residual')}, {S.r('r4', 'four_term_residual')} FROM t JOIN f USING (model)""")
def _(fx):
    return rounded(E.residuals(E.estimands_of(fx.arms), ["model", "conv"]))


SYM = ["E2", "E2p", "I_order", "E1_sym", "E2_sym"]


@query("G10_symmetric_attribution", EST + f" SELECT model, conv, {cols(SYM, 'avg({})')} FROM es GROUP BY model, conv")
def _(fx):
    return rounded(C.seed_mean(E.estimands_of(fx.arms), ["model", "conv"], SYM))


AEV = f"""aev AS (SELECT event, row_number() OVER (ORDER BY event)-1 AS pos, count(*) OVER () AS sz FROM (SELECT DISTINCT event FROM arms)),
ed AS MATERIALIZED (SELECT b, e.event, count(*) AS m FROM (SELECT b, {H("'ev'", 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN aev s) d JOIN aev e ON e.pos = d.pos GROUP BY ALL)"""
ASD = f"""asd AS (SELECT model, seed, row_number() OVER (PARTITION BY model ORDER BY seed)-1 AS pos, count(*) OVER (PARTITION BY model) AS sz FROM (SELECT DISTINCT model, seed FROM arms)),
sd AS MATERIALIZED (SELECT b, model, e.seed, count(*) AS ms, max(d.sz) AS n_seeds FROM (SELECT b, s.model, s.sz, {H("'sd'", 's.model', 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN asd s) d JOIN asd e USING (model, pos) GROUP BY ALL)"""
ARM_BOOT = (EST + ", abc AS (SELECT * FROM arms WHERE arm IN ('a','b','c')), " + S.features("aft", "abc", "model, seed, arm") + ", " + AEV + ", " + ASD + ", " + S.sums("abs_", "aft", "b, model, seed, arm", "m", "JOIN ed USING (event)") + ", "
            + S.scores("absc", "abs_", "b, model, seed, arm") + ", " + estimand_sql("bes", "absc", "b, model, seed"))
SHARES = {"share_E2": "E2/E0D", "share_E2p": "E2p/E0D", "share_E2_sym": "E2_sym/E0D", "share_E1": "E1/E0D", "share_MC": "MC/E0D", "remainder": "E0D-E2", "remainder_p": "E0D-E2p"}
HEAD = ["E0", "E1", "E2", "E2p", "E2_sym", "MC"]


def arm_draws(fx, columns=HEAD):
    ft = C.cell_features(fx.arms.filter("arm IN ('a', 'b', 'c')"), E.ARM)
    ed = R.event_draws(fx.spark, fx.arms.select("event"), B)
    sd = R.seed_draws(fx.spark, fx.arms.select("model", "seed"), B, "model")
    est = E.estimands(R.draw_scores(ft, ed, E.ARM), ("b", "model", "seed"))
    j = est.join(sd, ["b", "model", "seed"])
    return j.groupBy("b", "model", "conv").agg(*[(F.sum(F.col(c) * F.col("ms")) / F.max("n_seeds")).alias(c) for c in columns])


@query("G11_headline_shares", ARM_BOOT + ", bm AS (SELECT b, model, conv, " + ", ".join(f"sum({c}*ms)/max(n_seeds) AS {c}" for c in HEAD) + " FROM bes JOIN sd USING (b, model, seed) GROUP BY ALL), "
       + "pm AS (SELECT model, conv, " + ", ".join(f"avg({c}) AS {c}" for c in HEAD) + " FROM es GROUP BY ALL), "
       + "bh AS (SELECT p.model, p.b, " + ", ".join(f"{e} AS {k}" for k, e in SHARES.items()) + " FROM bm p JOIN (SELECT b, model, E0 AS E0D FROM bm WHERE conv='D') d USING (b, model) WHERE conv='P'), "
       + "ph AS (SELECT p.model, " + ", ".join(f"{e} AS {k}" for k, e in SHARES.items()) + " FROM pm p JOIN (SELECT model, E0 AS E0D FROM pm WHERE conv='D') d USING (model) WHERE conv='P'), "
       + f"ci AS (SELECT model, {ci_sql(list(SHARES))} FROM bh GROUP BY model) SELECT ci.*, {', '.join(S.r('ph.' + k, k) for k in SHARES)} FROM ci JOIN ph USING (model)")
def _(fx):
    point = E.headline_shares(C.seed_mean(E.estimands_of(fx.arms), ["model", "conv"], HEAD), ["model"])
    d = E.headline_shares(arm_draws(fx), ["model", "b"])
    return rounded(point.join(R.percentiles(d, ["model"], list(SHARES)), "model"))


# ---------------------------------------------------------------- R5..R18: intervals and tests
@query("R5_hierarchical_bootstrap", X_AB + f""", he AS (SELECT model, event, row_number() OVER (PARTITION BY model ORDER BY event)-1 AS pos, count(*) OVER (PARTITION BY model) AS sz FROM (SELECT DISTINCT model, event FROM xe)),
 hs AS (SELECT model, seed, row_number() OVER (PARTITION BY model ORDER BY seed)-1 AS pos, count(*) OVER (PARTITION BY model) AS sz FROM (SELECT DISTINCT model, seed FROM xe)),
 pk AS (SELECT s.model, b, s.pos AS slot, {H("'hev'", 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN he s),
 pe AS (SELECT pk.model, b, slot, event FROM pk JOIN he USING (model, pos)),
 ps AS (SELECT pe.model, b, event, {H("'hsd'", 'CAST(b AS VARCHAR)', 'CAST(slot AS VARCHAR)', 'CAST(hs.pos AS VARCHAR)')} % hs.sz AS pos FROM pe JOIN hs USING (model)),
 v AS (SELECT ps.model, b, avg(x) AS v FROM ps JOIN hs USING (model, pos) JOIN xe USING (model, event, seed) GROUP BY ALL)
 SELECT model, {ci_sql(['v'])}, {S.r('avg(v)', 'boot_mean')} FROM v GROUP BY model""")
def _(fx):
    v = R.hierarchical_boot(fx.spark, contrib(fx), B, ["model"], "x")
    return rounded(R.percentiles(v, ["model"], ["v"]).join(v.groupBy("model").agg(F.avg("v").alias("boot_mean")), "model"))


@query("R6_event_bootstrap", X_AB + ", " + AEV + f", v AS (SELECT model, b, sum(x*m)/sum(m) AS v FROM xm JOIN ed USING (event) GROUP BY ALL) SELECT model, {ci_sql(['v'])} FROM v GROUP BY model")
def _(fx):
    x = I.event_means(contrib(fx), ["model"])
    return rounded(R.event_boot(x, R.event_draws(fx.spark, fx.arms.select("event"), B), ["model"], "x"))


@query("R7_stratified_instance_bootstrap")
def _(fx):
    runs = fx.runs.filter("in_R")
    joint = NM.joint_counts(runs.filter("run = 'id_random'"), runs.filter("run = 'loeo'"), ["model", "seed"])
    return rounded(R.percentiles(NM.stratified_paired_boot(joint, ["model", "seed"], B), ["model", "seed"], ["d"]))


@query("R9_bias_and_bca")
def _(fx):
    jk = R.jackknife(fx.features).groupBy("system", "left_out").agg(F.avg("A_P").alias("A_P"))
    return rounded(I.bca(draws(fx, columns=["A_P"]), C.system_scores(fx.cube), jk, ["system"], "A_P"))


@query("R9_bootstrap_bias", BOOT + ", " + S.level_scores("pt", "cube", "system, seed") + f""", p AS (SELECT system, avg(A_P) AS t FROM pt GROUP BY system)
 SELECT system, {S.r('avg(A_P)', 'boot_mean')}, {S.r('median(A_P)', 'boot_median')}, {S.r('avg(A_P)-max(t)', 'bias')} FROM bt JOIN p USING (system) GROUP BY system""")
def _(fx):
    d = draws(fx, columns=["A_P"]).groupBy("system").agg(F.avg("A_P").alias("boot_mean"), F.median("A_P").alias("boot_median"))
    return rounded(d.join(C.system_scores(fx.cube).select("system", "A_P"), "system").select("system", "boot_mean", "boot_median", (F.col("boot_mean") - F.col("A_P")).alias("bias")))


TI = X_AB + f", ts AS (SELECT model, count(x) AS n, avg(x) AS mean, stddev_samp(x)/sqrt(count(x)) AS se FROM xm GROUP BY model)"


@query("R10_t_intervals", TI + f" SELECT model, n, {S.r('mean', 'mean')}, {S.r('se', 'se')}, {S.r(f'mean-{T95}*se', 'lo95')}, {S.r(f'mean+{T95}*se', 'hi95')}, {S.r(f'mean-{T90}*se', 'lo90')}, {S.r(f'mean+{T90}*se', 'hi90')} FROM ts")
def _(fx):
    return rounded(I.t_interval(I.event_means(contrib(fx), ["model"]), ["model"]))


RE = X_AB + """, g AS (SELECT *, avg(x) OVER (PARTITION BY model) AS m, avg(x) OVER (PARTITION BY model, event) AS me, avg(x) OVER (PARTITION BY model, seed) AS ms FROM xe),
 q AS (SELECT model, count(DISTINCT event)::DOUBLE AS E, count(DISTINCT seed)::DOUBLE AS S, max(m) AS mean, sum((me-m)^2)/(count(DISTINCT event)-1) AS mse, sum((ms-m)^2)/(count(DISTINCT seed)-1) AS mss,
   sum((x-me-ms+m)^2)/((count(DISTINCT event)-1)*(count(DISTINCT seed)-1)) AS msr FROM g GROUP BY model),
 re AS (SELECT *, sqrt((mse+mss)/(E*S)) AS se, (mse+mss)^2/(mse^2/(E-1)+mss^2/(S-1)) AS df, CASE WHEN mss>msr THEN sqrt((mse+mss-msr)/(E*S)) ELSE sqrt(mse/(E*S)) END AS seu,
   CASE WHEN mss>msr THEN (mse+mss-msr)^2/(mse^2/(E-1)+mss^2/(S-1)+msr^2/((E-1)*(S-1))) ELSE E-1 END AS dfu FROM q)"""


@query("R11_random_effects", RE + f" SELECT model, E, S, {cols(['mean', 'mse', 'mss', 'msr'])}, {S.r('sqrt(mse/(E*S))', 'se_events_only')}, {S.r('se', 'se')}, {S.r('df', 'df')}, {S.r('seu', 'se_unbiased')}, {S.r('dfu', 'df_unbiased')} FROM re")
def _(fx):
    return rounded(I.random_effects(contrib(fx), ["model"]))


@query("R11_random_effects_intervals")
def _(fx):
    return rounded(I.random_effects_interval(contrib(fx), ["model"]))


@query("R12_t_tests", TI + f", w AS (SELECT *, {t_tail('(mean/se)', '(n-1)')} AS p, {t_tail('((mean+0.02)/se)', '(n-1)')}/2 AS ta, {t_tail('((mean-0.02)/se)', '(n-1)')}/2 AS tb FROM ts) SELECT model, n, {S.r('mean', 'mean')}, {S.r('se', 'se')}, {S.r('p', 'p')}, {S.r('greatest(CASE WHEN mean+0.02>0 THEN ta ELSE 1-ta END, CASE WHEN mean-0.02>0 THEN 1-tb ELSE tb END)', 'p_tost')} FROM w")
def _(fx):
    return rounded(I.t_test(I.event_means(contrib(fx), ["model"]), ["model"]))


FAMILY = [("E2", "a", "b"), ("E3", "b", "c"), ("E4", "at", "bt"), ("DUP", "a", "ad"), ("E5", "n", "k")]
FAMILY_SQL = (ARM_SC + ", xf AS (" + " UNION ALL ".join(f"SELECT '{t}' AS estimand, a.model, a.event, avg(a.f1_P-b.f1_P) AS x FROM asc__ev a JOIN asc__ev b USING (model, seed, event) WHERE a.arm='{p}' AND b.arm='{q}' GROUP BY ALL" for t, p, q in FAMILY)
              + f"), ts AS (SELECT estimand, model, count(x) AS n, avg(x) AS mean, stddev_samp(x)/sqrt(count(x)) AS se FROM xf GROUP BY ALL), w AS (SELECT *, {t_tail('(mean/se)', '(n-1)')} AS p FROM ts), "
              + "h AS (SELECT *, max(step) OVER (ORDER BY p, estimand || model ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, estimand || model) + 1)*p) AS step FROM w))")


def family(fx):
    ev = events_of(fx)
    out = None
    for t, p, q in FAMILY:
        x = I.event_means(E.contributions(ev, p, q), ["model"]).withColumn("estimand", F.lit(t))
        out = x if out is None else out.unionByName(x)
    return out


@query("R13_holm", FAMILY_SQL + f" SELECT estimand, model, n, {S.r('p', 'p')}, {S.r('p_holm', 'p_holm')} FROM h")
def _(fx):
    tests = I.t_test(family(fx), ["estimand", "model"]).withColumn("test", F.concat("estimand", "model"))
    return rounded(I.holm(tests).select("estimand", "model", "n", "p", "p_holm"))


@query("R14_signed_rank", X_AB + f""", k AS (SELECT model, x, rank() OVER (PARTITION BY model ORDER BY abs(x)) + (count(*) OVER (PARTITION BY model, abs(x))-1)/2.0 AS rk FROM xm WHERE x<>0),
 w AS (SELECT model, sum(CASE WHEN x>0 THEN rk ELSE 0 END) AS wp, count(*) AS n FROM k GROUP BY model),
 ways AS (WITH RECURSIVE d(k, c) AS (SELECT 0, list_transform(range(0, 497), lambda i: CASE WHEN i=0 THEN 1.0::DOUBLE ELSE 0.0 END) UNION ALL SELECT k+1, list_transform(range(0, 497), lambda i: c[i+1] + CASE WHEN i>=k+1 THEN c[i-k] ELSE 0.0 END) FROM d WHERE k<31) SELECT * FROM d)
 SELECT model, {S.r('wp', 'w_plus')}, n, {S.r('least(1.0, 2*list_sum(c[1:CAST(floor(least(wp, n*(n+1)/2-wp)) AS BIGINT)+1])/pow(2.0, n))', 'p')} FROM w JOIN ways ON ways.k = w.n""")
def _(fx):
    return rounded(I.wilcoxon(I.event_means(contrib(fx), ["model"]), ["model"]))


@query("R15_decisions", TI + f", d AS (SELECT model, mean, mean-{T95}*se AS lo95, mean-{T90}*se AS lo90, mean+{T90}*se AS hi90 FROM ts) SELECT model, margin, {S.r('mean', 'mean')}, lo95>0 AND mean>=margin AS material_positive, lo90>-margin AND hi90<margin AS equivalent_within, lo95>=margin AS material_on_lower_bound FROM d CROSS JOIN (VALUES (0.01::DOUBLE),(0.02::DOUBLE),(0.03::DOUBLE)) v(margin)")
def _(fx):
    t = I.t_interval(I.event_means(contrib(fx), ["model"]), ["model"])
    return rounded(I.decide(t).select("model", "margin", "mean", "material_positive", "equivalent_within", "material_on_lower_bound"))


REGISTERED = [("H1", "E2", "material_positive"), ("H2", "MC", "material_positive"), ("H3", "E5", "equivalence")]


@query("R16_registered_decisions", ARM_SC + f""", fs AS (SELECT event, 1-chrono_pool_n/(sum(n) OVER ()-n)::DOUBLE AS s FROM pools),
 xf AS (SELECT 'H1' AS decision, a.model, a.event, avg(a.f1_P-b.f1_P) AS x FROM asc__ev a JOIN asc__ev b USING (model, seed, event) WHERE a.arm='a' AND b.arm='b' GROUP BY ALL
   UNION ALL SELECT 'H2', model, event, avg(f1_P-f1_D) FROM asc__ev WHERE arm='c' GROUP BY ALL
   UNION ALL SELECT 'H3', a.model, a.event, avg(a.f1_P-b.f1_P) FROM asc__ev a JOIN asc__ev b USING (model, seed, event) JOIN fs USING (event) WHERE a.arm='n' AND b.arm='k' AND s>=0.25 GROUP BY ALL),
 ts AS (SELECT decision, model, count(x) AS n, avg(x) AS mean, stddev_samp(x)/sqrt(count(x)) AS se FROM xf GROUP BY ALL),
 w0 AS (SELECT *, {t_tail('(mean/se)', '(n-1)')} AS p0, {t_tail('((mean+0.02)/se)', '(n-1)')}/2 AS ta, {t_tail('((mean-0.02)/se)', '(n-1)')}/2 AS tb FROM ts),
 w AS (SELECT *, CASE WHEN decision<>'H3' THEN p0 ELSE greatest(CASE WHEN mean+0.02>0 THEN ta ELSE 1-ta END, CASE WHEN mean-0.02>0 THEN 1-tb ELSE tb END) END AS p FROM w0),
 h AS (SELECT *, max(step) OVER (ORDER BY p, decision || model ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, decision || model) + 1)*p) AS step FROM w))
 SELECT decision, model, n, {S.r('mean', 'mean')}, {S.r('p', 'p')}, {S.r('p_holm', 'p_holm')}, p<0.05 AND (decision='H3' OR mean>=0.02) AS supported_raw, p_holm<0.05 AND (decision='H3' OR mean>=0.02) AS supported_holm FROM h""")
def _(fx):
    ev = events_of(fx)
    future = SP.future_share(fx.pools).filter("future_share >= 0.25").select("event")
    x = I.event_means(E.contributions(ev, "a", "b"), ["model"]).withColumn("decision", F.lit("H1"))
    x = x.unionByName(E.metric_convention(ev).select("model", "event", F.col("mc").alias("x"), F.lit("H2").alias("decision")))
    x = x.unionByName(I.event_means(E.contributions(ev, "n", "k"), ["model"]).join(future, "event").withColumn("decision", F.lit("H3")))
    t = I.t_test(x, ["decision", "model"])
    equivalence = F.col("decision") == "H3"
    t = t.withColumn("p", F.when(equivalence, F.col("p_tost")).otherwise(F.col("p"))).withColumn("test", F.concat("decision", "model"))
    h = I.holm(t)
    big = equivalence | (F.col("mean") >= 0.02)
    return rounded(h.select("decision", "model", "n", "mean", "p", "p_holm", ((F.col("p") < 0.05) & big).alias("supported_raw"), ((F.col("p_holm") < 0.05) & big).alias("supported_holm")))


SPREAD = ("E0", "E1", "E2", "E3", "MC")


@query("R17_seed_spread", EST + " SELECT model, conv, " + ", ".join(S.r(e, f"{c}_{n}") for c in SPREAD for n, e in (("mean", f"avg({c})"), ("sd", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("range", f"max({c})-min({c})"))) + " FROM es GROUP BY model, conv")
def _(fx):
    return rounded(I.seed_spread(E.estimands_of(fx.arms), ["model", "conv"], SPREAD))


@query("R18_repeat_variance", ARM_SC + f""", w AS (SELECT a.model, a.seed, a.event, a.f1_P AS f_id, c.f1_P AS f_held, a.f1_P-b.f1_P AS e2 FROM asc__ev a JOIN asc__ev b USING (model, seed, event) JOIN asc__ev c USING (model, seed, event) WHERE a.arm='a' AND b.arm='b' AND c.arm='c'),
 r AS (SELECT * FROM w WHERE model='mA'), s AS (SELECT * FROM w WHERE model='mB'), f AS (SELECT event, f_id AS i0, f_held AS h0 FROM r WHERE seed='42'),
 d AS (SELECT max(greatest(abs(f_id-i0), abs(f_held-h0))) AS mx, count(DISTINCT seed) AS nr FROM r JOIN f USING (event)),
 pr AS (SELECT stddev_samp(m) AS sd, min(m) AS mn, max(m) AS mx FROM (SELECT seed, avg(e2) AS m FROM r GROUP BY seed)), ps AS (SELECT stddev_samp(m) AS sd, min(m) AS mn, max(m) AS mx FROM (SELECT seed, avg(e2) AS m FROM s GROUP BY seed)),
 er AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM (SELECT stddev_samp(e2) AS a, stddev_samp(f_id) AS b, stddev_samp(f_held) AS c FROM r GROUP BY event)), es2 AS (SELECT avg(a) AS a, avg(c) AS c FROM (SELECT stddev_samp(e2) AS a, stddev_samp(f_held) AS c FROM s GROUP BY event))
 SELECT {S.r('d.mx', 'max_abs_event_f_diff')}, TRUE AS same_training_sample, d.nr AS n_replicates, {S.r('pr.sd', 'sd_e2_repeats')}, {S.r('pr.mn', 'min_e2_repeats')}, {S.r('pr.mx', 'max_e2_repeats')}, {S.r('er.a', 'mean_sd_event_e2_repeats')}, {S.r('er.b', 'mean_sd_event_f_id_repeats')}, {S.r('er.c', 'mean_sd_event_f_held_repeats')},
  {S.r('ps.sd', 'sd_e2_seeds')}, {S.r('ps.mn', 'min_e2_seeds')}, {S.r('ps.mx', 'max_e2_seeds')}, {S.r('es2.a', 'mean_sd_event_e2_seeds')}, {S.r('es2.c', 'mean_sd_event_f_held_seeds')} FROM d, pr, ps, er, es2""")
def _(fx):
    ev = events_of(fx)
    wide = ev.filter("arm IN ('a', 'b', 'c')").groupBy("model", "seed", "event").agg(*[F.max(F.when(F.col("arm") == a, F.col("f1_P"))).alias(a) for a in "abc"])
    wide = wide.select("model", "seed", "event", F.col("a").alias("f_id"), F.col("c").alias("f_held"), (F.col("a") - F.col("b")).alias("e2"))
    repeats = wide.filter("model = 'mA'").withColumn("label", F.col("seed")).withColumn("sample", F.lit("same"))
    return rounded(I.repeat_variance(repeats, wide.filter("model = 'mB'").drop("f_id"), "42"))


@query("R19_fixed_rate_null")
def _(fx):
    return rounded(NM.null_summary(NM.fixed_rate_null(fx.cube, B)))


@query("R19_fixed_rate_null_min_cell_15")
def _(fx):
    kept = C.cube_from_pairs(FL.remove_small_pairs(fx.pairs, 15), fx.classes)
    return rounded(NM.null_summary(NM.fixed_rate_null(kept, B), ["A_P"]))


@query("R20_observed_minus_null")
def _(fx):
    ed = R.event_draws(fx.spark, fx.cube.select("event"), B)
    sd = R.seed_draws(fx.spark, fx.cube.select("system", "seed"), B)
    return rounded(R.percentiles(NM.observed_minus_null(fx.cube, ed, sd, 20), ["system"], ["omn"]))


# ---------------------------------------------------------------- K: comparisons
SYS = SCORED + ", ss AS (SELECT system, " + ", ".join(f"avg({p}_{c}) AS {p}_{c}" for p in ("pooled", "per_event", "A") for c in "PDO") + " FROM sc GROUP BY system), sl AS (" + " UNION ALL ".join(f"SELECT system, '{c}' AS conv, pooled_{c} AS po, per_event_{c} AS pe FROM ss" for c in "PDO") + ")"


@query("K1_rank_agreement", SYS + f""", p AS (SELECT a.conv, a.system AS i, b.system AS j, sign(round(a.po-b.po,12)) AS dx, sign(round(a.pe-b.pe,12)) AS dy FROM sl a JOIN sl b ON a.conv=b.conv AND a.system<b.system)
 SELECT conv, {S.r('sum(dx*dy)/sqrt(sum(abs(dx))*sum(abs(dy)))', 'tau')}, count(*) AS pairs, count(*) FILTER (dx<>dy) AS discordant, coalesce(string_agg(i||'~'||j, ',' ORDER BY i||'~'||j) FILTER (dx<>dy), '') AS discordant_pairs FROM p GROUP BY conv""")
def _(fx):
    return rounded(K.rank_agreement(C.system_scores(fx.cube)))


@query("K2_paired_bootstrap", BOOT + ", " + S.level_scores("pt", "cube", "system, seed") + ", pa AS (SELECT system, " + ", ".join(f"avg({p}_{c}) AS {p}_{c}" for p in ("pooled", "per_event") for c in "PDO") + " FROM pt GROUP BY system), "
       + "pl AS (" + " UNION ALL ".join(f"SELECT system, '{c}' AS conv, pooled_{c} AS po, per_event_{c} AS pe FROM pa" for c in "PDO") + "), bl AS (" + " UNION ALL ".join(f"SELECT b, system, '{c}' AS conv, pooled_{c} AS po, per_event_{c} AS pe FROM bt" for c in "PDO") + "), "
       + f"""dd AS (SELECT x.conv, x.system AS i, y.system AS j, x.po-y.po AS gp, x.pe-y.pe AS ge FROM bl x JOIN bl y ON x.b=y.b AND x.conv=y.conv AND x.system<y.system),
 dc AS (SELECT conv, i, j, avg((sign(round(gp,12))<>sign(round(ge,12)))::INT) AS share, quantile_cont(gp-ge, 0.025) AS lo, quantile_cont(gp-ge, 0.975) AS hi FROM dd GROUP BY ALL),
 pp AS (SELECT x.conv, x.system AS i, y.system AS j, x.po-y.po AS gp, x.pe-y.pe AS ge FROM pl x JOIN pl y ON x.conv=y.conv AND x.system<y.system)
 SELECT conv, i, j, {S.r('gp', 'gap_pooled')}, {S.r('ge', 'gap_per_event')}, {S.r('gp-ge', 'dA')}, {S.r('lo', 'da_lo95')}, {S.r('hi', 'da_hi95')}, {S.r('share', 'share_draws_orders_disagree')}, abs(ge)<abs(gp-ge) AS per_event_gap_below_abs_dA, sign(round(gp,12))<>sign(round(ge,12)) AS orders_disagree FROM pp JOIN dc USING (conv, i, j)""")
def _(fx):
    return rounded(K.paired_bootstrap(C.system_scores(fx.cube), draws(fx)))


@query("K3_mixed_summaries", SYS + f""", m AS (SELECT x.system AS pooled_of, y.system AS per_event_of, x.pooled_P-y.per_event_P AS gap, x.pooled_P-y.pooled_P AS gp, x.per_event_P-y.per_event_P AS ge FROM ss x JOIN ss y ON x.system<>y.system)
 SELECT pooled_of, per_event_of, {S.r('gap', 'gap')}, {S.r('gp', 'gap_pooled')}, {S.r('ge', 'gap_per_event')}, sign(round(gap,12))<>sign(round(gp,12)) AS reversed FROM m WHERE sign(round(gp,12))=sign(round(ge,12))""")
def _(fx):
    return rounded(K.mixed_summaries(C.system_scores(fx.cube)))


def rank_sql(v, by):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v})-1)/2.0"


def spearman_sql(name, src, by, x, y):
    return f"{name} AS (SELECT {by}, count(*) AS n, CASE WHEN count(DISTINCT rx)>1 AND count(DISTINCT ry)>1 THEN corr(rx, ry) END AS rho FROM (SELECT {by}, {rank_sql(x, by)} AS rx, {rank_sql(y, by)} AS ry FROM {src}) GROUP BY {by})"


def p_sql(rho="rho", n="n"):
    return t_tail(f"({rho}*sqrt(({n}-2)/greatest(1-{rho}*{rho}, 1e-300)))", f"({n}-2)")


SHARE = WITH + f", sh AS (SELECT system, seed, event, cls, tp+fn AS s, (tp+fn)/sum(tp+fn) OVER (PARTITION BY system, seed, event)::DOUBLE AS share, {S.f1()} AS f FROM cube), pc AS (SELECT * FROM sh WHERE s>0)"


@query("K4_share_f1_spearman", SHARE + ", " + spearman_sql("r", "pc", "system, seed", "share", "f") + f", rp AS (SELECT *, {p_sql()} AS p FROM r) SELECT system, {S.r('avg(rho)', 'rho_mean')}, {S.r('min(rho)', 'rho_min')}, {S.r('max(rho)', 'rho_max')}, {S.r('max(p)', 'max_p')}, max(n) AS n_cells FROM rp GROUP BY system")
def _(fx):
    return rounded(K.share_f1_spearman(fx.cube))


@query("K5_within_class_spearman", CELLS + ", " + spearman_sql("r", "cells", "system, cls", "support", "f1") + f" SELECT system, cls, n, {S.r('rho', 'rho')} FROM r")
def _(fx):
    return rounded(K.within_class_spearman(FL.cell_table(fx.cube)))


@query("K5_median_rho", CELLS + ", " + spearman_sql("r", "cells", "system, cls", "support", "f1") + f" SELECT system, {S.r('median(rho)', 'median_rho')}, count(rho) AS n_classes_defined FROM r GROUP BY system")
def _(fx):
    return rounded(K.median_rho(K.within_class_spearman(FL.cell_table(fx.cube))))


PR = WITH + """, pr AS (SELECT system, event, cls, max(tp+fn) AS support, avg(CASE WHEN tp+fp>0 THEN tp/(tp+fp)::DOUBLE END) AS precision, avg(tp/(tp+fn)::DOUBLE) AS recall FROM cube WHERE tp+fn>0 GROUP BY ALL), pp AS (SELECT * FROM pr WHERE precision IS NOT NULL)"""


@query("K6_precision_recall_spearman", PR + ", " + spearman_sql("r1", "pp", "system, cls", "support", "precision") + ", " + spearman_sql("r2", "pr", "system, cls", "support", "recall")
       + f" SELECT system, cls, 'precision' AS metric, n, {S.r('CASE WHEN n>=3 THEN rho END', 'rho')} FROM r1 UNION ALL SELECT system, cls, 'recall', n, {S.r('CASE WHEN n>=3 THEN rho END')} FROM r2")
def _(fx):
    return rounded(K.within_class_pr_spearman(fx.cube))


@query("K7_prevalence_cells", SHARE + ", cc AS (SELECT *, round(share-avg(share) OVER (PARTITION BY system, seed, cls),12) AS pc_, round(f-avg(f) OVER (PARTITION BY system, seed, cls),12) AS fc_ FROM pc), "
       + spearman_sql("r1", "pc", "system, seed", "share", "f") + ", " + spearman_sql("r2", "cc", "system, seed", "pc_", "fc_")
       + f""", md AS (SELECT system, seed, avg((share<0.05)::INT) AS lo, median(f) FILTER (share<0.05) AS fl, median(f) FILTER (share>=0.05) AS fh, median(s) FILTER (share<0.05) AS ml FROM pc GROUP BY ALL),
 j AS (SELECT r1.system, r1.seed, r1.n, r1.rho AS ra, r2.rho AS rb, lo, fl, fh, ml FROM r1 JOIN r2 USING (system, seed) JOIN md USING (system, seed))
 SELECT system, seed, n, {S.r('ra', 'spearman')}, {S.r(p_sql('ra'), 'p')}, {S.r('rb', 'spearman_within_class')}, {S.r(p_sql('rb'), 'p_within_class')}, {S.r('lo', 'share_prev_lt_5pct')}, {S.r('fl', 'median_f1_prev_lt_5pct')}, {S.r('fh', 'median_f1_prev_ge_5pct')}, {S.r('ml', 'median_n_prev_lt_5pct')} FROM j""")
def _(fx):
    return rounded(K.prevalence_cells(fx.cube, C.RUN))


DIFF = ARM_SC + ", dm AS (SELECT model, event, avg(f1_D) AS d, avg(f1_P) AS p FROM asc__ev WHERE arm='c' GROUP BY ALL), hz AS (SELECT DISTINCT event, hazard FROM emeta)"


@query("K8_difficulty_shift", DIFF + f""", pr AS (SELECT a.model, sign(round(a.d-b.d,12)) AS dx, sign(round(a.p-b.p,12)) AS dy FROM dm a JOIN dm b ON a.model=b.model AND a.event<b.event),
 t AS (SELECT model, sum(dx*dy)/sqrt(sum(abs(dx))*sum(abs(dy))) AS tau, count(*) FILTER (dx*dy<0) AS discordant FROM pr GROUP BY model),
 k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY d, event) AS rd, row_number() OVER (PARTITION BY model ORDER BY p, event) AS rp FROM dm),
 m AS (SELECT model, count(*) AS n_events, count(*) FILTER (abs(rd-rp)>=3) AS mv, arg_min(event, rd) AS hd, arg_min(event, rp) AS hp FROM k GROUP BY model),
 z AS (SELECT model, arg_min(hazard, d) AS zd, arg_min(hazard, p) AS zp FROM (SELECT model, hazard, avg(d) AS d, avg(p) AS p FROM dm JOIN hz USING (event) GROUP BY ALL) GROUP BY model)
 SELECT model, {S.r('tau', 'tau')}, n_events, discordant, mv AS events_moving_ge3_ranks, hd AS hardest_D, hp AS hardest_P, zd AS hardest_hazard_D, zp AS hardest_hazard_P FROM t JOIN m USING (model) JOIN z USING (model)""")
def _(fx):
    hazards = fx.emeta.groupBy("event").agg(F.min("hazard").alias("hazard"))
    return rounded(K.difficulty_shift(events_of(fx).filter("arm = 'c'"), hazards))


# exact p: the share of orders with at most so many inversions, size by size; with ties the normal tail, summed over steps
TAU_P = DIFF + """, v AS (SELECT model, round(d,12) AS x, round(p,12) AS y, event FROM dm), pr AS (SELECT a.model, sign(a.x-b.x) AS dx, sign(a.y-b.y) AS dy FROM v a JOIN v b ON a.model=b.model AND a.event<b.event),
 s AS (SELECT model, sum(dx*dy) AS s, count(*) FILTER (dx*dy<0) AS disc FROM pr GROUP BY model), n AS (SELECT model, count(*) AS n, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM v GROUP BY model),
 tx AS (SELECT model, count(*)::DOUBLE AS t FROM v GROUP BY model, x), ty AS (SELECT model, count(*)::DOUBLE AS t FROM v GROUP BY model, y),
 sx AS (SELECT model, sum(t*(t-1)) AS a, sum(t*(t-1)*(t-2)) AS b, sum(t*(t-1)*(2*t+5)) AS c FROM tx GROUP BY model), sy AS (SELECT model, sum(t*(t-1)) AS a, sum(t*(t-1)*(t-2)) AS b, sum(t*(t-1)*(2*t+5)) AS c FROM ty GROUP BY model),
 q AS (SELECT n.model, n.n, kx<n.n OR ky<n.n AS tied, least(disc, n.n*(n.n-1)//2-disc) AS low, abs(s)/sqrt((n.n*(n.n-1)*(2*n.n+5)-sx.c-sy.c)/18.0::DOUBLE + sx.a*sy.a/(2.0::DOUBLE*n.n*(n.n-1)) + sx.b*sy.b/(9.0::DOUBLE*n.n*(n.n-1)*(n.n-2))) AS z FROM n JOIN s USING (model) JOIN sx USING (model) JOIN sy USING (model)),
 w AS (WITH RECURSIVE w(k, share) AS (SELECT 1, [1.0::DOUBLE] UNION ALL SELECT k+1, list_transform(range(0, k*(k+1)//2+1), lambda i: list_sum(list_transform(range(greatest(0, i-k), least(i, k*(k-1)//2)+1), lambda j: share[j+1]))/(k+1)) FROM w WHERE k < (SELECT max(n) FROM n)) SELECT * FROM w)
 SELECT q.model, q.n AS n_events, tied, ROUNDED FROM q JOIN w ON w.k=q.n""".replace("ROUNDED", S.r("CASE WHEN tied THEN 1-2*list_sum(list_transform(range(0, 20000), lambda i: exp(-0.5::DOUBLE*pow((i+0.5)*z/20000, 2))*z/20000))/sqrt(2*pi()) ELSE least(1.0, 2*list_sum(share[1:low+1])) END", "p"))


@query("K8_difficulty_tau_p", TAU_P)
def _(fx):
    return rounded(K.tau_p(events_of(fx).filter("arm = 'c'")))


RARE = ARM_SC + ", " + S.features("rft", "(SELECT * FROM arms WHERE arm='a')", "model, seed, arm") + ", " + S.sums("rcs", "rft", "model, seed, arm") + ", " + S.scores("rsc", "rcs", "model, seed, arm") + f""",
 rp AS (SELECT model, seed, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (tp+fn>0) AS ne FROM arms WHERE arm='a' GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY ne, cls) AS rn FROM rp WHERE tp+fn>0),
 ra AS (SELECT model, seed, cls, ne AS n_events, {S.f1()} AS f, CAST(tp+fp AS BIGINT) AS n_pred, CAST(tp+fn AS BIGINT) AS n_true, reweighting FROM rk JOIN rsc USING (model, seed) WHERE rn=1)"""


@query("K11_rarest_class", RARE + f" SELECT model, seed, cls, n_events, {S.r('f', 'pooled_id_f1')}, n_pred, n_true, {S.r('reweighting', 'reweighting')}, n_pred>0 AS learned FROM ra")
def _(fx):
    return rounded(K.rarest_class(fx.arms, C.score_cube(fx.arms.filter("arm = 'a'"), E.ARM)))


@query("K9_rare_f1_against_reweighting", RARE + ", z AS (SELECT 'all' AS g, f, reweighting FROM ra), " + spearman_sql("r", "z", "g", "f", "reweighting") + f" SELECT n, {S.r('rho', 'rho')}, {S.r(p_sql(), 'p')} FROM r")
def _(fx):
    runs = K.rarest_class(fx.arms, C.score_cube(fx.arms.filter("arm = 'a'"), E.ARM)).withColumn("g", F.lit("all"))
    return rounded(I.with_spearman_p(I.spearman(runs, ["g"], "pooled_id_f1", "reweighting")).drop("g"))


@query("K9_rare_f1_bands", RARE + f", b AS (SELECT *, CASE WHEN f<=0 THEN 'zero' WHEN f<=0.3 THEN 'low' WHEN f<=0.6 THEN 'mid' ELSE 'high' END AS band FROM ra) SELECT band, count(*) AS n, {S.r('min(f)', 'f1_min')}, {S.r('max(f)', 'f1_max')}, {S.r('min(reweighting)', 'rw_min')}, {S.r('max(reweighting)', 'rw_max')} FROM b GROUP BY band")
def _(fx):
    return rounded(K.rare_bands(K.rarest_class(fx.arms, C.score_cube(fx.arms.filter("arm = 'a'"), E.ARM))))


@query("K10_model_difference", X_AB + f""", e AS (SELECT a.event, avg(b.x)-avg(a.x) AS x FROM xe a JOIN xe b ON a.event=b.event AND a.model='mA' AND b.model='mB' GROUP BY a.event),
 sm AS (SELECT model, seed, avg(x) AS x FROM xe GROUP BY ALL), s AS (SELECT b.x-a.x AS x FROM sm a JOIN sm b ON a.seed=b.seed AND a.model='mA' AND b.model='mB'), u AS (SELECT 'event' AS paired_by, x FROM e UNION ALL SELECT 'seed', x FROM s)
 SELECT paired_by, count(*) AS n, {S.r('avg(x)', 'mean')}, {S.r('stddev_samp(x)/sqrt(count(*))', 'se')} FROM u GROUP BY paired_by""")
def _(fx):
    return rounded(K.model_difference(contrib(fx), "mA", "mB"))


@query("K10_combined_difference", RE + f" SELECT {S.r('b.mean-a.mean', 'difference')}, {S.r('sqrt(a.se^2+b.se^2)', 'se')}, {S.r('(a.se^2+b.se^2)^2/(a.se^4/a.df+b.se^4/b.df)', 'df')} FROM re a, re b WHERE a.model='mA' AND b.model='mB'")
def _(fx):
    return rounded(K.combined_difference(I.random_effects(contrib(fx), ["model"]), "mA", "mB"))


@query("K12_top_event_share", MC_SQL + f""", t AS (SELECT event FROM (SELECT event, sum(mc) AS t FROM mc GROUP BY event) ORDER BY round(t,12) DESC, event LIMIT 2)
 SELECT model, {S.r('CASE WHEN sum(mc)<>0 THEN coalesce(sum(mc) FILTER (event IN (SELECT event FROM t)),0)/sum(mc) ELSE 0 END', 'top2_share')}, string_agg(event, ',' ORDER BY event) FILTER (event IN (SELECT event FROM t)) AS top2_events FROM mc GROUP BY model""")
def _(fx):
    return rounded(K.ls_concentration(E.metric_convention(events_of(fx))))


@query("K13_jackknife_and_seeds", JACK + """, a AS (SELECT system, avg(A_P) AS w, count(*) AS k FROM sc GROUP BY ALL), j AS (SELECT system, left_out, avg(A_P) AS v FROM jk GROUP BY ALL), d AS (SELECT system, max(abs(v-w)) AS d FROM j JOIN a USING (system) GROUP BY ALL)
 SELECT kind, count(*) AS n_systems, """ + ", ".join((S.r("min(w)", "A_P_min"), S.r("max(w)", "A_P_max"), S.r("max(w)-min(w)", "A_P_spread"), S.r("max(d)", "max_deviation"))) + " FROM (SELECT 'all' AS kind, * FROM a JOIN d USING (system) UNION ALL SELECT 'multi_seed', * FROM a JOIN d USING (system) WHERE k>1) GROUP BY kind")
def _(fx):
    """Ranges and the largest jackknife deviation over all systems, and over those with more than one seed."""
    jk = R.jackknife(fx.features).groupBy("system", "left_out").agg(F.avg("A_P").alias("A_P"))
    seeds = fx.cube.select("system", "seed").distinct().groupBy("system").agg(F.count(F.lit(1)).alias("k"))
    full = C.system_scores(fx.cube)
    return rounded(K.deviation_ranges(full.join(R.jackknife_summary(jk, full), "system").join(seeds, "system"), "A_P", "k"))


@query("K13_system_ranges", BOOT + ", " + S.sums("pcs", "ft", "system, seed") + ", " + S.scores("pt", "pcs", "system, seed")
       + ", pm AS (SELECT system, " + ", ".join(f"avg({c}) AS {c}" for c in ("A_P", "A_D", "A_O", "T3", "T4")) + " FROM pt GROUP BY system), ci AS (SELECT system, quantile_cont(A_P,0.025) AS lo, quantile_cont(A_P,0.975) AS hi FROM bt GROUP BY system) SELECT count(*) AS n_systems, "
       + ", ".join(f"{S.r(f'min({c})', f'{c}_min')}, {S.r(f'max({c})', f'{c}_max')}, {S.r(f'max({c})-min({c})', f'{c}_spread')}, count(*) FILTER ({c}<0) AS {c}_negative" for c in ("A_P", "A_D", "A_O", "T3", "T4"))
       + ", count(*) FILTER (lo<=0 AND hi>=0) AS ci_covers_zero, count(*) FILTER (lo>0) AS ci_positive, count(*) FILTER (hi<0) AS ci_negative FROM pm JOIN ci USING (system)")
def _(fx):
    ci = R.percentiles(draws(fx, columns=["A_P"]), ["system"], ["A_P"])
    return rounded(K.system_ranges(C.system_scores(fx.cube).join(ci, "system"), ["A_P", "A_D", "A_O", "T3", "T4"], "A_P_lo95", "A_P_hi95"))
