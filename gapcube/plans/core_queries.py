"""Queries of the confusion cube, scores, gap terms, filters and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapcube.functions.columns import r9, ratio, rounded
from gapcube.operators import cube as C
from gapcube.operators import filters as FL
from gapcube.operators import resample as R
from gapcube.operators import terms as G
from gapcube.plans import sqlparts as S
from gapcube.plans.fixtures import CUBE, H, MERGED, META, PRED, cube_sql
from gapcube.plans.registry import query
from gapcube.session import written

B = 2000
WITH = "WITH " + CUBE
SCORED = WITH + ",\n" + S.level_scores("sc", "cube", "system, seed")
FEAT = WITH + ",\n" + S.features("ft", "cube", "system, seed")
SCORES = FEAT + ",\n" + S.sums("cs", "ft", "system, seed") + ",\n" + S.scores("sc", "cs", "system, seed")
PDO = "PDO"
TERMS = C.TERMS


def cols(names, fn="{}"):
    return ", ".join(S.r(fn.format(n), n) for n in names)


# ---------------------------------------------------------------- C: cube and scores
@query("C1_confusion_cube", WITH + " SELECT system, seed, event, cls, tp, fp, fn FROM cube")
def _(fx):
    return C.confusion_cube(fx.pred, fx.classes)


@query("C2_pooled_counts", WITH + " SELECT system, seed, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cube GROUP BY ALL")
def _(fx):
    return C.pool(fx.cube)


@query("C3_cell_metrics", WITH + f""" SELECT system, seed, event, cls, tp+fn AS support,
  {S.r('CASE WHEN tp+fp>0 THEN tp/(tp+fp)::DOUBLE ELSE 0 END', 'precision')}, {S.r('CASE WHEN tp+fn>0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END', 'recall')},
  {S.r(S.f1(), 'f1')} FROM cube""")
def _(fx):
    return rounded(C.cell_metrics(fx.cube).select("system", "seed", "event", "cls", "support", "precision", "recall", "f1"))


@query("C4_label_masks", WITH + " SELECT system, seed, event, cls, tp+fn>0 AS list_P, tp+fn+fp>0 AS list_D, TRUE AS list_O FROM cube")
def _(fx):
    return fx.cube.select("system", "seed", "event", "cls", *[C.label_mask(c).alias(f"list_{c}") for c in PDO])


@query("C5_macro_f1", WITH + ", " + S.events("ev", "cube", "system, seed") + f" SELECT system, seed, event, {cols([f'f1_{c}' for c in PDO])} FROM ev")
def _(fx):
    return rounded(C.macro_f1(fx.cube, ["system", "seed", "event"]))


SUMMARY = [f"{p}_{c}" for p in ("pooled", "per_event", "A") for c in PDO]


@query("C6_scores", SCORED + f""", n AS (SELECT system, seed, count(*) AS n_messages FROM pred GROUP BY ALL)
 SELECT system, seed, n_events, n_messages, {cols(SUMMARY)}, {S.r('A_D-A_P', 'label_list_shift_D')}, {S.r('A_O-A_P', 'label_list_shift_O')} FROM sc JOIN n USING (system, seed)""")
def _(fx):
    s = C.score_cube(C.confusion_cube(fx.pred, fx.classes))
    return s.select("system", "seed", F.col("n_events").cast("bigint").alias("n_events"), F.col("n_messages").cast("bigint").alias("n_messages"),
                    *[r9(c).alias(c) for c in SUMMARY], r9(F.col("A_D") - F.col("A_P")).alias("label_list_shift_D"),
                    r9(F.col("A_O") - F.col("A_P")).alias("label_list_shift_O"))


@query("C6_event_scores", WITH + ", " + S.events("ev", "cube", "system, seed") + f" SELECT system, seed, event, n, n_present, {cols(['f1_P', 'f1_D', 'f1_O'])} FROM ev")
def _(fx):
    return rounded(C.event_scores(fx.cube).select("system", "seed", "event", "n", "n_present", "f1_P", "f1_D", "f1_O"))


@query("C7_signatures", "WITH " + PRED + f""", h AS (SELECT event, bit_xor(CAST(('0x' || substr(md5(item_id||'|'||event||'|'||hazard||'|'||label),1,15)) AS BIGINT)) AS x FROM meta GROUP BY event),
 fp AS (SELECT substr(sha256(string_agg(event || ':' || x, ',' ORDER BY event)), 1, 12) AS f FROM h), e AS (SELECT system, seed, count(DISTINCT event) AS n FROM pred GROUP BY ALL),
 a AS (SELECT count(DISTINCT event) AS n_all FROM meta)
 SELECT system, seed, c.conv AS labels, s.s AS summary, 'loeo-macro-f1|summary:'||s.s||'|labels:'||c.conv||'|zero-div:0|events:'||e.n||CASE WHEN n < n_all THEN '+partial' ELSE '' END||'|min-cell:0|meta:'||f||'|v:1.2.0' AS signature
 FROM e, a, fp, (VALUES ('P'),('D'),('O')) c(conv), (VALUES ('pooled'),('per-event'),('difference')) s(s)""")
def _(fx):
    from gapcube.operators.validate import meta_fingerprint, signatures
    return signatures(C.score_cube(fx.cube), meta_fingerprint(fx.meta), fx.meta)


@query("C8_system_scores", SCORED + ", x AS (SELECT system, " + ", ".join(f"avg({n}) AS {n}" for n in SUMMARY) + f" FROM sc GROUP BY system) SELECT system, {cols(SUMMARY)} FROM x")
def _(fx):
    return rounded(C.system_scores(fx.cube).select("system", *SUMMARY))


@query("C9_per_seed_a", SCORED + f" SELECT system, seed, {cols(['A_P', 'A_D', 'A_O'])} FROM sc")
def _(fx):
    return rounded(C.score_cube(fx.cube).select("system", "seed", "A_P", "A_D", "A_O"))


@query("C10_per_event_table", WITH + ", " + S.events("ev", "cube", "system, seed") + """, m AS (SELECT event, system, avg(f1_P) AS f, max(n) AS n, max(n_present) AS np FROM ev GROUP BY ALL)
 SELECT event, CAST(max(n) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS n_present, """ + ", ".join(S.r(f"max(f) FILTER (system='{s}')", f"f_{s}") for s in ("sysA", "sysB", "sysZ")) + " FROM m GROUP BY event")
def _(fx):
    m = C.event_scores(fx.cube).groupBy("event", "n", "n_present", "system").agg(F.avg("f1_P").alias("f"))
    names = ["sysA", "sysB", "sysZ"]
    wide = m.groupBy("event").pivot("system", names).agg(F.max("f"))
    size = m.groupBy("event").agg(F.max("n").alias("n"), F.max("n_present").alias("n_present"))
    return rounded(size.join(wide, "event").select("event", "n", "n_present", *[F.col(s).alias(f"f_{s}") for s in names]))


CELLS = WITH + f", cells AS (SELECT system, event, cls, max(tp+fn) AS support, avg({S.f1()}) AS f1 FROM cube WHERE tp+fn>0 GROUP BY ALL)"


@query("C11_cell_table", CELLS + f" SELECT system, event, cls, support, {S.r('f1', 'f1')} FROM cells")
def _(fx):
    return rounded(FL.cell_table(fx.cube))


REMAP = "WITH " + PRED + """, mp AS (SELECT * REPLACE (CASE y_true WHEN '2-HIGH' THEN '1-URGENT' ELSE y_true END AS y_true, CASE y_pred WHEN '2-HIGH' THEN '1-URGENT' ELSE y_pred END AS y_pred) FROM pred),
 mc AS (SELECT * FROM classes WHERE cls <> '2-HIGH'), """ + cube_sql("cube", "mp", "mc", "system, seed") + ", " + S.level_scores("sc", "cube", "system, seed")


@query("C12_merged_classes", REMAP + f" SELECT system, seed, {cols(SUMMARY)} FROM sc")
def _(fx):
    from gapcube.operators.validate import remap_labels
    merged = remap_labels(fx.pred, MERGED, ["y_true", "y_pred"])
    return rounded(C.score_cube(C.confusion_cube(merged, C.class_list(remap_labels(fx.meta, MERGED, ["label"])))).select("system", "seed", *SUMMARY))


@query("C13_class_recall", WITH + f""", ps AS (SELECT system, seed, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
   avg(tp/(tp+fn)::DOUBLE) FILTER (tp+fn>0) AS re, avg({S.f1()}) FILTER (tp+fn>0) AS fe, coalesce(sum(fp) FILTER (tp+fn=0),0) AS fa,
   count(*) FILTER (tp+fn>0) AS ep, count(*) FILTER (tp+fn=0) AS ea FROM cube GROUP BY ALL)
 SELECT system, cls, {S.r('avg(tp/(tp+fn)::DOUBLE)', 'recall_pooled')}, {S.r('avg(re)', 'recall_event_mean')}, {S.r(f'avg({S.f1()})', 'f1_pooled')}, {S.r('avg(fe)', 'f1_event_mean')},
   {S.r('avg(fa)', 'false_alarms_absent_events')}, max(ep) AS events_present, max(ea) AS events_absent, CAST(max(tp+fn) AS BIGINT) AS support FROM ps GROUP BY ALL""")
def _(fx):
    return rounded(G.class_recall(fx.cube))


# row counts by definition, never the cube: every score of a level straight from the predictions
ROW_SCORES = ", ".join(f"avg({S.f1()}) FILTER ({S.mask(c)}) AS f_{c}" for c in PDO)


def row_sql(name, keys):
    return (f"{name}_g AS (SELECT * FROM (SELECT DISTINCT {keys} FROM pred) CROSS JOIN classes), {name} AS (SELECT {keys}, {ROW_SCORES} FROM (SELECT {keys}, cls, count(p.item_id) FILTER (p.y_true=cls AND p.y_pred=cls) AS tp, count(p.item_id) FILTER (p.y_true<>cls AND p.y_pred=cls) AS fp, count(p.item_id) FILTER (p.y_true=cls AND p.y_pred<>cls) AS fn"
            f" FROM {name}_g JOIN pred p USING ({keys}) GROUP BY {keys}, cls) GROUP BY {keys})")


@query("C14_scorer_agreement", SCORED + ", " + row_sql("re", "system, seed, event") + ", " + row_sql("rp", "system, seed") + f""" SELECT 'per_event' AS level, {S.r('max(greatest(' + ', '.join(f'abs(f1_{c}-f_{c})' for c in PDO) + '))', 'max_abs_diff')}, CAST(count(*)*3 AS BIGINT) AS n_scores, {S.r('avg(f_P)', 'mean_P')} FROM sc_ev JOIN re USING (system, seed, event)
 UNION ALL SELECT 'pooled', {S.r('max(greatest(' + ', '.join(f'abs(pooled_{c}-f_{c})' for c in PDO) + '))')}, CAST(count(*)*3 AS BIGINT), {S.r('avg(f_P)')} FROM sc JOIN rp USING (system, seed)""")
def _(fx):
    from gapcube.operators.validate import row_level_macro
    events, runs = ["system", "seed", "event"], ["system", "seed"]
    parts = (("per_event", C.macro_f1(fx.cube, events), row_level_macro(fx.stored_pred, fx.classes), events, [f"f1_{c}" for c in PDO]),
             ("pooled", C.score_cube(fx.cube), row_level_macro(fx.stored_pred, fx.classes, runs, "pooled_{}"), runs, [f"pooled_{c}" for c in PDO]))
    found = [G.max_abs_diff(a, b, on, names).select(F.lit(level).alias("level"), "*").withColumn("mean_P", b.agg(F.avg(names[0]).alias("m")).scalar()) for level, a, b, on, names in parts]
    return rounded(found[0].unionByName(found[1]))


@query("C15_undefined_left_out", WITH + f""", e AS (SELECT system, seed, event, avg({S.f1()}) FILTER (tp+fp+fn>0) AS a, {S.macro('D')} AS d FROM cube GROUP BY ALL)
 SELECT system, seed, {S.r('max(abs(a-d))', 'max_abs_diff')}, count(*) AS n_events FROM e GROUP BY ALL""")
def _(fx):
    return rounded(G.nan_macro(fx.cube))


@query("C16_pool_coverage", SCORED + """, c AS (SELECT system, seed, count(*) AS n_classes, bool_and(s>0) AS pool_has_every_class FROM (SELECT system, seed, cls, sum(tp+fn) AS s FROM cube GROUP BY ALL) GROUP BY ALL)
 SELECT system, seed, n_classes, pool_has_every_class, abs(pooled_P-pooled_D)<1e-8 AND abs(pooled_P-pooled_O)<1e-8 AS pooled_equal FROM sc JOIN c USING (system, seed)""")
def _(fx):
    return G.pool_coverage(fx.cube)


# ---------------------------------------------------------------- G: gap terms
@query("G1_split_terms", SCORES + f" SELECT system, seed, {cols(['A_P', 'T1', 'T2', 'T3', 'T4'])} FROM sc")
def _(fx):
    return rounded(C.score_cube(fx.cube).select("system", "seed", "A_P", "T1", "T2", "T3", "T4"))


@query("G2_support_first_order", SCORES + f" SELECT system, seed, {cols(['T2alt', 'T3alt'])}, {S.r('T1+T2alt+T3alt+T4-A_P', 'residual')} FROM sc")
def _(fx):
    s = C.score_cube(fx.cube)
    return rounded(s.select("system", "seed", "T2alt", "T3alt", F.expr("T1 + T2alt + T3alt + T4 - A_P").alias("residual")))


@query("G3_composition_first_order", SCORES + f" SELECT system, seed, {cols(['T3c', 'T4c'])}, {S.r('T1+T2+T3c+T4c-A_P', 'residual')} FROM sc")
def _(fx):
    s = C.score_cube(fx.cube)
    return rounded(s.select("system", "seed", "T3c", "T4c", F.expr("T1 + T2 + T3c + T4c - A_P").alias("residual")))


@query("G4_closed_forms", SCORED + f""", e AS (SELECT system, seed, max(greatest(abs(f1_O-n_present*1.0::DOUBLE/n_classes*f1_P), abs(f1_D-n_present*1.0::DOUBLE/(n_present+k)*f1_P))) AS dev,
   avg((1-n_present*1.0::DOUBLE/n_classes)*f1_P) AS so, avg(k*1.0::DOUBLE/(n_present+k)*f1_P) AS sd, avg(k) AS km, max(k) AS kx, avg((k>0)::INT) AS kp FROM sc_ev GROUP BY ALL),
 c AS (SELECT system, bool_and(s>0) AS every FROM (SELECT system, seed, cls, sum(tp+fn) AS s FROM cube GROUP BY ALL) GROUP BY ALL),
 j AS (SELECT system, max(dev) AS dev, avg(so) AS so, avg(sd) AS sd, avg(A_P) AS ap, avg(A_D) AS ad, avg(A_O) AS ao, avg(km) AS km, max(kx) AS kx, avg(kp) AS kp,
   bool_and(abs(pooled_P-pooled_D)<1e-8 AND abs(pooled_P-pooled_O)<1e-8) AS eq FROM e JOIN sc USING (system, seed) GROUP BY system)
 SELECT system, {S.r('dev', 'max_abs_dev_event')}, {S.r('greatest(abs(ao-ap-so), abs(ad-ap-sd))', 'max_abs_dev_A')}, every AS pooled_has_every_class, eq AS pooled_equal_across_conventions,
   {S.r('so', 'shift_O')}, {S.r('sd', 'shift_D')}, {S.r('km', 'k_mean')}, kx AS k_max, {S.r('kp', 'share_events_k_pos')} FROM j JOIN c USING (system)""")
def _(fx):
    return rounded(G.closed_forms(fx.cube))


@query("G5_perfect_classifier_gap", "WITH " + META + f" SELECT {S.r('avg(1-p*1.0::DOUBLE/(SELECT count(DISTINCT label) FROM meta))', 'perfect_A_O')}, count(*) AS n_events FROM (SELECT event, count(DISTINCT label) AS p FROM meta GROUP BY event)")
def _(fx):
    return rounded(G.perfect_a_o(fx.meta))


@query("G6_size_weighting", SCORED + f""", w AS (SELECT system, seed, sum(n*f1_P)/sum(n) AS fw FROM sc_ev GROUP BY ALL)
 SELECT system, seed, {S.r('fw-per_event_P', 'W')}, {S.r('pooled_P-fw', 'N')} FROM sc JOIN w USING (system, seed)""")
def _(fx):
    return rounded(C.score_cube(fx.cube).select("system", "seed", "W", "N"))


@query("G7_scoring_reweighting", SCORED + f""", c AS (SELECT cube.*, n_present, {S.f1()} AS f FROM cube JOIN sc_ev USING (system, seed, event) WHERE tp+fn>0),
 k AS (SELECT system, seed, cls, sum(1.0::DOUBLE/n_present)/(SELECT count(DISTINCT event) FROM cube) AS w, sum(f/n_present)/sum(1.0::DOUBLE/n_present) AS fb FROM c GROUP BY ALL),
 p AS (SELECT system, seed, cls, {S.f1('sum(tp)', 'sum(fp)', 'sum(fn)')} AS fp FROM cube GROUP BY ALL)
 SELECT system, seed, {S.r('avg(fp-fb)', 'scoring')}, {S.r('sum((1.0::DOUBLE/kk-w)*fb)', 'reweighting')} FROM (SELECT *, count(*) OVER (PARTITION BY system, seed) AS kk FROM k JOIN p USING (system, seed, cls)) GROUP BY ALL""")
def _(fx):
    return rounded(C.score_cube(fx.cube).select("system", "seed", "scoring", "reweighting"))


# ---------------------------------------------------------------- FL: filters
@query("FL1_small_cell_removal", "WITH " + PRED + """, c AS (SELECT *, count(*) OVER (PARTITION BY system, seed, event, y_true) AS z FROM pred)
 SELECT system, seed, count(DISTINCT (event, y_true)) FILTER (z<15) AS removed_cells, count(*) FILTER (z<15) AS removed_messages, count(*) FILTER (z>=15) AS messages_left FROM c GROUP BY ALL""")
def _(fx):
    return FL.removal_report(fx.pairs, 15)


@query("FL1_scores_min_cell_15", "WITH " + PRED + ", k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY system, seed, event, y_true) AS z FROM pred) WHERE z>=15), "
       + cube_sql("cube", "k", "classes", "system, seed") + ", " + S.level_scores("sc", "cube", "system, seed") + f" SELECT system, seed, {cols(SUMMARY)} FROM sc")
def _(fx):
    kept = FL.remove_small_cells(fx.pred, 15)
    return rounded(C.score_cube(C.confusion_cube(kept, fx.classes)).select("system", "seed", *SUMMARY))


@query("FL2_threshold_sweep", "WITH " + META + """, c AS (SELECT event, label, count(*) AS z FROM meta GROUP BY ALL)
 SELECT t, count(*) FILTER (z<t) AS cells, CAST(coalesce(sum(z) FILTER (z<t),0) AS BIGINT) AS messages, count(DISTINCT event) FILTER (z>=t) AS events_left, count(*) AS cells_total, CAST(sum(z) AS BIGINT) AS messages_total
 FROM c CROSS JOIN (VALUES (5),(10),(15),(20),(30)) v(t) GROUP BY t""")
def _(fx):
    return FL.threshold_sweep(fx.meta)


# one multiplicity row per (draw, event) and per (draw, system, seed)
EV = f"""evs AS (SELECT event, row_number() OVER (ORDER BY event)-1 AS pos, count(*) OVER () AS sz FROM (SELECT DISTINCT event FROM cube)),
ed AS MATERIALIZED (SELECT b, e.event, count(*) AS m FROM (SELECT b, {H("'ev'", 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN evs s) d JOIN evs e ON e.pos = d.pos GROUP BY ALL)"""
SD = f"""sds AS (SELECT system, seed, row_number() OVER (PARTITION BY system ORDER BY seed)-1 AS pos, count(*) OVER (PARTITION BY system) AS sz FROM (SELECT DISTINCT system, seed FROM cube)),
sd AS MATERIALIZED (SELECT b, system, e.seed, count(*) AS ms, max(d.sz) AS n_seeds FROM (SELECT b, s.system, s.sz, {H("'sd'", 's.system', 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN sds s) d JOIN sds e USING (system, pos) GROUP BY ALL)"""
BOOT_COLUMNS = SUMMARY + list(TERMS) + ["W", "N"]


def boot_sql(feat, keys="system, seed"):
    return (S.sums("bs", feat, f"b, {keys}", "m", "JOIN ed USING (event)") + ", " + S.scores("bsc", "bs", f"b, {keys}")
            + ", bt AS MATERIALIZED (SELECT b, system, " + ", ".join(f"sum({c}*ms)/max(n_seeds) AS {c}" for c in BOOT_COLUMNS) + " FROM bsc JOIN sd USING (b, system, seed) GROUP BY ALL)")


BOOT = FEAT + ", " + EV + ", " + SD + ", " + boot_sql("ft")


def ci_sql(names, points=R.CI):
    return ", ".join(S.r(f"quantile_cont({c}, {p})", f"{c}_{n}") for c in names for n, p in points.items())


def draws(fx, features=None, b=B, columns=BOOT_COLUMNS):
    features = fx.features if features is None else features
    return R.bootstrap(features, R.event_draws(fx.spark, fx.cube.select("event"), b), R.seed_draws(fx.spark, fx.cube.select("system", "seed"), b), columns)


T_KEYS = "t, system, seed"
# draws from the events that a threshold leaves
EV_T = f"""evs AS (SELECT t, event, row_number() OVER (PARTITION BY t ORDER BY event)-1 AS pos, count(*) OVER (PARTITION BY t) AS sz FROM (SELECT DISTINCT t, event FROM cube)),
ed AS MATERIALIZED (SELECT b, t, e.event, count(*) AS m FROM (SELECT b, s.t, {H("'ev'", 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN evs s) d JOIN evs e USING (t, pos) GROUP BY ALL)"""
CUBE_T = ("WITH " + PRED + ", kt AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY system, seed, event, y_true) AS z FROM pred) CROSS JOIN (VALUES (5),(10),(15),(20),(30)) v(t) WHERE z>=t), "
          + cube_sql("cube", "kt", "classes", T_KEYS) + ", " + S.features("ft", "cube", T_KEYS) + ", " + EV_T + ", " + SD)


@query("FL3_gap_by_threshold", CUBE_T + ", " + S.sums("cs", "ft", T_KEYS) + ", " + S.scores("sc", "cs", T_KEYS) + ", " + S.sums("bs", "ft", f"b, {T_KEYS}", "m", "JOIN ed USING (t, event)") + ", " + S.scores("bsc", "bs", f"b, {T_KEYS}")
       + """, bt AS (SELECT b, t, system, sum(A_P*ms)/max(n_seeds) AS A_P FROM bsc JOIN sd USING (b, system, seed) GROUP BY ALL),
 pt AS (SELECT t, system, avg(A_P) AS a, max(n_events) AS ne FROM sc GROUP BY ALL)
 SELECT t, system, """ + S.r("max(a)", "A_P") + ", CAST(max(ne) AS BIGINT) AS events, " + ci_sql(["A_P"]) + " FROM pt JOIN bt USING (t, system) GROUP BY t, system")
def _(fx):
    cube = FL.cube_by_threshold(fx.pairs, fx.classes)
    keys = ("t", "system", "seed")
    ft = written(C.cell_features(cube, keys), "features")
    point = C.scores(C.class_sums(ft, keys), keys).groupBy("t", "system").agg(F.avg("A_P").alias("A_P"), F.max("n_events").cast("bigint").alias("events"))
    ed = R.event_draws(fx.spark, ft.select("t", "event"), B, by=["t"])
    sd = R.seed_draws(fx.spark, fx.cube.select("system", "seed"), B)
    d = R.draw_scores(ft, ed, keys).join(sd, ["b", "system", "seed"]).groupBy("b", "t", "system").agg((F.sum(F.col("A_P") * F.col("ms")) / F.max("n_seeds")).alias("A_P"))
    return rounded(point.join(R.percentiles(d, ["t", "system"], ["A_P"]), ["t", "system"]))


@query("FL4_small_cells", CELLS + f" SELECT system, event, cls, support, {S.r('f1', 'f1')} FROM cells WHERE support < 15")
def _(fx):
    return rounded(FL.small_cells(fx.cube))


@query("FL8_event_subset", "WITH " + CUBE + """, sub AS (SELECT * FROM cube WHERE event IN (SELECT event FROM meta WHERE hazard IN ('ASIA','EUROPE'))), """ + S.level_scores("sc", "sub", "system, seed") + f" SELECT system, seed, n_events, {cols(SUMMARY)} FROM sc")
def _(fx):
    protected = fx.meta.filter(F.col("hazard").isin("ASIA", "EUROPE"))
    s = C.score_cube(FL.subset(fx.cube, protected))
    return rounded(s.select("system", "seed", F.col("n_events").cast("bigint").alias("n_events"), *SUMMARY))


@query("FL11_stray_predictions", WITH + " SELECT system, seed, event, CAST(coalesce(sum(fp) FILTER (tp+fn=0),0) AS BIGINT) AS stray_rows, count(*) FILTER (tp+fn=0 AND fp>0) AS stray_classes, count(*) FILTER (tp+fn=0) AS absent_classes FROM cube GROUP BY ALL")
def _(fx):
    return FL.stray_predictions(fx.cube)


@query("FL11_stray_by_class", WITH + f" SELECT system, cls, {S.r('avg(n)', 'stray_per_seed')} FROM (SELECT system, seed, cls, coalesce(sum(fp) FILTER (tp+fn=0),0) AS n FROM cube GROUP BY ALL) GROUP BY ALL")
def _(fx):
    return rounded(FL.stray_by_class(fx.cube))


# ---------------------------------------------------------------- R: resampling of the cube
@query("R1_event_draws", WITH + ", " + EV + " SELECT b, event, m FROM ed")
def _(fx):
    return R.event_draws(fx.spark, fx.cube.select("event"), B)


@query("R1_seed_draws", WITH + ", " + SD + " SELECT b, system, seed, ms, n_seeds FROM sd")
def _(fx):
    return R.seed_draws(fx.spark, fx.cube.select("system", "seed"), B)


@query("R2_bootstrap_draws", BOOT + f" SELECT b, system, {cols(BOOT_COLUMNS)} FROM bt")
def _(fx):
    return rounded(draws(fx))


@query("R3_percentile_intervals", BOOT + f" SELECT system, {ci_sql(['A_P', 'A_D', 'A_O', 'T1', 'T2', 'T3', 'T4', 'T3c', 'T4c'])} FROM bt GROUP BY system")
def _(fx):
    names = ["A_P", "A_D", "A_O", "T1", "T2", "T3", "T4", "T3c", "T4c"]
    return rounded(R.percentiles(draws(fx, columns=names), ["system"], names))


@query("R3_gap_quantiles", BOOT + f" SELECT system, {ci_sql(['A_P'], R.CI_ALL)} FROM bt GROUP BY system")
def _(fx):
    return rounded(R.percentiles(draws(fx, columns=["A_P"]), ["system"], ["A_P"], R.CI_ALL))


@query("R4_share_missing_class", WITH + ", " + EV + f""", p AS (SELECT DISTINCT system, event, cls FROM cube WHERE tp+fn>0)
 SELECT system, {S.r('avg((n < (SELECT count(DISTINCT cls) FROM cube))::INT)', 'share_missing')}, count(*) AS n_draws FROM (SELECT system, b, count(DISTINCT cls) AS n FROM ed JOIN p USING (event) GROUP BY ALL) GROUP BY system""")
def _(fx):
    return rounded(R.share_missing_class(R.event_draws(fx.spark, fx.cube.select("event"), B), fx.cube))


JACK = WITH + ", lo AS (SELECT DISTINCT event AS left_out FROM cube), jc AS (SELECT l.left_out, cube.* FROM cube JOIN lo l ON l.left_out <> cube.event), " + S.level_scores("jk", "jc", "left_out, system, seed") + ", " + S.level_scores("sc", "cube", "system, seed")


@query("R8_jackknife", JACK + f""", a AS (SELECT system, avg(A_P) AS w FROM sc GROUP BY ALL), j AS (SELECT system, left_out, avg(A_P) AS v FROM jk GROUP BY ALL)
 SELECT system, {S.r('min(v)', 'jack_min')}, {S.r('max(v)', 'jack_max')}, {S.r('max(abs(v-w))', 'max_deviation')}, arg_max(left_out, (round(abs(v-w),12), left_out)) AS most_influential_event, {S.r('arg_max(v, (round(abs(v-w),12), left_out))', 'value_without_it')}
 FROM j JOIN a USING (system) GROUP BY system""")
def _(fx):
    jk = R.jackknife(fx.features).groupBy("system", "left_out").agg(F.avg("A_P").alias("A_P"))
    return rounded(R.jackknife_summary(jk, C.system_scores(fx.cube)))
