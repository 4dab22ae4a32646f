"""Queries of splits, samples, text, sources, validation, models and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gapcube.functions.columns import dbl, f1, hash32, r9, rounded
from gapcube.operators import compare as K
from gapcube.operators import cube as C
from gapcube.operators import estimands as E
from gapcube.operators import filters as FL
from gapcube.operators import fits as FIT
from gapcube.operators import inference as I
from gapcube.operators import models as M
from gapcube.operators import report as Q
from gapcube.operators import resample as R
from gapcube.operators import sampling as P
from gapcube.operators import similarity as SIM
from gapcube.operators import splits as SP
from gapcube.operators import text as N
from gapcube.operators import validate as V
from gapcube.plans import sqlparts as S
from gapcube.plans.core_queries import B, BOOT, CELLS, SCORED, SCORES, WITH, ci_sql, cols, draws
from gapcube.plans.design_queries import ARM_SC, contrib, p_sql, spearman_sql
from gapcube.plans.fixtures import (CANON, CAP, CHRONO_MIN, CUBE, DMETA, DOCS, DSPLIT, EMETA, H, META, PRED, RAW, RUNS_SQL, SYSTEMS, TMETA, WS, cube_sql, key_sql, norm_sql, pools_sql, scores_of, split_sql, strip_sql)
from gapcube.plans.registry import query
from gapcube.session import scratch_path, written
from gapcube.sources import io as IO

ESPLIT = "WITH " + EMETA + ", " + split_sql("emeta") + ", " + pools_sql("emeta")

# ---------------------------------------------------------------- P: splits and samples
@query("P1_random_holdout", "WITH " + META + ", " + split_sql("meta") + " SELECT event, item_id FROM splits WHERE in_R")
def _(fx):
    return SP.random_holdout(fx.meta).select("event", "item_id")


@query("P2_temporal_holdout", "WITH " + META + ", " + split_sql("meta") + " SELECT event, item_id FROM splits WHERE in_T")
def _(fx):
    return SP.temporal_holdout(fx.meta).select("event", "item_id")


@query("P2_temporal_cutoffs", ESPLIT + " SELECT event, min(posted_at) AS t_cutoff, count(*) AS n_T FROM splits WHERE in_T GROUP BY event")
def _(fx):
    return SP.temporal_cutoffs(SP.temporal_holdout(fx.emeta))


@query("P3_chrono_pools", "WITH " + TMETA + ", " + pools_sql("tmeta") + " SELECT event, n, first_post, n_source_events, chrono_pool_n FROM pools")
def _(fx):
    return SP.chrono_pools(fx.tmeta)


@query("P3_chrono_sources", "WITH " + TMETA + ", ev AS (SELECT event, min(posted_at) AS f FROM tmeta GROUP BY event) SELECT DISTINCT e.event, m.event AS source_event FROM ev e JOIN tmeta m ON m.posted_at < e.f AND m.event <> e.event")
def _(fx):
    return SP.chrono_sources(SP.chrono_pools(fx.tmeta))


@query("P4_future_share", "WITH " + TMETA + ", " + pools_sql("tmeta") + f" SELECT event, {S.r('1-chrono_pool_n/(sum(n) OVER ()-n)::DOUBLE', 'future_share')} FROM pools")
def _(fx):
    return rounded(SP.future_share(SP.chrono_pools(fx.tmeta)))


@query("P5_training_plan", "WITH " + TMETA + ", " + split_sql("tmeta") + ", " + pools_sql("tmeta") + """, t AS (SELECT count(*) AS a, count(*) FILTER (in_R) AS r, count(*) FILTER (in_T) AS t FROM splits),
 x AS (SELECT 'id_random' AS run_key, a-r AS pool_n, r AS eval_n, NULL::BIGINT AS o FROM t UNION ALL SELECT 'id_temporal', a-t, t, NULL FROM t UNION ALL SELECT 'loeo:'||event, a-n, n, NULL FROM pools, t
   UNION ALL SELECT 'chrono:'||event, chrono_pool_n, n, NULL FROM pools WHERE chrono_pool_n >= 3000 UNION ALL SELECT 'loeon:'||event, a-n, n, chrono_pool_n FROM pools, t WHERE chrono_pool_n >= 3000 AND chrono_pool_n < 6000)
 SELECT run_key, pool_n, eval_n, least(coalesce(o, pool_n), 6000) AS n_train FROM x""")
def _(fx):
    return P.training_plan(fx.tmeta, SP.split_items(fx.tmeta), SP.chrono_pools(fx.tmeta))


CSPLIT = "WITH " + CANON + ", " + split_sql("canon") + ", " + pools_sql("canon")


@query("P5_training_plan_with_texts", CSPLIT + """, t AS (SELECT count(*) AS a, count(*) FILTER (in_R) AS r, count(*) FILTER (in_T) AS t, count(*) FILTER (NOT in_R AND text_norm NOT IN (SELECT text_norm FROM splits WHERE in_R)) AS dr, count(*) FILTER (NOT in_T AND text_norm NOT IN (SELECT text_norm FROM splits WHERE in_T)) AS dt FROM splits),
 x AS (SELECT 'id_random' AS run_key, a-r AS pool_n, r AS eval_n, NULL::BIGINT AS o FROM t UNION ALL SELECT 'id_temporal', a-t, t, NULL FROM t UNION ALL SELECT 'id_random_dedup', dr, r, NULL FROM t UNION ALL SELECT 'id_temporal_dedup', dt, t, NULL FROM t UNION ALL SELECT 'loeo:'||event, a-n, n, NULL FROM pools, t
   UNION ALL SELECT 'chrono:'||event, chrono_pool_n, n, NULL FROM pools WHERE chrono_pool_n >= 3000 UNION ALL SELECT 'loeon:'||event, a-n, n, chrono_pool_n FROM pools, t WHERE chrono_pool_n >= 3000 AND chrono_pool_n < 6000)
 SELECT run_key, pool_n, eval_n, least(coalesce(o, pool_n), 6000) AS n_train FROM x""")
def _(fx):
    return P.training_plan(fx.canonical, csplits(fx), SP.chrono_pools(fx.canonical))


def csplits(fx):
    """The canonical corpus with both holdouts."""
    flags = SP.split_items(fx.canonical).select("item_id", "in_R", "in_T")
    return written(fx.canonical.join(flags, "item_id"), "csplits")


@query("P6_dedup_pool_temporal", CSPLIT + " SELECT item_id, event FROM splits WHERE NOT in_T AND text_norm NOT IN (SELECT text_norm FROM splits WHERE in_T)")
def _(fx):
    return P.dedup_pool(csplits(fx), "in_T").select("item_id", "event")


DEDUP = "WITH " + DSPLIT + ", dp AS (SELECT * FROM dsplit WHERE NOT in_R AND text_norm NOT IN (SELECT text_norm FROM dsplit WHERE in_R))"


@query("P6_dedup_pool", DEDUP + " SELECT item_id, event FROM dp")
def _(fx):
    return P.dedup_pool(fx.dsplit).select("item_id", "event")


GRAMS = """tok AS (SELECT item_num, in_R, unnest(string_split(text_norm, ' ')) AS w FROM dsplit WHERE text_norm <> ''),
wc AS (SELECT item_num, in_R, ' ' || w || ' ' AS w, count(*) AS c FROM tok GROUP BY ALL), nn AS (SELECT unnest([3, 4, 5]) AS n),
gr AS (SELECT item_num, in_R, substr(w, i, n) AS g, sum(c) AS tf FROM (SELECT item_num, in_R, w, c, n, unnest(range(1, len(w) - n + 2)) AS i FROM wc, nn WHERE len(w) >= n) GROUP BY ALL),
df AS (SELECT g, ln((1 + (SELECT count(*) FROM dsplit)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM gr GROUP BY g),
x AS (SELECT item_num, in_R, g, (1 + ln(tf)) * idf AS x FROM gr JOIN df USING (g)),
wt AS MATERIALIZED (SELECT item_num, in_R, g, x / sqrt(sum(x * x) OVER (PARTITION BY item_num)) AS w FROM x),
sim AS MATERIALIZED (SELECT a.item_num, b.item_num AS partner, sum(a.w * b.w) AS s FROM wt a JOIN wt b ON a.g = b.g AND NOT a.in_R AND b.in_R GROUP BY ALL),
best AS MATERIALIZED (SELECT item_num, max(round(s, 9)) AS sim, arg_max(partner, (round(s, 9), -partner)) AS partner FROM sim GROUP BY item_num HAVING max(round(s, 9)) >= 0.6)"""
NEAR = "WITH " + DSPLIT + ", " + GRAMS


@query("P7_fuzzy_dedup_pool", NEAR + ", dp AS (SELECT * FROM dsplit WHERE NOT in_R AND text_norm NOT IN (SELECT text_norm FROM dsplit WHERE in_R)) SELECT item_id, event FROM dp WHERE item_num NOT IN (SELECT item_num FROM best WHERE sim >= 0.8)")
def _(fx):
    return P.fuzzy_dedup_pool(P.dedup_pool(fx.dsplit), SIM.near_duplicates(SIM.max_similarity(fx.dsplit, 0.8))).select("item_id", "event")


def sample_sql(name, src, run_key, seeds, cap, where="TRUE", extra=""):
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT {run_key} AS run_key, s.seed, item_id, item_num, event{extra}, row_number() OVER (PARTITION BY {run_key}, s.seed ORDER BY {H(run_key, 's.seed', 'item_id')}, item_num) AS rn
  FROM {src} CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in seeds)}) s(seed) WHERE {where}) WHERE rn <= {cap})"""


@query("P8_masked_samples", "WITH " + DSPLIT + ", " + sample_sql("sp", "dsplit", "'id_random'", ["42"], P.CAP, "NOT in_R") + r""", mk AS (SELECT sp.item_id, regexp_replace(regexp_replace(d.text, '#[\p{L}\p{N}_]+', '[HASHTAG]', 'g'), '(^|[^\p{L}\p{N}_\[])(\p{Nd}[\p{Nd},.:]*)', '\1[NUM]', 'g') AS m FROM sp JOIN dsplit d USING (item_id))
 SELECT 'id_random_mask' AS run_key, item_id, md5(m) AS masked_md5 FROM mk""")
def _(fx):
    base = written(P.sample_pool(fx.dpool, "id_random", ["42"]), "sample")  # at most the cap
    return fx.docs.select("item_id", "text").join(base.select("item_id"), "item_id").select(F.lit("id_random_mask").alias("run_key"), "item_id", F.md5(N.mask_tokens("text")).alias("masked_md5"))


@query("P9_diversity_matched", ESPLIT + f""", e AS (SELECT event, n_source_events AS k, least(chrono_pool_n, {CAP}) AS need FROM pools WHERE chrono_pool_n >= {CHRONO_MIN}),
 c AS (SELECT e.event, e.k, e.need, t.t, o.event AS other, o.n AS m, row_number() OVER (PARTITION BY e.event, t.t ORDER BY {H("'divk'", 'e.event', 'CAST(t.t AS VARCHAR)', 'o.event')}, o.event) AS rk FROM e JOIN pools o ON o.event <> e.event CROSS JOIN range(200) t(t)),
 g AS (SELECT event, k, need, t, sum(m) AS pool_n, string_agg(other, ',' ORDER BY other) AS chosen FROM c WHERE rk <= k GROUP BY ALL)
 SELECT event, t AS try, k, need AS n_train, CAST(pool_n AS BIGINT) AS pool_n, chosen FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY t) AS rn FROM g WHERE pool_n >= need) WHERE rn = 1""")
def _(fx):
    return P.diversity_matched(fx.pools, CAP, CHRONO_MIN)


HELD = "(SELECT x.*, e.event AS held_out FROM emeta x JOIN (SELECT DISTINCT event FROM emeta) e ON e.event <> x.event)"
HELDOUT = "WITH " + EMETA + ", " + sample_sql("hs", HELD, "'loeo:' || held_out", ["42", "1"], P.CAP, extra=", held_out, hazard, label")


def heldout(fx, carry=("hazard", "label")):
    return P.sample_heldout(fx.emeta, ["42", "1"], carry=carry)


@query("P10_training_samples", HELDOUT + " SELECT run_key, seed, item_id FROM hs")
def _(fx):
    return heldout(fx).select("run_key", "seed", "item_id")


PAIRED = (DEDUP + ", " + sample_sql("bs", "dsplit", "'id_random'", ["42", "1"], P.CAP, "NOT in_R") + f""", kp AS (SELECT seed, item_id FROM bs WHERE item_id IN (SELECT item_id FROM dp)),
 nd AS (SELECT s.seed, least((SELECT count(*) FROM dp), {P.CAP}) - count(kp.item_id) AS need FROM (SELECT DISTINCT seed FROM bs) s LEFT JOIN kp USING (seed) GROUP BY s.seed),
 fl AS (SELECT seed, item_id FROM (SELECT nd.seed, need, dp.item_id, row_number() OVER (PARTITION BY nd.seed ORDER BY {H("'id_random_dedup|fill'", 'nd.seed', 'dp.item_id')}, dp.item_num) AS rn FROM dp CROSS JOIN nd WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.seed = nd.seed AND bs.item_id = dp.item_id)) WHERE rn <= need)
 SELECT 'id_random_dedup' AS run_key, seed, item_id FROM (SELECT * FROM kp UNION ALL SELECT * FROM fl)""")


@query("P11_paired_samples", PAIRED)
def _(fx):
    base = written(P.sample_pool(fx.dsplit.filter("NOT in_R"), "id_random", ["42", "1"]), "base")
    pool = written(P.dedup_pool(fx.dsplit), "pool")
    return P.sample_paired(base, pool, "id_random_dedup").select("run_key", "seed", "item_id")


@query("P12_full_pool_plan", ESPLIT + """, t AS (SELECT count(*) AS a, count(*) FILTER (NOT in_R) AS f FROM splits) SELECT 'id_random_full' AS run_key, f AS pool_n, f AS n_train FROM t UNION ALL SELECT 'loeo_full:'||event, a-n, f FROM pools, t""")
def _(fx):
    return P.full_pool_plan(fx.splits, fx.pools)


@query("P13_sample_fingerprints", HELDOUT + " SELECT run_key, seed, count(*) AS n_train, sha256(string_agg(CAST(item_num AS VARCHAR), ',' ORDER BY item_num)) AS train_ids_sha256 FROM hs GROUP BY ALL")
def _(fx):
    return P.sample_fingerprint(heldout(fx))


@query("P14_train_event_counts", HELDOUT + " SELECT run_key, seed, event, count(*) AS n FROM hs GROUP BY ALL")
def _(fx):
    return P.train_event_counts(heldout(fx))


CHRONO = ("WITH " + EMETA + ", " + pools_sql("emeta") + ", " + sample_sql("cs", f"(SELECT x.*, p.event AS held_out FROM emeta x JOIN pools p ON x.posted_at < p.first_post AND x.event <> p.event WHERE chrono_pool_n >= {CHRONO_MIN})", "'chrono:' || held_out", ["42"], CAP, extra=", held_out, hazard")
          + ", " + sample_sql("ls", f"(SELECT x.*, p.event AS held_out, least(chrono_pool_n, {CAP}) AS need FROM emeta x JOIN pools p ON x.event <> p.event WHERE chrono_pool_n >= {CHRONO_MIN})", "'loeon:' || held_out", ["42"], "need", extra=", held_out, hazard, need")
          + """, h1 AS (SELECT held_out, hazard, count(*) AS n FROM cs GROUP BY ALL), h2 AS (SELECT held_out, hazard, count(*) AS n FROM ls GROUP BY ALL),
 q1 AS (SELECT held_out, hazard, n/sum(n) OVER (PARTITION BY held_out) AS p FROM h1), q2 AS (SELECT held_out, hazard, n/sum(n) OVER (PARTITION BY held_out) AS p FROM h2),
 tv AS (SELECT coalesce(q1.held_out, q2.held_out) AS held_out, 0.5*sum(abs(coalesce(q1.p,0)-coalesce(q2.p,0))) AS tvd FROM q1 FULL JOIN q2 ON q1.held_out=q2.held_out AND q1.hazard=q2.hazard GROUP BY ALL)""")


def tvd(fx):
    a = P.sample_chrono(fx.emeta, fx.pools, ["42"], CAP, CHRONO_MIN, carry=("hazard",)).groupBy("held_out", "hazard").agg(F.count(F.lit(1)).alias("n"))
    b = P.sample_size_matched(fx.emeta, fx.pools, ["42"], CAP, CHRONO_MIN, carry=("hazard",)).groupBy("held_out", "hazard").agg(F.count(F.lit(1)).alias("n"))
    return P.hazard_tvd(a, b, ["held_out"])


@query("P14_hazard_distance", CHRONO + f" SELECT held_out, {S.r('tvd', 'tvd')} FROM tv")
def _(fx):
    return rounded(tvd(fx))


@query("P15_source_validation_split", "WITH " + TMETA + f""", r AS (SELECT item_id, event, row_number() OVER (ORDER BY {H("'conv'", "'2024-01-05'", "'42'", 'item_id')}, item_num) AS rn FROM tmeta WHERE event <> '2024-01-05' AND event NOT IN ('2024-01-01', '2024-01-02'))
 SELECT item_id, event, CASE WHEN rn <= 6000 THEN 'train' ELSE 'validation' END AS part FROM r WHERE rn <= 6600""")
def _(fx):
    return P.source_validation_split(fx.tmeta, "2024-01-05", ["2024-01-01", "2024-01-02"], "42")


@query("P16_cap_share", "WITH " + META + f", n AS (SELECT event, count(*) AS n FROM meta GROUP BY event), s AS (SELECT 6000.0::DOUBLE/(sum(n) OVER ()-n) AS s FROM n) SELECT {S.r('min(s)', 'share_min')}, {S.r('max(s)', 'share_max')} FROM s")
def _(fx):
    return rounded(P.cap_share(fx.meta))


# ---------------------------------------------------------------- V: validation
BAD = PRED + f""", h AS (SELECT *, {H("'bad'", 'system', 'seed', 'item_id')} AS h FROM pred WHERE NOT (system='sysB' AND event='NATION_7')),
bad AS MATERIALIZED (SELECT system, seed, CASE WHEN h%101=0 THEN item_id||'x' ELSE item_id END AS item_id, CASE WHEN h%103=1 THEN 'NATION_0' ELSE event END AS event, CASE WHEN h%107=2 THEN '5-LOW' ELSE y_true END AS y_true, CASE WHEN h%109=3 THEN 'zzz' ELSE y_pred END AS y_pred
  FROM h WHERE h%89<>4 OR system='sysZ' UNION ALL SELECT system, seed, item_id, event, y_true, y_pred FROM h WHERE h%97=5)"""


def bad(fx):
    h = F.col("h")
    x = fx.pred.filter("NOT (system = 'sysB' AND event = 'NATION_7')").withColumn("h", hash32("bad", F.col("system"), F.col("seed"), F.col("item_id")))
    broken = x.filter((h % 89 != 4) | (F.col("system") == "sysZ")).select(
        "system", "seed", F.when(h % 101 == 0, F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")).alias("item_id"), F.when(h % 103 == 1, "NATION_0").otherwise(F.col("event")).alias("event"),
        F.when(h % 107 == 2, "5-LOW").otherwise(F.col("y_true")).alias("y_true"), F.when(h % 109 == 3, "zzz").otherwise(F.col("y_pred")).alias("y_pred"))
    return broken.unionByName(x.filter(h % 97 == 5).drop("h"))


@query("V1_duplicate_rows", "WITH " + BAD + " SELECT system, seed, count(*)-count(DISTINCT item_id) AS dup_rows FROM bad GROUP BY ALL")
def _(fx):
    return V.dup_rows(bad(fx))


ROWS_SQL = "WITH " + BAD + ", j AS (SELECT b.*, m.event AS me, m.label AS ml FROM bad b LEFT JOIN meta m USING (item_id))"
for _name, _col, _cond in (("V2_unknown_items", "unknown_items", "me IS NULL"), ("V3_wrong_event", "wrong_event", "event <> me"), ("V4_wrong_label", "wrong_label", "y_true <> ml"), ("V5_stray_classes", "stray_classes", "y_pred NOT IN (SELECT cls FROM classes)")):
    def _make(column):
        return lambda fx: V.row_checks(bad(fx), fx.meta, fx.classes).select("system", "seed", column)
    query(_name, ROWS_SQL + f" SELECT system, seed, count(*) FILTER ({_cond}) AS {_col} FROM j GROUP BY ALL")(_make(_col))

COVER_SQL = ROWS_SQL + """, sz AS (SELECT event, count(*) AS size FROM meta GROUP BY event), rn AS (SELECT DISTINCT system, seed FROM bad), gt AS (SELECT system, seed, event, count(*) AS got FROM j WHERE me IS NOT NULL GROUP BY ALL),
 cv AS MATERIALIZED (SELECT rn.system, rn.seed, sz.event, coalesce(got, 0) AS got, size FROM rn CROSS JOIN sz LEFT JOIN gt ON gt.system=rn.system AND gt.seed=rn.seed AND gt.event=sz.event)"""


@query("V6_incomplete_events", COVER_SQL + " SELECT system, seed, event, got, size FROM cv WHERE got > 0 AND got <> size")
def _(fx):
    return V.event_coverage(bad(fx), fx.meta).filter("got > 0 AND got <> size").select("system", "seed", "event", "got", "size")


@query("V7_absent_events", COVER_SQL + " SELECT system, seed, event FROM cv WHERE got = 0")
def _(fx):
    return V.event_coverage(bad(fx), fx.meta).filter("got = 0").select("system", "seed", "event")


@query("V8_validation_report", COVER_SQL + """, c AS (SELECT system, seed, count(*)-count(DISTINCT item_id) AS d, count(*) FILTER (me IS NULL) AS u, count(*) FILTER (event<>me) AS we, count(*) FILTER (y_true<>ml) AS wl, count(*) FILTER (y_pred NOT IN (SELECT cls FROM classes)) AS st FROM j GROUP BY ALL),
 l AS (SELECT system, seed, count(*) FILTER (got>0 AND got<>size) AS ni, count(*) FILTER (got=0) AS na, string_agg(''''||event||'''', ', ' ORDER BY event) FILTER (got>0 AND got<>size) AS li, string_agg(''''||event||'''', ', ' ORDER BY event) FILTER (got=0) AS la FROM cv GROUP BY ALL)
 SELECT system, seed, d AS dup_rows, u AS unknown_items, we AS wrong_event, wl AS wrong_label, st AS stray_classes, ni AS n_incomplete, na AS n_absent,
  concat_ws('; ', CASE WHEN d>0 THEN d||' duplicate item rows' END, CASE WHEN u>0 THEN u||' items not in the metadata' END, CASE WHEN we>0 THEN we||' rows whose event disagrees with the metadata' END, CASE WHEN wl>0 THEN wl||' rows whose y_true disagrees with the metadata' END,
   CASE WHEN st>0 THEN st||' predictions outside the class list' END, CASE WHEN ni>0 THEN 'incomplete events: ['||li||']' END, CASE WHEN na>0 THEN 'events with no predictions: ['||la||']' END) AS problems FROM c JOIN l USING (system, seed)""")
def _(fx):
    return V.validation_report(bad(fx), fx.meta, fx.classes)


PART_SQL = WITH + ", part AS (SELECT DISTINCT system, seed, event FROM cube WHERE NOT (system='sysB' AND seed='1' AND event >= 'NATION_3'))"
PART_COMPLETE = PART_SQL + ", cs AS (SELECT p.system, p.seed, bool_and(x.event IS NOT NULL) AS complete, min(e.event) FILTER (x.event IS NULL) AS first_missing FROM (SELECT DISTINCT system, seed FROM part) p CROSS JOIN (SELECT DISTINCT event FROM cube) e LEFT JOIN part x ON x.system=p.system AND x.seed=p.seed AND x.event=e.event GROUP BY ALL)"


def part_runs(fx):
    return fx.cube.filter("NOT (system = 'sysB' AND seed = '1' AND event >= 'NATION_3')")


@query("V9_complete_seeds", PART_COMPLETE + " SELECT system, seed, complete, first_missing FROM cs")
def _(fx):
    return V.complete_seeds(part_runs(fx), fx.cube)


@query("V10_alignment", "WITH " + RUNS_SQL + """, a AS (SELECT * FROM runs WHERE run='id_random'), b AS (SELECT * FROM runs WHERE run='loeo' AND in_R) SELECT model, seed, event, count(*) AS n_items, count(*) FILTER (ya IS NULL OR yb IS NULL) AS unpaired, count(*) FILTER (NOT coalesce(listed, FALSE)) AS outside, count(*) FILTER (ya<>yb) AS label_conflicts
 FROM (SELECT coalesce(a.model,b.model) AS model, coalesce(a.seed,b.seed) AS seed, coalesce(a.event,b.event) AS event, a.y_true AS ya, b.y_true AS yb, s.in_R AS listed FROM a FULL JOIN b ON a.model=b.model AND a.seed=b.seed AND a.item_id=b.item_id LEFT JOIN splits s ON s.item_id=coalesce(a.item_id, b.item_id)) GROUP BY ALL""")
def _(fx):
    a, b = fx.runs.filter("run = 'id_random'"), fx.runs.filter("run = 'loeo' AND in_R")
    return V.assert_aligned(a, b, fx.splits.filter("in_R").select("item_id"), ["model", "seed", "event"])


@query("V11_size_matched", CHRONO + " SELECT c.held_out AS event, c.seed, c.n, l.n AS n_other, c.n = l.n AS matched FROM (SELECT held_out, seed, count(*) AS n FROM cs GROUP BY ALL) c JOIN (SELECT held_out, seed, count(*) AS n FROM ls GROUP BY ALL) l USING (held_out, seed)")
def _(fx):
    a = P.sample_chrono(fx.emeta, fx.pools, ["42"], CAP, CHRONO_MIN).groupBy(F.col("held_out").alias("event"), "seed").agg(F.count(F.lit(1)).alias("n_train")).withColumn("kind", F.lit("chrono"))
    b = P.sample_size_matched(fx.emeta, fx.pools, ["42"], CAP, CHRONO_MIN).groupBy(F.col("held_out").alias("event"), "seed").agg(F.count(F.lit(1)).alias("n_train")).withColumn("kind", F.lit("loeon"))
    return V.size_matched(a.unionByName(b), "chrono", "loeon")


@query("V12_verify_training_ids", HELDOUT + " SELECT count(DISTINCT (run_key, seed)) AS runs_checked, count(DISTINCT (run_key, seed)) FILTER (held_out='2024-01-03') AS mismatches, string_agg(DISTINCT run_key||'/'||seed, ',' ORDER BY run_key||'/'||seed) FILTER (held_out='2024-01-03') AS mismatched_runs FROM hs")
def _(fx):
    samples = written(heldout(fx), "samples")
    recorded = P.sample_fingerprint(samples).withColumn("train_ids_sha256", F.when(F.col("run_key") == "loeo:2024-01-03", F.lit("0")).otherwise(F.col("train_ids_sha256")))
    return P.verify_training_ids(samples, recorded)


@query("V13_cross_source", "WITH " + META + f""", o AS (SELECT CASE WHEN {H("'lost'", 'item_id')} % 211 = 0 THEN item_id || 'b' ELSE item_id END AS item_id, CASE WHEN {H("'moved'", 'item_id')} % 101 = 0 THEN 'NATION_0' ELSE event END AS event FROM meta),
 j AS (SELECT m.event AS ea, o.event AS eb FROM meta m FULL JOIN o ON m.item_id=o.item_id) SELECT count(ea) AS rows_a, count(eb) AS rows_b, bool_and(ea IS NOT NULL AND eb IS NOT NULL) AS same_ids, bool_and(ea IS NOT DISTINCT FROM eb) AS same_events FROM j
 UNION ALL SELECT count(*), count(*), bool_and(m.event IS NOT NULL), bool_and(m.event IS NOT DISTINCT FROM n_name) FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey LEFT JOIN meta m ON m.item_num=o_orderkey""")
def _(fx):
    """Against a second source with some other ids and events, and against the tables themselves."""
    key = F.col("item_id")
    odd = fx.meta.select(F.when(hash32("lost", key) % 211 == 0, F.concat("item_id", F.lit("b"))).otherwise(key).alias("item_id"), F.when(hash32("moved", key) % 101 == 0, "NATION_0").otherwise(F.col("event")).alias("event"))
    other = fx.table("orders").join(fx.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(fx.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    other = other.select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("n_name").alias("event"))
    return V.cross_source_check(fx.meta, odd).unionByName(V.cross_source_check(fx.meta, other))


@query("V14_text_free_release", "WITH " + CUBE + ", " + split_sql("meta") + " SELECT 'metadata' AS released, count(*) AS n FROM meta UNION ALL SELECT 'predictions', count(*) FROM pred UNION ALL SELECT 'counts', count(*) FROM cube UNION ALL SELECT 'splits', count(*) FROM splits")
def _(fx):
    released = {"metadata": fx.meta, "predictions": fx.pred, "counts": fx.cube, "splits": SP.split_items(fx.meta)}
    parts = [V.assert_no_text(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("released"), "n") for name, df in released.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- N: text
@query("N1_normalized_text", f"SELECT doc_id, md5({norm_sql('text')}) AS text_md5 FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", F.md5(N.normalize_text("text")).alias("text_md5"))


@query("N2_dedup_keys", "WITH " + DOCS + " SELECT item_id, md5(text_norm) AS key_md5 FROM docs")
def _(fx):
    return fx.docs.select("item_id", F.md5("text_norm").alias("key_md5"))


@query("N3_retweet_flags", f"SELECT doc_id, regexp_matches('RT @' || text, '^RT[{WS}]+@') AS marked, regexp_matches(text, '^RT[{WS}]+@') AS is_retweet FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", N.is_retweet(F.concat(F.lit("RT @"), "text")).alias("marked"), N.is_retweet("text").alias("is_retweet"))


@query("N4_near_duplicates", NEAR + f" SELECT d.item_id, {S.r('sim', 'sim')}, partner FROM best JOIN dsplit d USING (item_num) WHERE sim >= 0.8")
def _(fx):
    return rounded(SIM.near_duplicates(SIM.max_similarity(fx.dsplit, 0.8)).select("item_id", "sim", "partner"))


@query("N4_near_duplicate_counts", NEAR + " SELECT count(*) FILTER (sim>=0.8) AS n_near, count(*) FILTER (sim>=0.9999) AS n_exact, (SELECT count(*) FROM dsplit WHERE NOT in_R) AS n_pool FROM best")
def _(fx):
    return SIM.near_duplicate_counts(SIM.max_similarity(fx.dsplit, 0.8), fx.dsplit)


@query("N5_similarity_bands", NEAR + f""", b AS (SELECT item_num, CASE WHEN sim<0.7 THEN '0.6-0.7' WHEN sim<0.8 THEN '0.7-0.8' WHEN sim<0.9 THEN '0.8-0.9' WHEN sim<0.999 THEN '0.9-0.999' ELSE '0.999-1.01' END AS band FROM best),
 k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {H("'band'", 'CAST(item_num AS VARCHAR)')}, item_num) AS rk FROM b) SELECT band, count(*) AS n, string_agg(CAST(item_num AS VARCHAR), ',' ORDER BY item_num) FILTER (rk<=4) AS examples FROM k GROUP BY band""")
def _(fx):
    return SIM.similarity_bands(fx.sims)


@query("N6_id_times", "SELECT doc_id, epoch_ms(doc_id * 1000003 + 1288834974657) AS posted_at FROM documents")
def _(fx):
    snow = F.shiftleft(F.col("doc_id") * 1000003, 22) + F.col("doc_id")
    return fx.table("documents").select("doc_id", N.id_to_time(snow).cast("timestamp_ntz").alias("posted_at"))


@query("N7_canonical_corpus", "WITH " + CANON + " SELECT item_id, event, split, label, md5(text) AS text_md5, md5(text_norm) AS key_md5, CAST(is_retweet AS BIGINT) AS is_retweet FROM canon")
def _(fx):
    return N.build_canonical(fx.raw).select("item_id", "event", "split", "label", F.md5("text").alias("text_md5"), F.md5("text_norm").alias("key_md5"), "is_retweet")


@query("N7_id_conflicts", "WITH " + RAW + ", p AS (SELECT item_id, count(*) AS c, count(DISTINCT trim(label)) AS l FROM raw WHERE text_raw<>'' AND trim(label)<>'' GROUP BY item_id) SELECT CAST(sum(c-1) AS BIGINT) AS duplicate_ids, count(*) FILTER (l>1) AS conflicting_ids FROM p")
def _(fx):
    return N.id_conflicts(fx.raw.withColumn("label", N.strip("label")).filter("length(text_raw) > 0 AND length(label) > 0"))


LABEL_MAP = {"q0t0": "plain", "q1t0": "useful", "q0t1": "harmful", "q1t1": "harmful"}
MAP_SQL = "CASE trim(label) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_MAP.items()) + " END"


@query("N8_canonical_mapped", "WITH " + RAW + f", m AS (SELECT *, {MAP_SQL} AS lab FROM raw), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY source_order) AS rn FROM m WHERE lab IS NOT NULL) SELECT item_id, event, lab AS label, md5({norm_sql('text_raw')}) AS text_md5 FROM o WHERE rn=1 AND {norm_sql('text_raw')} <> ''")
def _(fx):
    return N.build_canonical_mapped(fx.raw, LABEL_MAP).select("item_id", "event", "label", F.md5("text").alias("text_md5"))


@query("N8_dropped_labels", "WITH " + RAW + f" SELECT trim(label) AS label, count(*) AS dropped FROM raw WHERE {MAP_SQL} IS NULL GROUP BY ALL")
def _(fx):
    return N.dropped_labels(fx.raw, LABEL_MAP)


@query("N9_combined_corpora", "WITH " + DMETA + ", u AS (SELECT item_id, event, 0 AS protected FROM dmeta WHERE hazard<>'en' UNION ALL SELECT item_id, event, 1 FROM dmeta WHERE hazard='en') SELECT event, CAST(protected AS BIGINT) AS protected, count(*) AS n, (SELECT count(*) FROM (SELECT item_id FROM u GROUP BY item_id HAVING count(*)>1)) AS repeated FROM u GROUP BY event, protected")
def _(fx):
    c = N.combine_corpora(fx.dmeta.filter("hazard <> 'en'"), fx.dmeta.filter("hazard = 'en'"))
    rep = N.repeated_ids(c).agg(F.count(F.lit(1)).alias("r"))
    return c.groupBy("event", "protected").agg(F.count(F.lit(1)).alias("n")).withColumn("repeated", rep.scalar())


@query("N10_event_profile", "WITH " + CANON + f""", d AS (SELECT event, sum(c-1) AS dup FROM (SELECT event, text_norm, count(*) AS c FROM canon GROUP BY ALL) GROUP BY event),
 q AS (SELECT event, posted_at, row_number() OVER (PARTITION BY event ORDER BY posted_at) AS rn, count(*) OVER (PARTITION BY event) AS n FROM canon),
 md AS (SELECT event, make_timestamp(CAST(floor((min(epoch_us(posted_at))+max(epoch_us(posted_at)))/2.0::DOUBLE) AS BIGINT)) AS m FROM q WHERE rn IN ((n+1)//2, (n+2)//2) GROUP BY event)
 SELECT event, count(*) AS n, min(posted_at) AS first_post, max(posted_at) AS last_post, max(m) AS median_post, {S.r('round((epoch_us(max(posted_at))-epoch_us(min(posted_at)))/86400000000.0::DOUBLE, 2)', 'span_days')}, {S.r('round(avg(is_retweet), 4)', 'retweet_share')},
   count(DISTINCT label) AS n_classes, CAST(max(dup) AS BIGINT) AS within_event_duplicate_rows FROM canon JOIN d USING (event) JOIN md USING (event) GROUP BY event""")
def _(fx):
    return rounded(N.event_profile(fx.canonical).withColumn("median_post", F.col("median_post").cast("timestamp_ntz")))


@query("N10_split_counts", "WITH " + CANON + " SELECT event, split, count(*) AS n FROM canon GROUP BY ALL")
def _(fx):
    return N.split_counts(fx.canonical)


@query("N11_leakage", "WITH " + CANON + """ SELECT (SELECT count(*) FROM canon t WHERE split='test' AND EXISTS (SELECT 1 FROM canon o WHERE o.event=t.event AND o.split<>'test' AND o.text_norm=t.text_norm)) AS leaked_test_rows,
 (SELECT count(*) FROM (SELECT text_norm FROM canon GROUP BY text_norm HAVING count(DISTINCT event)>1)) AS cross_event_texts""")
def _(fx):
    return N.leakage_counts(fx.canonical)


@query("N11_shared_with_source", "WITH " + DOCS + " SELECT event, count(*) FILTER (text_norm IN (SELECT text_norm FROM docs WHERE hazard='en')) AS shared_rows FROM docs WHERE hazard<>'en' GROUP BY event")
def _(fx):
    return N.shared_with(fx.docs.filter("hazard <> 'en'"), fx.docs.filter("hazard = 'en'"))


@query("N12_corpus_facts", "WITH " + DSPLIT + f""", s AS (SELECT *, hazard AS label FROM dsplit), c AS (SELECT event, label, count(*) AS n, count(*) FILTER (in_R) AS r FROM s GROUP BY ALL), k AS (SELECT count(DISTINCT label) AS k FROM s),
 e AS (SELECT event, count(*) AS p, sum(r) AS r FROM c GROUP BY event)
 SELECT max(k) AS n_classes, count(*) AS n_events, min(p) AS classes_per_event_min, max(p) AS classes_per_event_max, count(*) FILTER (p<k) AS events_lacking_a_class, {S.r('avg(k-p)', 'mean_absent_classes')}, CAST(floor(median(r)) AS BIGINT) AS R_size_median,
  (SELECT count(*) FROM c WHERE r>0) AS R_cells_present, {S.r('(SELECT avg((r<5)::INT) FROM c WHERE r>0)', 'R_cells_lt5_share')}, (SELECT CAST(min(r) AS BIGINT) FROM (SELECT label, sum(r) AS r FROM c WHERE r>0 GROUP BY label)) AS pooled_R_min_class,
  (SELECT CAST(sum(n-1) AS BIGINT) FROM (SELECT event, text_norm, count(*) AS n FROM s GROUP BY ALL)) AS within_event_duplicate_rows FROM e, k""")
def _(fx):
    return rounded(N.corpus_facts(fx.dsplit.withColumn("label", F.col("hazard"))))


@query("N13_masked_tokens", r"WITH m AS (SELECT text, regexp_replace(regexp_replace(text, '#[\p{L}\p{N}_]+', '[HASHTAG]', 'g'), '(^|[^\p{L}\p{N}_\[])(\p{Nd}[\p{Nd},.:]*)', '\1[NUM]', 'g') AS k FROM documents) SELECT count(*) AS n, " + S.r("avg((k<>text)::INT)", "share_changed") + ", CAST(sum(len(k)) AS BIGINT) AS masked_chars FROM m")
def _(fx):
    return rounded(N.mask_summary(fx.table("documents")))


def doc_pred_sql(run, acc):
    k = f"'{run}', s.seed, d.item_id"
    parts = k.split(", ")
    return f"SELECT s.seed, d.item_id, d.event, d.hazard AS y_true, CASE WHEN {H(*parts)} % 100 < {acc} THEN d.hazard ELSE c.cls END AS y_pred FROM dsplit d CROSS JOIN (VALUES ('42'),('1')) s(seed) JOIN lc c ON c.ci = {H("'alt'", *parts)} % (SELECT count(*) FROM lc) WHERE d.in_R"


def doc_pred(fx, run, acc):
    langs = C.class_list(fx.docs.select(F.col("hazard").alias("label")))
    x = fx.dsplit.filter("in_R").withColumn("classes", langs.scalar()).select("*", F.explode(F.array(F.lit("42"), F.lit("1"))).alias("seed"))
    key = (F.lit(run), F.col("seed"), F.col("item_id"))
    alt = F.element_at("classes", (hash32("alt", *key) % F.size("classes") + 1).cast("int"))
    return x.select("seed", "item_id", "event", F.col("hazard").alias("y_true"), F.when(hash32(*key) % 100 < acc, F.col("hazard")).otherwise(alt).alias("y_pred"))


N14 = ("WITH " + DSPLIT + ", " + GRAMS.rsplit("sim AS MATERIALIZED", 1)[0] + sample_sql("sp", "dsplit", "'id_random'", ["42", "1"], P.CAP, "NOT in_R")
       + f""", sim AS MATERIALIZED (SELECT a.item_num AS t, b.item_num AS p, sum(a.w*b.w) AS s FROM wt a JOIN wt b ON a.g=b.g AND a.in_R AND NOT b.in_R GROUP BY ALL),
 bs AS (SELECT sp.seed, t AS item_num, max(s) AS s FROM sim JOIN sp ON sp.item_num=sim.p GROUP BY ALL), lc AS (SELECT hazard AS cls, row_number() OVER (ORDER BY hazard)-1 AS ci FROM (SELECT DISTINCT hazard FROM docs)),
 pa AS ({doc_pred_sql('id_random', 75)}), pb AS ({doc_pred_sql('loeo', 60)}),
 rw AS MATERIALIZED (SELECT pa.seed, pa.y_true, pa.y_pred AS ya, pb.y_pred AS yb, CASE WHEN round(coalesce(s,0),9)<0.5 THEN '0.0-0.5' WHEN round(s,9)<0.8 THEN '0.5-0.8' ELSE '0.8-1.01' END AS stratum FROM pa JOIN pb USING (seed, item_id) JOIN dsplit d USING (item_id) LEFT JOIN bs ON bs.seed=pa.seed AND bs.item_num=d.item_num),
 lg AS (SELECT seed, stratum, 'a' AS arm, y_true, ya AS y FROM rw UNION ALL SELECT seed, stratum, 'b', y_true, yb FROM rw),
 cc AS (SELECT seed, stratum, arm, cls, count(*) FILTER (y_true=cls AND y=cls) AS tp, count(*) FILTER (y_true<>cls AND y=cls) AS fp, count(*) FILTER (y_true=cls AND y<>cls) AS fn FROM lg CROSS JOIN lc GROUP BY ALL),
 ff AS (SELECT seed, stratum, arm, avg({S.f1()}) AS f, sum(tp+fn) AS n FROM cc WHERE tp+fn>0 GROUP BY ALL)
 SELECT stratum, {S.r('avg(a.f-b.f)', 'pooled_e2_mean')}, CAST(sum(a.n) AS BIGINT) AS n_rows, count(*) AS n_seeds FROM ff a JOIN ff b USING (seed, stratum) WHERE a.arm='a' AND b.arm='b' GROUP BY stratum""")


@query("N14_similarity_strata", N14)
def _(fx):
    samples = P.sample_pool(fx.dsplit.filter("NOT in_R"), "id_random", ["42", "1"])
    sims = SIM.sample_similarity(fx.dsplit, written(samples, "samples"), 0.5)
    return rounded(SIM.similarity_strata(sims, doc_pred(fx, "id_random", 75), doc_pred(fx, "loeo", 60)))


# ---------------------------------------------------------------- FL on texts and samples, K9 on samples
FLAGGED = DMETA + ", sh AS (SELECT text_norm FROM dmeta GROUP BY text_norm HAVING count(DISTINCT event)>1)"


@query("FL6_cross_event_duplicates", "WITH " + DOCS + ", sh AS (SELECT text_norm FROM docs GROUP BY text_norm HAVING count(DISTINCT event)>1) SELECT item_id, event FROM docs WHERE text_norm IN (SELECT text_norm FROM sh)")
def _(fx):
    return FL.cross_event_duplicates(fx.docs)


@query("FL7_within_event_duplicates", "WITH " + DOCS + ", k AS (SELECT *, row_number() OVER (PARTITION BY event, text_norm ORDER BY item_num) AS rn FROM docs) SELECT item_id, event FROM k WHERE rn>1")
def _(fx):
    return FL.within_event_duplicates(fx.docs)


LANGS = ", lc AS (SELECT hazard AS cls, row_number() OVER (ORDER BY hazard)-1 AS ci FROM (SELECT DISTINCT hazard FROM docs))"


def all_docs_pred_sql():
    return doc_pred_sql("loeo", 60).replace("dsplit d", "docs d").replace(" WHERE d.in_R", "")


def all_docs_pred(fx):
    class View:
        docs, dsplit = fx.docs, fx.docs.withColumn("in_R", F.lit(True))
    return doc_pred(View, "loeo", 60)


SYSTEM_RUNS = "system, seed"


def gap_without(drop, flag_sql):
    """A_P with and without the flagged rows, with percentile intervals over crossed draws of the events left."""
    def side(k, rows):
        return (f"p{k} AS (SELECT 'docs' AS system, p0.* FROM p0{rows}), " + cube_sql(f"c{k}", f"p{k}", "lc", SYSTEM_RUNS) + ", " + S.level_scores(f"s{k}", f"c{k}", SYSTEM_RUNS) + ", " + S.features(f"f{k}", f"c{k}", SYSTEM_RUNS) + ", "
                + f"e{k} AS (SELECT event, row_number() OVER (ORDER BY event)-1 AS pos, count(*) OVER () AS sz FROM (SELECT DISTINCT event FROM c{k})), d{k} AS MATERIALIZED (SELECT b, e.event, count(*) AS m FROM (SELECT b, {H("'ev'", 'CAST(b AS VARCHAR)', 'CAST(s.pos AS VARCHAR)')} % s.sz AS pos FROM range({B}) r(b) CROSS JOIN e{k} s) d JOIN e{k} e USING (pos) GROUP BY ALL), "
                + S.sums(f"w{k}", f"f{k}", f"b, {SYSTEM_RUNS}", "m", f"JOIN d{k} USING (event)") + ", " + S.scores(f"y{k}", f"w{k}", f"b, {SYSTEM_RUNS}") + f", z{k} AS (SELECT b, sum(A_P*ms)/max(n_seeds) AS A_P FROM y{k} JOIN sd USING (b, system, seed) GROUP BY b)")
    seeds = f"""ss AS (SELECT system, seed, row_number() OVER (ORDER BY seed)-1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT 'docs' AS system, seed FROM p0)),
 sd AS MATERIALIZED (SELECT b, s.system, s.seed, count(*) AS ms, max(s.size) AS n_seeds FROM (SELECT b, u.system, {H("'sd'", 'u.system', 'CAST(b AS VARCHAR)', 'CAST(u.pos AS VARCHAR)')} % u.size AS pos FROM range({B}) r(b) CROSS JOIN ss u) d JOIN ss s USING (system, pos) GROUP BY ALL)"""
    sql = ("WITH " + DOCS + LANGS + f", dr AS ({flag_sql}), p0 AS MATERIALIZED ({all_docs_pred_sql()}), {seeds}, " + side(1, " WHERE item_id NOT IN (SELECT item_id FROM dr)") + ", " + side(2, "")
           + f" SELECT {S.r('(SELECT avg(A_P) FROM s1)', 'A_P')}, {S.r('(SELECT avg(A_P) FROM s2)', 'A_P_all')}, (SELECT count(*) FROM dr) AS dropped, "
           + ", ".join(S.r(f"(SELECT quantile_cont(A_P, {q}) FROM z{k})", n) for k, q, n in ((1, 0.025, "A_P_lo95"), (1, 0.975, "A_P_hi95"), (2, 0.025, "A_P_all_lo95"), (2, 0.975, "A_P_all_hi95"))))

    def fn(fx):
        flagged = written(drop(fx.docs).select("item_id"), "flagged")
        pred = written(all_docs_pred(fx).withColumn("system", F.lit("docs")), "docs-pred")
        langs = C.class_list(fx.docs.select(F.col("hazard").alias("label")))
        seeds = R.seed_draws(fx.spark, pred.select("system", "seed"), B)

        def gap(rows, name):
            cube = written(C.confusion_cube(rows, langs), "cube")
            point = C.score_cube(cube).groupBy("system").agg(F.avg("A_P").alias(name))
            drawn = R.bootstrap(C.cell_features(cube), R.event_draws(fx.spark, cube.select("event"), B), seeds, ["A_P"]).withColumnRenamed("A_P", name)
            return point.join(R.percentiles(drawn, ["system"], [name]), "system")
        n = flagged.agg(F.count(F.lit(1)).alias("n"))
        both = gap(pred.join(flagged, "item_id", "left_anti"), "A_P").join(gap(pred, "A_P_all"), "system")
        return rounded(both.withColumn("dropped", n.scalar()).drop("system"))
    return sql, fn


for _name, _drop, _flag in (("FL6_gap_without_cross_event_duplicates", FL.cross_event_duplicates, "SELECT item_id FROM docs WHERE text_norm IN (SELECT text_norm FROM docs GROUP BY text_norm HAVING count(DISTINCT event)>1)"),
                            ("FL7_gap_without_within_event_duplicates", FL.within_event_duplicates, "SELECT item_id FROM (SELECT *, row_number() OVER (PARTITION BY event, text_norm ORDER BY item_num) AS rn FROM docs) WHERE rn>1")):
    _sql, _fn = gap_without(_drop, _flag)
    query(_name, _sql)(_fn)

MHELD = "(SELECT x.*, e.event AS held_out FROM meta x JOIN (SELECT DISTINCT event FROM meta) e ON e.event <> x.event)"


@query("FL5_zero_cells", WITH + ", " + sample_sql("hs", MHELD, "'loeo:' || held_out", ["42", "1", "2", "0"], P.CAP, extra=", held_out, label") + f""", tr AS (SELECT q.system, hs.held_out AS event, hs.label AS cls, hs.seed, count(*) AS n FROM hs JOIN (SELECT DISTINCT system, seed FROM cube) q USING (seed) GROUP BY ALL), ta AS (SELECT system, event, cls, avg(n) AS tn FROM tr GROUP BY ALL),
 c AS (SELECT system, event, cls, max(tp+fn) AS support, avg({S.f1()}) AS f1 FROM cube WHERE tp+fn>0 GROUP BY ALL), z AS (SELECT * FROM c WHERE support>=50 AND f1<0.05),
 vt AS (SELECT system, event, y_true AS cls, y_pred, count(*) AS v FROM pred GROUP BY ALL), tp_ AS (SELECT system, event, cls, arg_max(y_pred, (v, y_pred)) AS top, max(v)/sum(v) AS sh FROM vt GROUP BY ALL)
 SELECT z.system, z.event, z.cls, support, {S.r('f1', 'f1')}, top AS top_prediction, {S.r('sh', 'top_prediction_share')}, {S.r('coalesce(tn, 0)', 'train_sample_n_mean')}, (SELECT count(*) FROM meta WHERE label=z.cls AND event<>z.event) AS train_events_n FROM z JOIN tp_ USING (system, event, cls) LEFT JOIN ta USING (system, event, cls)""")
def _(fx):
    s = P.sample_heldout(fx.meta, ["42", "1", "2", "0"], carry=("label",)).groupBy("held_out", "seed", "label").agg(F.count(F.lit(1)).alias("n"))
    runs = fx.cube.select("system", "seed").distinct()
    per = s.join(runs, "seed").select("system", "seed", F.col("held_out").alias("event"), "label", "n")
    return rounded(FL.zero_cells(fx.cube, fx.pairs, per, FL.cell_sizes(fx.meta), 50, 0.05))


@query("K9_dose_against_e2", ARM_SC + ", " + sample_sql("sp", "splits", "'id_random'", ["42", "1", "2"], P.CAP, "NOT in_R") + """, dz AS (SELECT event, count(*)/3.0 AS dose FROM sp GROUP BY event), xm AS (SELECT a.model, a.event, avg(a.f1_P-b.f1_P) AS x FROM asc__ev a JOIN asc__ev b USING (model, seed, event) WHERE a.arm='a' AND b.arm='b' GROUP BY ALL), dj AS (SELECT model, dose, x FROM xm JOIN dz USING (event)), """
       + spearman_sql("r", "dj", "model", "dose", "x") + f" SELECT model, n, {S.r('rho', 'rho')}, {S.r(p_sql(), 'p')} FROM r")
def _(fx):
    s = P.sample_pool(fx.splits.filter("NOT in_R"), "id_random", ["42", "1", "2"])
    dose = s.groupBy("event").agg((F.count(F.lit(1)) / 3.0).alias("dose"))
    j = I.event_means(contrib(fx), ["model"]).join(dose, "event")
    return rounded(I.with_spearman_p(I.spearman(j, ["model"], "dose", "x")))


@query("K9_hazard_distance_against_e5", CHRONO.replace("WITH " + EMETA + ", " + pools_sql("emeta"), ARM_SC, 1) + """, xm AS (SELECT a.model, a.event, avg(a.f1_P-b.f1_P) AS x FROM asc__ev a JOIN asc__ev b USING (model, seed, event) WHERE a.arm='n' AND b.arm='k' GROUP BY ALL), dj AS (SELECT model, round(tvd,12) AS tvd, x FROM xm JOIN tv ON tv.held_out=xm.event), """
       + spearman_sql("r", "dj", "model", "tvd", "x") + f" SELECT model, n, {S.r('rho', 'rho')}, {S.r(p_sql(), 'p')} FROM r")
def _(fx):
    j = I.event_means(contrib(fx, "n", "k"), ["model"]).join(tvd(fx).select(F.col("held_out").alias("event"), F.round("tvd", 12).alias("tvd")), "event")
    return rounded(I.with_spearman_p(I.spearman(j, ["model"], "tvd", "x")))


# ---------------------------------------------------------------- S: sources and sinks
def files(fx):
    return [f"{fx.run_tree}/confirm/orders/*/*/*/*.csv.gz"]


@query("S1_read_predictions", "WITH " + PRED + " SELECT event, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL")
def _(fx):
    return IO.read_predictions(fx.spark, files(fx)).groupBy("event", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("S2_read_meta", "WITH " + META + " SELECT item_id, event, hazard, label FROM meta")
def _(fx):
    path = scratch_path(fx.spark, "meta")
    fx.meta.select("item_id", "event", "hazard", "label").write.option("sep", "\t").option("header", True).csv(path)
    return IO.read_meta(fx.spark, path)


PROB = PRED + f""", sx AS (SELECT system, seed, p.item_id, p.event, cls, ({H("'p'", 'p.item_id', 'cls')} % 1000 + CASE WHEN cls=y_pred THEN 1000 ELSE 0 END)/1000.0::DOUBLE AS s FROM pred p CROSS JOIN classes),
 pb AS MATERIALIZED (SELECT system, seed, item_id, event, cls, exp(s-max(s) OVER i)/sum(exp(s)) OVER i*exp(max(s) OVER i) AS pr FROM sx WINDOW i AS (PARTITION BY system, seed, item_id))"""


@query("S3_read_probabilities", "WITH " + PROB + " SELECT event, cls, count(*) AS n, CAST(sum(round(round_even(pr, 4) * 10000)) AS BIGINT) AS sum_p_e4 FROM pb GROUP BY ALL")
def _(fx):
    x = IO.read_scored(fx.spark, files(fx)).select("event", F.explode("p").alias("cls", "pr"))
    return x.groupBy("event", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("pr") * 10000).cast("bigint")).alias("sum_p_e4"))


@query("S4_path_keys", "WITH " + PRED + " SELECT 'confirm' AS plan, 'orders' AS corpus, system AS model, seed, 'loeo:all' AS run_key, count(*) AS n FROM pred GROUP BY ALL")
def _(fx):
    x = IO.with_path_keys(IO.read_predictions(fx.spark, files(fx), keep_path=True))
    return x.groupBy("plan", "corpus", "model", "seed", "run_key").agg(F.count(F.lit(1)).alias("n"))


def run_records(fx):
    """One record per held-out run, from its sample."""
    s = written(heldout(fx), "samples")
    counts = P.train_event_counts(s).groupBy("run_key", "seed").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("train_event_counts"))
    fp = P.sample_fingerprint(s)
    plan = F.when(hash32(F.col("run_key")) % 2 == 0, "tfidf").otherwise("confirm")
    return fp.join(counts, ["run_key", "seed"]).select("run_key", plan.alias("plan"), F.lit("events").alias("corpus"), F.lit("m").alias("model"), "seed", F.struct(F.lit(P.CAP).cast("bigint").alias("cap"), F.lit(0.2).alias("frac")).alias("settings"),
                                                       "n_train", "train_ids_sha256", "train_event_counts", (hash32(F.col("run_key"), F.col("seed")) % 1000 / 10.0).alias("elapsed_sec"))


def stored_runs(fx):
    path = scratch_path(fx.spark, "records")
    run_records(fx).write.json(path)
    return IO.read_runs(fx.spark, path)


@query("S5_read_run_records", HELDOUT + f" SELECT run_key, seed, CAST({P.CAP} AS BIGINT) AS cap, event, count(*) AS n FROM hs GROUP BY ALL")
def _(fx):
    return stored_runs(fx).select("run_key", "seed", F.col("settings.cap").alias("cap"), F.explode("train_event_counts").alias("event", "n"))


@query("S6_read_split_manifest", ESPLIT + " SELECT event, item_num, 'R' AS part FROM splits WHERE in_R UNION ALL SELECT event, item_num, 'T' FROM splits WHERE in_T")
def _(fx):
    path = scratch_path(fx.spark, "manifest")
    IO.write_splits(fx.splits, fx.pools, path)
    return IO.read_splits(fx.spark, path)[1]


def flat():
    """Texts without quotes, tabs and line breaks, as the unquoted file form needs."""
    return F.regexp_replace("text_raw", r"[\s\"]+", " ")


RAW_SQL = "WITH " + RAW + r" SELECT event, split, trim(label) AS label, count(*) AS n, CAST(sum(len(regexp_replace(text_raw, '[\s" + '"' + r"]+', ' ', 'g'))) AS BIGINT) AS chars FROM raw GROUP BY ALL"


def raw_summary(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text_raw")).alias("chars"))


@query("S7_read_raw_tsv", RAW_SQL)
def _(fx):
    path = scratch_path(fx.spark, "rawtsv")
    x = fx.raw.select("item_id", flat().alias("text_raw"), "label", F.concat("event", F.lit("_"), "split").alias("stem"))
    x.write.partitionBy("stem").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return raw_summary(IO.read_raw_tsv(fx.spark, path + "/*"), "event", "split", "label")


@query("S8_read_raw_csv", "WITH " + RAW + r", z AS (SELECT lower(event) AS event, trim(label) AS label, count(*) AS n, CAST(sum(len(ltrim(regexp_replace(text_raw, '[\s" + '"' + r"]+', ' ', 'g')))) AS BIGINT) AS chars FROM raw GROUP BY ALL) SELECT event, 'type_' || event AS hazard, label, n, chars FROM z")
def _(fx):
    path, desc = scratch_path(fx.spark, "rawcsv"), scratch_path(fx.spark, "desc")
    x = fx.raw.select("item_id", flat().alias("text_raw"), F.lit(" web").alias("source"), F.concat(F.lit(" "), "label").alias("label"), F.initcap("event").alias("event_dir"))
    x.write.partitionBy("event_dir").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    fx.raw.select("event").distinct().select("event", F.struct(F.concat(F.lit(" Type "), "event").alias("type")).alias("categorization")).write.json(desc)
    return raw_summary(IO.read_raw_csv(fx.spark, path + "/*", desc), "event", "hazard", "label")


@query("S9_read_raw_json", "WITH " + RAW + " SELECT event, split, trim(label) AS label, count(*) AS n, CAST(sum(len(text_raw)) AS BIGINT) AS chars FROM raw GROUP BY ALL")
def _(fx):
    path = scratch_path(fx.spark, "rawjson")
    x = fx.raw.select(F.col("event").alias("event_dir"), F.col("split").alias("split_dir"), "source_order", "item_id", "text_raw", "label")
    IO.write_json_arrays(x, ["event_dir", "split_dir"], "source_order", path)
    return raw_summary(IO.read_raw_json(fx.spark, path + "/*/*"), "event", "split", "label")


INDEX_SQL = PART_COMPLETE + ", ix AS (SELECT system, 'orders' AS corpus, string_agg(seed, ',' ORDER BY CAST(seed AS BIGINT)) AS seeds, 'runs/orders/' || system || '/seed{seed}/*' AS preds, 'meta.tsv' AS meta FROM cs WHERE complete GROUP BY system)"


def system_index(fx):
    return IO.build_system_index(V.complete_seeds(part_runs(fx), fx.cube).withColumn("corpus", F.lit("orders")), "runs", "meta.tsv")


@query("S10_resolve_system", INDEX_SQL + " SELECT system, corpus, meta, replace(preds, '{seed}', '42') AS preds FROM ix WHERE system='sysB'")
def _(fx):
    return IO.resolve_system(written(system_index(fx), "index"), "orders", "sysB", "42")


@query("S11_system_index", INDEX_SQL + " SELECT system, corpus, seeds, preds, meta FROM ix")
def _(fx):
    return system_index(fx)


@query("S12_score_documents", SCORED + f" SELECT system, seed, {cols(['pooled_P', 'per_event_P', 'A_P'])}, (SELECT count(*) FROM sc_ev e WHERE e.system=sc.system AND e.seed=sc.seed) AS n_events, (SELECT count(*) FROM cube) AS n_cells FROM sc")
def _(fx):
    path = scratch_path(fx.spark, "scores")
    s = rounded(C.score_cube(fx.cube).select("system", "seed", "pooled_P", "per_event_P", "A_P"))
    IO.write_scores(IO.score_document(s, C.event_scores(fx.cube), C.RUN), C.cell_metrics(fx.cube), path)
    doc = fx.spark.read.schema("system STRING, seed STRING, document STRING").json(path + "/scores")
    d = F.from_json("document", "pooled_P DOUBLE, per_event_P DOUBLE, A_P DOUBLE, events ARRAY<STRUCT<event: STRING>>")
    cells = fx.spark.read.option("sep", "\t").option("header", True).csv(path + "/event_class_counts").agg(F.count(F.lit(1)).alias("n"))
    return doc.select("system", "seed", d.alias("d")).select("system", "seed", "d.pooled_P", "d.per_event_P", "d.A_P", F.size("d.events").cast("bigint").alias("n_events")).withColumn("n_cells", cells.scalar())


@query("S13_written_predictions", "WITH " + PRED + " SELECT system AS model, seed, item_id, event, y_true, y_pred FROM pred")
def _(fx):
    rows = IO.with_path_keys(IO.read_predictions(fx.spark, files(fx), keep_path=True))
    return rows.select("model", "seed", "item_id", "event", "y_true", "y_pred")


@query("S14_file_hashes", "SELECT TRUE AS same_hash, CAST(64 AS INTEGER) AS digits, CAST(14 AS BIGINT) AS files FROM (SELECT count(*) AS n FROM orders)")
def _(fx):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return IO.same_hashes(IO.file_sha256(fx.spark, [f"{fx.dir}/{n}.parquet" for n in names]), [f"{n}.parquet" for n in names])


@query("S14_config_hashes", SCORED + """ SELECT system, seed, sha256('{"convention": "P", "min_cell": 0, "seed": "'||seed||'", "system": "'||system||'"}') AS config_hash FROM sc""")
def _(fx):
    text = IO.sorted_json({"system": IO.quoted(F.col("system")), "seed": IO.quoted(F.col("seed")), "convention": F.lit('"P"'), "min_cell": F.lit("0")})
    return C.score_cube(fx.cube).select("system", "seed", IO.config_hash(text).alias("config_hash"))


def event_files(fx):
    """One file per event with its item ids, a line each, in the order of their numbers."""
    path = scratch_path(fx.spark, "event-ids")
    rows = fx.meta.select("event", "item_num", F.col("item_id").alias("value"))
    rows.repartition("event").sortWithinPartitions("event", "item_num").select("event", "value").write.partitionBy("event").text(path)
    return path


EVENT_FILES = "WITH " + META + ", f AS (SELECT event, string_agg(item_id || chr(10), '' ORDER BY item_num) AS body FROM meta GROUP BY event)"


@query("S14_event_file_hashes", EVENT_FILES + " SELECT event, CAST(len(body) AS BIGINT) AS length, sha256(body) AS sha256 FROM f")
def _(fx):
    h = IO.file_sha256(fx.spark, [event_files(fx) + "/*/*.txt"])
    return h.select(F.regexp_extract("path", "/event=([^/]+)/", 1).alias("event"), "length", "sha256")


INVENTORY = (("odd_events", r"/event=[^/]*[13579]/[^/]*\.txt$"), ("even_events", r"/event=[^/]*/[^/]*\.txt$"))


@query("S15_artifact_inventory", EVENT_FILES + " SELECT CASE WHEN regexp_matches(event, '[13579]$') THEN 'odd_events' ELSE 'even_events' END AS artifact_group, count(*) AS files, CAST(sum(len(body)) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def _(fx):
    return IO.artifact_inventory(IO.list_files(fx.spark, [event_files(fx)]), INVENTORY)


@query("S16_run_totals", HELDOUT + f", r AS (SELECT DISTINCT run_key, seed FROM hs) SELECT count(*) AS n_runs, {S.r('sum(' + H('run_key', 'seed') + ' % 1000 / 10.0)/3600', 'hours')}, count(*) FILTER ({H('run_key')} % 2 = 0) AS n_tfidf_runs FROM r")
def _(fx):
    return rounded(IO.run_stats(stored_runs(fx)))


@query("S17_run_ledger", HELDOUT + " SELECT run_key || '-s' || seed AS run_id, 'succeeded' AS status, CAST(0 AS BIGINT) AS exit_code, sha256(string_agg(CAST(item_num AS VARCHAR), ',' ORDER BY item_num)) AS sha256 FROM hs GROUP BY run_key, seed")
def _(fx):
    path = scratch_path(fx.spark, "ledger")
    fp = written(P.sample_fingerprint(heldout(fx)).select(F.concat("run_key", F.lit("-s"), "seed").alias("run_id"), "seed", F.col("train_ids_sha256").alias("sha256"), F.lit("train_ids").alias("path")), "fp")
    for seed in ("42", "1", "42"):  # the first job is repeated
        part = fp.filter(F.col("seed") == seed)
        IO.append_ledger(part, part, path, "seed" + seed)
    return IO.read_ledger(fx.spark, path).select("run_id", "status", "exit_code", F.explode("output_artifacts").alias("a")).select("run_id", "status", "exit_code", "a.sha256")


# ---------------------------------------------------------------- M: models
TERMS_SQL = r"""tk AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM docs), to_ AS MATERIALIZED (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM tk), tm AS (SELECT item_id, word AS term FROM to_ UNION ALL SELECT * FROM (SELECT item_id, word || ' ' || lead(word) OVER (PARTITION BY item_id ORDER BY pos) AS term FROM to_) WHERE term IS NOT NULL),
 tf AS MATERIALIZED (SELECT item_id, term, count(*) AS tf FROM tm GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*)>=2),
 tx AS (SELECT item_id, term, (1+ln(tf))*(ln((1+(SELECT count(*) FROM docs))/(1.0::DOUBLE+df))+1) AS x FROM tf JOIN df USING (term)), tw AS (SELECT item_id, term, x/sqrt(sum(x*x) OVER (PARTITION BY item_id)) AS w FROM tx)"""


@query("M1_tfidf_weights", "WITH " + DOCS + ", " + TERMS_SQL + f" SELECT item_id, count(*) AS n_terms, round(sum(w), 6) AS sum_w, {S.r('max(w)', 'max_w')}, {S.r('sum(w*w)', 'norm2')} FROM tw GROUP BY item_id")
def _(fx):
    w = M.tfidf_weights(fx.docs.select("item_id", "text"))
    return rounded(w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("w"), 6).alias("sum_w"), F.max("w").alias("max_w"), F.sum(F.col("w") * F.col("w")).alias("norm2")))


def fit_corpus(fx):
    return written(fx.docs.select("item_id", "item_num", "event", "text", F.col("hazard").alias("label")), "corpus")


SEEDS = ("42", "1")


def heldout_predictions(fx, seeds):
    """Predictions of every event by models fitted on capped samples of the others."""
    corpus = fit_corpus(fx)
    labels = C.class_list(corpus.select("label")).head()[0]
    return FIT.heldout_fit_predict(corpus, written(P.sample_heldout(corpus, seeds), "samples"), labels)


@query("M2_logistic_regression", "WITH " + DOCS + " SELECT item_id, event, hazard AS y_true, TRUE AS in_classes, CAST(1000000 AS BIGINT) AS sum_p_e6 FROM docs")
def _(fx):
    x = heldout_predictions(fx, SEEDS[:1])
    total = F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, b: a + b)
    return x.select("item_id", "event", "y_true", F.array_contains(F.map_keys("p"), F.col("y_pred")).alias("in_classes"), F.round(total * 1e6).cast("bigint").alias("sum_p_e6"))


@query("M3_heldout_fit_predict", "WITH " + DOCS + f" SELECT 'loeo:' || event AS run_key, s.seed, event, hazard AS y_true, count(*) AS n, count(*) AS sum_p, TRUE AS beats_chance FROM docs CROSS JOIN (VALUES {', '.join(f'({s!r})' for s in SEEDS)}) s(seed) GROUP BY ALL")
def _(fx):
    x = written(heldout_predictions(fx, SEEDS), "predictions")
    per = x.groupBy("run_key", "seed", "event", "y_true").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, b: a + b))).cast("bigint").alias("sum_p"))
    right = x.agg((F.avg((F.col("y_true") == F.col("y_pred")).cast("double")) > 1.0 / F.first(F.size("p"))).alias("b"))  # over all runs
    return per.withColumn("beats_chance", right.scalar())


@query("M4_argmax_softmax", "WITH " + PROB + f", tp_ AS (SELECT system, seed, item_id, arg_min(cls, (-s, cls)) AS y_pred FROM sx GROUP BY ALL) SELECT system, seed, event, cls, count(*) FILTER (y_pred=cls) AS n_pred, CAST(sum(round(round_even(pr, 4) * 10000)) AS BIGINT) AS sum_p_e4 FROM pb JOIN tp_ USING (system, seed, item_id) GROUP BY ALL")
def _(fx):
    # the part of a class score that no run changes is drawn once per item; sums per class are columns until the rows are reduced
    items = fx.meta.withColumn("classes", fx.classes.scalar()).withColumn("draws", F.transform("classes", lambda c: hash32("p", F.col("item_id"), c) % 1000)).drop("classes")
    scores = F.zip_with("draws", "classes", lambda d, c: (d + F.when(c == F.col("y_pred"), 1000).otherwise(0)) / 1000.0)
    x = M.score_arrays(fx.predictions(items, SYSTEMS, ["draws"]).withColumn("classes", fx.classes.scalar()), F.col("classes"), scores)
    return M.class_totals(x, ["system", "seed", "event"], fx.classes.head()[0])


@query("M5_prior_matching", "WITH " + PROB + """, q AS (SELECT system, seed, event, y_true AS cls, count(*) AS c FROM pred GROUP BY ALL), m AS (SELECT system, seed, event, cls, avg(pr) AS mp, count(*) AS n FROM pb GROUP BY ALL),
 rt AS (SELECT m.system, m.seed, m.event, m.cls, (coalesce(c,0)/n::DOUBLE+1e-4)/(mp+1e-4) AS r FROM m LEFT JOIN q USING (system, seed, event, cls)), ad AS (SELECT pb.system, pb.seed, pb.event, pb.item_id, arg_min(pb.cls, (-(pr*r), pb.cls)) AS y FROM pb JOIN rt USING (system, seed, event, cls) GROUP BY ALL)
 SELECT system, seed, event, count(*) AS n, count(*) FILTER (y=y_true) AS n_right_after, count(*) FILTER (y_pred=y_true) AS n_right_before FROM ad JOIN pred USING (system, seed, event, item_id) GROUP BY ALL""")
def _(fx):
    scored = M.score_arrays(fx.stored_pred.withColumn("classes", fx.classes.scalar()), F.col("classes"), scores_of("classes"), None)
    scored = scored.select("system", "seed", "event", "item_id", "y_true", "y_pred", "p")
    m = M.prior_match(scored, C.RUN, fx.classes.head()[0])
    return m.groupBy("system", "seed", "event").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y_matched") == F.col("y_true"), 1)).alias("n_right_after"), F.count(F.when(F.col("y_pred") == F.col("y_true"), 1)).alias("n_right_before"))


@query("M6_epoch_rules", "WITH " + PRED + f""", c AS (SELECT system AS model, event AS fold, 1 + {H("'ep'", 'item_id')} % 5 AS epoch, avg((y_true=y_pred)::INT) AS f, 1-avg((y_true=y_pred)::INT) + max(CAST(item_id AS BIGINT) % 7)/100.0::DOUBLE AS l FROM pred GROUP BY ALL),
 m AS (SELECT model, epoch, avg(f) AS f, avg(l) AS l FROM c GROUP BY ALL), r AS (SELECT model, arg_min(epoch, (-round(f,3), epoch)) AS a, arg_min(epoch, (l, epoch)) AS b, max(f) AS mx FROM m GROUP BY model),
 nr AS (SELECT m.model, count(*) FILTER (f>=mx-0.02) AS k FROM m JOIN r USING (model) GROUP BY ALL), fd AS (SELECT model, fold, arg_min(epoch, (l, epoch)) AS e FROM c GROUP BY ALL), fs AS (SELECT model, count(*) AS n_folds, string_agg(fold||':'||e, ',' ORDER BY fold||':'||e) AS s FROM fd GROUP BY model)
 SELECT model, a AS macro_f1_rule, b AS loss_rule, n_folds, s AS fold_loss_min_epochs, k AS epochs_within_002 FROM r JOIN nr USING (model) JOIN fs USING (model)""")
def _(fx):
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    c = fx.pred.groupBy(F.col("system").alias("model"), F.col("event").alias("fold"), (hash32("ep", F.col("item_id")) % 5 + 1).alias("epoch")).agg(
        F.avg(right).alias("val_macro_f1"), (1.0 - F.avg(right) + F.max(F.col("item_id").cast("bigint") % 7) / 100.0).alias("val_loss"))
    curves = c.groupBy("model", "fold").agg(F.array_sort(F.collect_list(F.struct("epoch", "val_loss", "val_macro_f1"))).alias("curve"))
    return M.epoch_rules(curves)


# ---------------------------------------------------------------- Q: reports
FLAT_COLS = ["pooled_P", "per_event_P", "A_P", "pooled_D", "per_event_D", "A_D"]


def flat_sql(name, seed):
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT system || '/{c}' AS key, {c} AS value FROM sc WHERE seed='{seed}'" for c in FLAT_COLS) + ")"


@query("Q1_value_regression", SCORED + ", " + flat_sql("fa", "42") + ", " + flat_sql("fb", "1") + ", va AS (SELECT key, CAST(CAST(round(value, 3) * 1000 AS BIGINT) AS VARCHAR) AS value FROM fa), vb AS (SELECT key, CAST(CAST(round(value, 3) * 1000 AS BIGINT) AS VARCHAR) AS value FROM fb) SELECT coalesce(va.key, vb.key) AS key, va.value AS value_a, vb.value AS value_b, CASE WHEN vb.key IS NULL THEN 'only_a' WHEN va.key IS NULL THEN 'only_b' ELSE 'different' END AS state FROM va FULL JOIN vb ON va.key=vb.key WHERE va.value IS DISTINCT FROM vb.value")
def _(fx):
    s = C.score_cube(fx.cube)

    def side(seed):
        flat = Q.flatten(s.filter(F.col("seed") == seed), ["system"], FLAT_COLS)
        return flat.select("key", F.round(F.round("value", 3) * 1000, 0).cast("bigint").cast("string").alias("value"))
    return Q.value_diff(side("42"), side("1"))


@query("Q2_tolerant_result_diff", SCORED + ", " + flat_sql("fa", "42") + ", " + flat_sql("fb", "1") + f""", j AS (SELECT fa.key AS ka, fb.key AS kb, fa.value AS x, fb.value AS y FROM fa FULL JOIN fb ON fa.key=fb.key) SELECT count(*) AS n_keys, count(*) FILTER (ka IS NULL OR kb IS NULL OR abs(x-y) > greatest(1e-9*greatest(abs(x),abs(y)), 1e-12)) AS n_different, count(*) FILTER (ka IS NULL OR kb IS NULL) AS n_missing, {S.r('max(abs(x-y))', 'max_abs_diff')} FROM j""")
def _(fx):
    s = C.score_cube(fx.cube)
    return rounded(Q.result_diff(*[Q.flatten(s.filter(F.col("seed") == x), ["system"], FLAT_COLS) for x in ("42", "1")]))


PT = BOOT + ", " + S.sums("pcs", "ft", "system, seed") + ", " + S.scores("pt", "pcs", "system, seed") + ", pm AS (SELECT system, " + ", ".join(f"avg({c}) AS {c}" for c in [f"{p}_{c}" for p in ("pooled", "per_event", "A") for c in "PDO"] + list(C.TERMS)) + " FROM pt GROUP BY system)"


@query("Q3_results_table", PT + ", ci AS (SELECT system, " + ", ".join(f"quantile_cont(A_{c},0.025) AS lo_{c}, quantile_cont(A_{c},0.975) AS hi_{c}" for c in "PDO") + " FROM bt GROUP BY system) "
       + " UNION ALL ".join(f"SELECT system, '{c}' AS conv, {S.r(f'pooled_{c}', 'pooled')}, {S.r(f'per_event_{c}', 'per_event')}, {S.r(f'A_{c}', 'A')}, {S.r(f'lo_{c}', 'A_lo')}, {S.r(f'hi_{c}', 'A_hi')} FROM pm JOIN ci USING (system)" for c in "PDO"))
def _(fx):
    names = ["A_P", "A_D", "A_O"]
    return rounded(Q.results_table(C.system_scores(fx.cube), R.percentiles(draws(fx, columns=names), ["system"], names)))


@query("Q4_terms_table", PT + ", ci AS (SELECT system, " + ", ".join(f"quantile_cont({c},0.025) AS lo_{c}, quantile_cont({c},0.975) AS hi_{c}" for c in C.TERMS) + " FROM bt GROUP BY system) "
       + " UNION ALL ".join(f"SELECT system, '{c}' AS term, {S.r(c, 'mean')}, {S.r(f'lo_{c}', 'lo')}, {S.r(f'hi_{c}', 'hi')} FROM pm JOIN ci USING (system)" for c in C.TERMS))
def _(fx):
    return rounded(Q.terms_table(C.system_scores(fx.cube), R.percentiles(draws(fx, columns=list(C.TERMS)), ["system"], list(C.TERMS)), C.TERMS))


@query("Q4_seed_table", SCORES + ", x AS (SELECT system, seed, A_P, A_D, A_O, T1, T2, T3, T4 FROM sc) SELECT system, seed, " + cols(["A_P", "A_D", "A_O", "T1", "T2", "T3", "T4"]) + " FROM x")
def _(fx):
    return rounded(C.score_cube(fx.cube).select("system", "seed", "A_P", "A_D", "A_O", "T1", "T2", "T3", "T4"))


@query("Q5_summary_statistics", CELLS + f", t AS (SELECT system, min(s) AS m FROM (SELECT system, cls, sum(support) AS s FROM cells GROUP BY ALL) GROUP BY system) SELECT system, {S.r('avg(f1) FILTER (support<15)', 'small_f1')}, {S.r('avg(f1) FILTER (support>=15)', 'other_f1')}, count(*) FILTER (support<15) AS n_small, count(*) AS n_cells, CAST(max(m) AS BIGINT) AS min_class_total FROM cells JOIN t USING (system) GROUP BY system")
def _(fx):
    return rounded(Q.summary_stats(FL.cell_table(fx.cube)))


@query("Q5_deviation_exponents", SCORED + f" SELECT system, seed, CAST(ceil(log10(greatest(abs(A_D-A_P), 1e-300))) AS BIGINT) AS exponent FROM sc WHERE abs(A_D-A_P) > 1e-9")
def _(fx):
    return C.score_cube(fx.cube).filter("abs(A_D - A_P) > 1e-9").select("system", "seed", Q.exponent(F.abs(F.col("A_D") - F.col("A_P"))).alias("exponent"))


@query("Q6_scatter_data", CELLS + f" SELECT system, event, cls, support, {S.r('f1', 'f1')} FROM cells")
def _(fx):
    return rounded(Q.scatter_data(FL.cell_table(fx.cube)))
