"""SQL fragments used by several reference statements."""

from __future__ import annotations

F1 = "CASE WHEN {t}+{p}+{n} > 0 THEN 2.0::DOUBLE*{t}/(2.0::DOUBLE*{t}+{p}+{n}) ELSE 0.0::DOUBLE END"


def f1(t="tp", p="fp", n="fn"):
    return F1.format(t=t, p=p, n=n)


def r(expr, alias=None):
    return f"round(({expr})::DOUBLE, 9) + 0.0::DOUBLE" + (f" AS {alias}" if alias else "")


def mask(conv):
    return {"P": "tp+fn > 0", "D": "tp+fn+fp > 0", "O": "TRUE"}[conv]


def macro(conv):
    return f"(coalesce(sum({f1()}) FILTER ({mask(conv)}), 0.0) / greatest(count(*) FILTER ({mask(conv)}), 1))::DOUBLE"


def events(name, cube, keys):
    """Per-event scores straight from the cells."""
    return (f"{name} AS MATERIALIZED (SELECT {keys}, event, CAST(sum(tp+fn) AS BIGINT) AS n, count(*) FILTER (tp+fn>0) AS n_present, "
            f"count(*) FILTER (tp+fn=0 AND fp>0) AS k, count(*) AS n_classes, "
            + ", ".join(f"{macro(c)} AS f1_{c}" for c in "PDO") + f" FROM {cube} GROUP BY {keys}, event)")


def pooled(name, cube, keys):
    return (f"{name} AS MATERIALIZED (SELECT {keys}, " + ", ".join(f"{macro(c)} AS pooled_{c}" for c in "PDO")
            + f" FROM (SELECT {keys}, cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {cube} GROUP BY {keys}, cls) GROUP BY {keys})")


def level_scores(name, cube, keys):
    """pooled_*, per_event_*, A_* by the definitions."""
    return ",\n".join([
        events(name + "_ev", cube, keys), pooled(name + "_pool", cube, keys),
        f"{name} AS MATERIALIZED (SELECT p.*, " + ", ".join(f"e.per_event_{c}, p.pooled_{c} - e.per_event_{c} AS A_{c}" for c in "PDO")
        + f", e.n_events FROM {name}_pool p JOIN (SELECT {keys}, count(*) AS n_events, "
        + ", ".join(f"avg(f1_{c}) AS per_event_{c}" for c in "PDO") + f" FROM {name}_ev GROUP BY {keys}) e USING ({keys}))"])


def features(name, cube, keys):
    return f"""{name} AS MATERIALIZED (
  SELECT x.*, s > 0 AS pres, s/1.0 AS sd, CASE WHEN s>0 THEN 1.0::DOUBLE/s ELSE 0.0 END AS w, CASE WHEN s>0 THEN 1.0::DOUBLE ELSE 0.0 END AS pr,
         CASE WHEN s>0 THEN f/np ELSE 0.0 END AS g_P, CASE WHEN s+fp>0 THEN f/greatest(nl,1) ELSE 0.0 END AS g_D, f/nc AS g_O,
         CASE WHEN s>0 THEN 1.0::DOUBLE/np ELSE 0.0 END AS wc
  FROM (SELECT {keys}, event, cls, tp, fp, fn, tp+fn AS s, {f1()} AS f,
               CAST(count(*) FILTER (tp+fn>0) OVER l AS DOUBLE) AS np, CAST(count(*) FILTER (tp+fn+fp>0) OVER l AS DOUBLE) AS nl,
               CAST(count(*) OVER l AS DOUBLE) AS nc, CAST(sum(tp+fn) OVER l AS DOUBLE) AS ne
        FROM {cube} WINDOW l AS (PARTITION BY {keys}, event)) x)"""


def sums(name, feat, by, m="1", on=""):
    """Class sums with multiplicity m; `on` joins the draws."""
    terms = {"n_events": "1", "tp": "tp", "fp": "fp", "fn": "fn", "fp_in": "fp*pr", "tp_w": "tp*w", "fp_w": "fp*w", "fn_w": "fn*w", "s": "s",
             "sf": "s*f", "fpres": "f*pr", "npres": "pr", "g_P": "g_P", "g_D": "g_D", "g_O": "g_O", "wc": "wc", "ng": "ne*g_P"}
    return (f"{name} AS MATERIALIZED (SELECT {by}, cls, " + ", ".join(f"CAST(sum(({m})*({e})) AS DOUBLE) AS {k}" for k, e in terms.items())
            + f" FROM {feat} {on} GROUP BY {by}, cls)")


def scores(name, src, by):
    pool = ", ".join(f"{macro(c)} AS pooled_{c}, sum(g_{c})/max(n_events) AS per_event_{c}" for c in "PDO")
    return f"""{name} AS MATERIALIZED (
  SELECT *, pooled_P-per_event_P AS A_P, pooled_D-per_event_D AS A_D, pooled_O-per_event_O AS A_O,
         m_all-m_in AS T1, m_in-m_swm AS T2, m_swm-m_eqm AS T3, m_eqm-per_event_P AS T4, m_eq-m_eqm AS T2alt, m_in-m_eq AS T3alt,
         m_comp-per_event_P AS T3c, m_swm-m_comp AS T4c, m_size-per_event_P AS W, pooled_P-m_size AS N,
         m_all-m_bar AS scoring, m_bar-m_wbar AS reweighting
  FROM (SELECT {by}, max(n_events) AS n_events, {pool},
         avg({f1()}) FILTER (s>0) AS m_all, avg({f1('tp', 'fp_in', 'fn')}) FILTER (s>0) AS m_in,
         avg({f1('tp_w', 'fp_w', 'fn_w')}) FILTER (s>0) AS m_eq, avg(sf/s) FILTER (s>0) AS m_swm, avg(fpres/npres) FILTER (s>0) AS m_eqm,
         sum(wc/n_events*sf/s) FILTER (s>0) AS m_comp, sum(ng)/sum(s) AS m_size,
         avg(g_P/wc) FILTER (s>0) AS m_bar, sum(wc/n_events*g_P/wc) FILTER (s>0) AS m_wbar,
         count(*) FILTER (s>0) AS n_pool_classes, count(*) AS n_classes, sum(s) AS n_messages
  FROM {src} GROUP BY {by}))"""
