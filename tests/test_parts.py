"""Selection, similarity, kernels and sources against brute force."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapcube.functions import kernels as KN
from gapcube.operators import models as M
from gapcube.operators import nullmodel as NM
from gapcube.operators import resample as R
from gapcube.operators import similarity as SIM
from gapcube.operators import splits as SP
from gapcube.operators import text as N
from gapcube.operators.select import take_lowest_hash
from gapcube.session import scratch_path
from gapcube.sources import io as IO


def test_take_lowest_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", random.Random(i).getrandbits(32)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, draw long")
    got = {r.id for r in take_lowest_hash(df, ["g"], "draw", "id", lambda n: F.least(n, F.lit(50))).collect()}
    want = set()
    for g in {r[1] for r in rows}:
        want |= {r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))[:50]}
    assert got == want


def test_draws_take_only_the_events_of_their_group(spark):
    # threshold 5 leaves three events, threshold 10 two, so its draws must have two slots and never take "c"
    left = spark.createDataFrame([(5, e) for e in "abc"] + [(10, e) for e in "ab"], "t int, event string")
    got = R.event_draws(spark, left, 50, by=["t"]).collect()
    slots = {}
    for r in got:
        slots[r.b, r.t] = slots.get((r.b, r.t), 0) + r.m
    assert slots == {(b, t): n for b in range(50) for t, n in ((5, 3), (10, 2))}
    assert {r.event for r in got if r.t == 10} == {"a", "b"}
    # all events of one group: the same draws as without groups
    plain = {(r.b, r.event, r.m) for r in R.event_draws(spark, left.filter("t = 5"), 50).collect()}
    assert plain == {(r.b, r.event, r.m) for r in got if r.t == 5}


def test_temporal_holdout_breaks_ties_by_id(spark):
    rows = [("e", str(i), i, "2024-01-01 00:00:00") for i in range(50)] + [("e", "99", 99, "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "event string, item_id string, item_num long, t string").withColumn("posted_at", F.to_timestamp("t"))
    got = sorted(r.item_num for r in SP.temporal_holdout(df).collect())
    assert got == [*range(40, 50), 99]  # ceil(0.2 * 51) = 11


def grams(text):
    out = {}
    for w in text.split(" "):
        w = f" {w} "
        for n in (3, 4, 5):
            for i in range(len(w) - n + 1):
                out[w[i:i + n]] = out.get(w[i:i + n], 0) + 1
    return out if text else {}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similarity_against_brute_force(spark, threshold):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(60)]
    texts += [t + " " + rng.choice(words) for t in texts[:25]] + texts[:6] + [""]
    rows = [(str(i), i, "e", i % 3 == 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "item_id string, item_num long, event string, in_R boolean, text_norm string")
    counts = [grams(t) for t in texts]
    n = len(texts)
    df_of = {}
    for c in counts:
        for g in c:
            df_of[g] = df_of.get(g, 0) + 1
    vec = []
    for c in counts:
        v = {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + df_of[g])) + 1) for g, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vec.append({g: x / norm for g, x in v.items()})
    want = {}
    for i, j in itertools.product(range(n), range(n)):
        if not rows[i][3] and rows[j][3]:
            s = sum(x * vec[j].get(g, 0.0) for g, x in vec[i].items())
            want[i] = max(want.get(i, 0.0), s)
    got = {r.item_num: r.sim for r in SIM.max_similarity(df, threshold).collect()}
    assert set(got) == {i for i, s in want.items() if s >= threshold - 1e-9}
    assert all(got[i] == pytest.approx(want[i], abs=1e-8) for i in got)


def test_similarity_compares_few_pairs(spark):
    # 120 texts of own words and a near copy of each: only the copies can reach the threshold
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(30)) for _ in range(120)]
    rows = [(2 * i + c, t + " extra" * c) for i, t in enumerate(texts) for c in (0, 1)]
    df = spark.createDataFrame([(str(i), i, "e", i % 2 == 0, t) for i, t in rows], "item_id string, item_num long, event string, in_R boolean, text_norm string")
    weights = SIM.gram_weights(df, SIM.representatives(df))
    odd, even = (weights.filter(f"rep % 2 = {k}").select("rep") for k in (1, 0))
    found = {(r.l, r.r) for r in SIM.candidate_pairs(weights, odd, even, 0.8).collect()}
    assert {(2 * i + 1, 2 * i) for i in range(120)} <= found
    assert len(found) < 240  # of 14,400


def test_t_quantiles_and_tails():
    assert KN.t_ppf(0.975, 29) == pytest.approx(2.045229642132703, abs=1e-9)
    assert KN.t_ppf(0.95, 1) == pytest.approx(6.313751514675043, abs=1e-7)
    assert KN.t_sf2(2.0, 10) == pytest.approx(0.07338803477074037, abs=1e-10)


@pytest.mark.parametrize("df", [0.3, 0.5, 0.8, 1.0, 1.2, 2.0, 2.9, 3.1])
def test_t_tail_of_few_degrees_of_freedom(df):
    """Against the density of |T|, summed over even steps of log t."""
    x = np.linspace(0.0, math.log(1e30), 400_001)
    t = np.exp(x)
    density = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + t * t / df) ** (-(df + 1) / 2) * t
    tail = ((density[1:] + density[:-1]) / 2 * np.diff(x)).sum()
    assert KN.t_sf2(1.0, df) == pytest.approx(tail, abs=1e-6)


def test_wilcoxon_by_enumeration():
    x = np.array([0.3, -0.1, 0.7, 0.2, -0.5, 0.9, 0.4])
    ranks = np.argsort(np.argsort(np.abs(x))) + 1
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    low = sum(sum(r for r, s in zip(ranks, signs) if s) <= w for signs in itertools.product([0, 1], repeat=len(x)))
    assert KN.wilcoxon_p(x) == pytest.approx(min(1.0, 2 * low / 2 ** len(x)))
    many = np.arange(1.0, 41.0) * np.where(np.arange(40) % 3, 1, -1)  # both ways agree where the normal form is good
    assert KN.wilcoxon_p(many) == pytest.approx(KN.wilcoxon_p(many, exact_up_to=0), abs=2e-3)


def test_kendall_p_by_enumeration():
    perms = list(itertools.permutations(range(5)))
    inv = [sum(p[i] > p[j] for i in range(5) for j in range(i + 1, 5)) for p in perms]
    assert KN.kendall_p(5, 2) == pytest.approx(2 * sum(k <= 2 for k in inv) / len(perms))


def test_text_rules(spark):
    df = spark.createDataFrame([("RT @usér_1: see http://x.y/z #Tag 1,200 now ",)], "text string")
    r = df.select(N.normalize_text("text").alias("n"), N.dedup_key("text").alias("k"), N.is_retweet("text").alias("rt"), N.mask_tokens("text").alias("m")).first()
    assert r.n == "RT [USER]: see [URL] #Tag 1,200 now" and r.k == "see #tag 1 200 now" and r.rt
    assert "[HASHTAG]" in r.m and "[NUM]" in r.m and "usér_1" in r.m


def test_instance_bootstrap_matches_slot_resampling(spark):
    rng = random.Random(3)
    rows = [(str(i), f"e{i % 3}", y := rng.choice("abc"), y if rng.random() < 0.8 else rng.choice("abc"), y if rng.random() < 0.5 else rng.choice("abc")) for i in range(300)]
    joint = spark.createDataFrame(rows, "item_id string, event string, y_true string, pa string, pb string").groupBy("event", "y_true", "pa", "pb").agg(F.count("*").alias("n")).withColumn("m", F.lit("m"))
    d = np.array([r.d for r in NM.stratified_paired_boot(joint, ["m"], 300).collect()])

    def macro(sel, k):
        f = []
        for c in sorted({r[2] for r in sel}):
            tp = sum(r[2] == c and r[k] == c for r in sel)
            f.append(2 * tp / (sum(r[2] == c for r in sel) + sum(r[k] == c for r in sel)))
        return float(np.mean(f))
    ref = []
    for _ in range(300):
        sel = [s for e in range(3) for s in rng.choices([r for r in rows if r[1] == f"e{e}"], k=100)]
        ref.append(macro(sel, 3) - macro(sel, 4))
    assert len(d) == 300 and abs(d.mean() - np.mean(ref)) < 0.02 and abs(d.std() - np.std(ref)) < 0.015


def test_prediction_files(spark):
    path = scratch_path(spark, "preds")
    spark.createDataFrame([("1", "x", "", "NA", "0.5")], "item_id string, event string, y_true string, y_pred string, p_a string").write.option("sep", "\t").option("header", True).csv(path + "/a")
    spark.createDataFrame([("b", "2", "null", "y")], "y_pred string, item_id string, y_true string, event string").write.option("sep", "\t").option("header", True).csv(path + "/b")
    got = sorted(tuple(r) for r in IO.read_predictions(spark, [path + "/*/part-*"]).select("item_id", "event", "y_true", "y_pred").collect())
    assert got == [("1", "x", "", "NA"), ("2", "y", "null", "b")]
    spark.createDataFrame([("1",)], "item_id string").write.option("sep", "\t").option("header", True).csv(path + "/c")
    with pytest.raises(ValueError, match="missing columns"):
        IO.read_predictions(spark, [path + "/c/part-*"])


def test_softmax_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 3.0])], "i int, s array<double>")
    r = M.score_arrays(df, F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("s")).first()
    assert r.y_pred == "b" and sum(r.p.values()) == pytest.approx(1.0, abs=2e-4)
