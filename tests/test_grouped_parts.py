"""Grouped fits, threshold samples, order statistics in time, one-exchange checks, and file sources against brute force."""
import hashlib
import itertools
import json
import math
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapcube.functions import kernels as KN
from gapcube.functions.columns import hash32
from gapcube.operators import fits as FIT
from gapcube.operators import sampling as P
from gapcube.operators import select, splits as SP, text as N, validate as V
from gapcube.operators.models import with_terms
from gapcube.session import scratch_path
from gapcube.sources import io as IO


# ---------------------------------------------------------------- fits
def test_minimise_reaches_the_optimum():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 12))
    a = a.T @ a + 0.1 * np.eye(12)
    b = rng.standard_normal(12)
    x, _, g = FIT.minimise(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(12), tolerance=1e-9)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-6) and g <= 1e-9


def plain_fit(texts, labels, classes, c=1.0):
    """Dense TF-IDF and gradient descent on the same objective."""
    n = len(texts)
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    terms = sorted(w for w, k in df.items() if k >= 2)
    idf = np.array([math.log((1 + n) / (1 + df[w])) + 1 for w in terms])

    def vector(t):
        tf = np.array([t.count(w) for w in terms], float)
        x = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * idf, 0)
        return x / (np.linalg.norm(x) or 1)
    x, y = np.array([vector(t) for t in texts]), np.array([classes.index(v) for v in labels])
    w, b = np.zeros((len(terms), len(classes))), np.zeros(len(classes))
    for _ in range(20_000):
        q = FIT.softmax(x @ w + b)
        q[np.arange(n), y] -= 1
        w -= 0.5 * (x.T @ q / n + w / (c * n))
        b -= 0.5 * q.mean(0)
    return lambda t: FIT.softmax(vector(t)[None] @ w + b)[0]


def test_fits_of_all_runs_against_dense_descent(spark):
    rng = random.Random(1)
    words = {"a": ["flood", "water", "river"], "b": ["fire", "smoke", "ash"], "c": ["help", "donate", "give"]}
    rows = []
    for i in range(160):
        label, event = rng.choice("abc"), f"e{i % 4}"
        rows.append((str(i), i, event, label, " ".join(rng.choices(words[label] + ["the", "now", "and"], k=rng.randrange(1, 9)))))
    rows += [("900", 900, "e0", "a", ""), ("901", 901, "e1", "b", "unseen words only")]
    corpus = spark.createDataFrame(rows, "item_id string, item_num long, event string, label string, text string")
    samples = P.sample_heldout(corpus, ["42", "1"], 80)
    got = FIT.heldout_fit_predict(corpus, samples, ["a", "b", "c"]).collect()
    assert len(got) == 2 * len(rows) and {(r.run_key, r.seed) for r in got} == {(f"loeo:e{k}", s) for k in range(4) for s in ("42", "1")}
    assert all(r.run_key == "loeo:" + r.event and abs(sum(r.p.values()) - 1) < 1e-9 for r in got)
    assert sum(r.y_true == r.y_pred for r in got) / len(got) > 0.8
    drawn = {r.item_id for r in samples.filter("held_out = 'e2' AND seed = '1'").collect()}
    terms = {r.item_id: r.terms for r in with_terms(corpus).collect()}
    train = [r for r in rows if r[0] in drawn]
    model = plain_fit([terms[r[0]] for r in train], [r[3] for r in train], ["a", "b", "c"])
    for r in got:
        if r.run_key == "loeo:e2" and r.seed == "1":
            assert np.allclose([r.p[k] for k in "abc"], model(terms[r.item_id]), atol=2e-3)


def test_a_class_that_training_lacks_has_no_probability(spark):
    rows = [(str(i), i, "e0" if i % 2 else "e1", "x" if i % 2 else "yz"[i % 4 // 2], "word%d other" % (i % 3)) for i in range(40)]
    corpus = spark.createDataFrame(rows, "item_id string, item_num long, event string, label string, text string")
    got = FIT.heldout_fit_predict(corpus, P.sample_heldout(corpus, ["1"]), ["x", "y", "z"]).collect()
    assert len(got) == 40
    for r in got:  # e0 is all x: models that hold it out know y and z, the other knows x only
        assert (r.p["x"] == 0.0) == (r.event == "e0") and (r.y_pred == "x") == (r.event == "e1")


# ---------------------------------------------------------------- samples
def hashed(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("slack", [(6.0, 32), (-9.5, 0)])  # enough at once, or runs that have to be drawn again
def test_samples_are_the_lowest_draws(spark, monkeypatch, slack):
    monkeypatch.setattr(P, "SLACK", slack[0])
    monkeypatch.setattr(P, "MORE", slack[1])
    rows = [(str(i), i, "hot" if i % 3 else f"e{i % 7}") for i in range(4000)] + [("9000", 9000, "lone")]
    meta = spark.createDataFrame(rows, "item_id string, item_num long, event string")
    got = {}
    for r in P.sample_heldout(meta, ["1", "2"], 100).collect():
        got.setdefault((r.held_out, r.seed), set()).add(r.item_id)
    for event, seed in itertools.product({r[2] for r in rows}, "12"):
        pool = [r for r in rows if r[2] != event]
        want = sorted(pool, key=lambda r: (hashed("loeo:" + event, seed, r[0]), r[1]))[:100]
        assert got[event, seed] == {r[0] for r in want}
    whole = P.sample_pool(meta.filter("event <> 'hot'"), "id", ["1"], 5000)
    assert whole.count() == sum(r[2] != "hot" for r in rows)


def test_samples_read_the_rows_once(spark):
    path = scratch_path(spark, "meta")
    spark.range(5000).selectExpr("CAST(id AS STRING) AS item_id", "id AS item_num", "concat('e', id % 9) AS event").write.parquet(path)
    meta = spark.read.parquet(path)
    runs = P.heldout_runs(meta, ["1"], 50, "loeo")
    drawn = P.meeting(meta, runs.withColumn("limit", F.lit(1e8)), "x.held_out <> event").filter("draw < `limit`")
    assert drawn._jdf.queryExecution().sparkPlan().collectLeaves().size() == 1  # the runs come as one small value


def test_paired_samples_keep_what_they_can(spark):
    base = spark.createDataFrame([("1", str(i), i, "e") for i in range(60)], "seed string, item_id string, item_num long, event string").withColumn("run_key", F.lit("id"))
    pool = spark.createDataFrame([(str(i), i, "e") for i in range(20, 300)], "item_id string, item_num long, event string")
    got = P.sample_paired(base, pool, "id_dedup", 60).collect()
    rest = sorted((i for i in range(60, 300)), key=lambda i: (hashed("id_dedup|fill", "1", str(i)), i))[:20]
    assert {r.item_num for r in got} == set(range(20, 60)) | set(rest) and len(got) == 60


# ---------------------------------------------------------------- order statistics in time
@pytest.mark.parametrize("ranked", [4096, 7])
def test_order_statistics_of_a_dense_event(spark, monkeypatch, ranked):
    """One event holds a third of all seconds, and one microsecond many rows."""
    for module in (select, N):
        monkeypatch.setattr(module, "RANKED", ranked)
    rng = random.Random(2)
    us = [("hot", 1_700_000_000_000_000 + rng.randrange(40 * 86_400_000_000)) for _ in range(2000)] + [("hot", 1_701_728_000_000_001)] * 900
    us += [(f"e{i % 9}", 1_700_000_000_000_000 + rng.randrange(10 ** 9)) for i in range(1500)] + [("one", 5)]
    rows = [(e, str(i), i * 977, t) for i, (e, t) in enumerate(us)]
    df = spark.createDataFrame(rows, "event string, item_id string, item_num long, us long").withColumn("posted_at", F.timestamp_micros("us"))
    last = {}
    for r in SP.temporal_holdout(df).collect():
        last.setdefault(r.event, set()).add(r.item_num)
    middle = {r.event: r.m for r in N.time_histogram_median(df).select("event", F.unix_micros("median_post").alias("m")).collect()}
    for event in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == event]
        assert last[event] == {r[2] for r in sorted(mine, key=lambda r: (-r[3], -r[2]))[:math.ceil(0.2 * len(mine))]}
        times = sorted(r[3] for r in mine)
        assert middle[event] == math.floor((times[(len(times) - 1) // 2] + times[len(times) // 2]) / 2) == math.floor(statistics.median(times))
    assert N.time_histogram_median(df.limit(0)).count() == 0


def test_levels_of_time_are_short():
    units = [86_400_000_000, 30_000_000, 5000, 1]
    assert max(a // b for a, b in zip(units, units[1:])) <= 6000


# ---------------------------------------------------------------- validation
def test_validation_moves_the_rows_once(spark):
    rng = random.Random(9)
    meta_rows = [(str(i), f"e{i % 5}", "h", "ab"[i % 2]) for i in range(200)]
    rows = []
    for run in ("s1", "s2"):
        for i, e, _, y in meta_rows:
            if run == "s2" and e == "e4" or rng.random() < 0.05:
                continue
            row = (run, "1", i if rng.random() < 0.95 else i + "x", e if rng.random() < 0.95 else "e0", y if rng.random() < 0.9 else "b", rng.choice("abz"))
            rows += [row] * (1 + (rng.random() < 0.1))
    rows.append(("s1", "1", "0", "e3", "a", "a"))  # a repeated item in another event
    meta = spark.createDataFrame(meta_rows, "item_id string, event string, hazard string, label string")
    pred = spark.createDataFrame(rows, "system string, seed string, item_id string, event string, y_true string, y_pred string")
    classes = meta.groupBy().agg(F.array_sort(F.collect_set("label")).alias("c"))
    known = {i: (e, y) for i, e, _, y in meta_rows}
    for r in V.validation_report(pred, meta, classes).collect():
        mine = [x for x in rows if x[0] == r.system]
        some = [x for x in mine if x[2] in known]
        assert r.dup_rows == len(mine) - len({x[2] for x in mine})
        assert r.unknown_items == len(mine) - len(some)
        assert r.wrong_event == sum(x[3] != known[x[2]][0] for x in some) and r.wrong_label == sum(x[4] != known[x[2]][1] for x in some)
        assert r.stray_classes == sum(x[5] == "z" for x in mine)
        got = {e: sum(x[3] == e for x in some) for e in {m[1] for m in meta_rows}}
        assert r.n_absent == sum(v == 0 for v in got.values()) and r.n_incomplete == sum(v not in (0, 40) for v in got.values())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = V.checked_events(pred, meta, classes)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the rows by item, the metadata beside them, and the sums of a run's events; nothing else moves rows
    assert plan.count("hashpartitioning(item_id") <= 2 and plan.count("hashpartitioning(") <= 3


# ---------------------------------------------------------------- tau
def test_tau_p_with_ties_on_both_sides():
    rng = random.Random(5)
    x, y = [1, 1, 2, 3, 3, 3, 4, 5, 6, 6], [2, 1, 1, 3, 4, 4, 5, 5, 5, 7]

    def s(a, b):
        return sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(len(a)) for j in range(i))
    seen = []
    for _ in range(20_000):
        z = y[:]
        rng.shuffle(z)
        seen.append(s(x, z))
    var = np.var(seen)  # the variance over all orders of tied values
    assert KN.kendall_p_of(x, y) == pytest.approx(math.erfc(abs(s(x, y)) / math.sqrt(2 * var)), rel=0.1)
    assert KN.kendall_p_of([1, 2, 3, 4], [1, 2, 4, 3]) == KN.kendall_p(4, 1)
    assert math.isnan(KN.kendall_p_of([1, 1, 1], [1, 2, 3])) and math.isnan(KN.kendall_p_of([1.0], [2.0]))


# ---------------------------------------------------------------- sources
def test_a_thousand_files_of_three_layouts(spark, tmp_path):
    layouts = [["item_id", "event", "y_true", "y_pred", "p_a"], ["y_pred", "extra", "event", "item_id", "y_true"], ["p_b", "y_true", "item_id", "y_pred", "event", "p_a"]]
    want = []
    for k in range(1000):
        names = layouts[k % 3]
        folder = tmp_path / "confirm" / "c" / f"m{k % 4}" / f"seed{k // 4}" / "loeo__all"
        folder.mkdir(parents=True)
        lines = ["\t".join(names)]
        for i in range(k % 3):
            row = {"item_id": f"{k}-{i}", "event": "e", "y_true": "NA", "y_pred": "", "p_a": "0.5", "p_b": "0.25", "extra": '"a\tb"'}
            lines.append("\t".join(row[n] for n in names))
            want.append((f"{k}-{i}", "e", "NA", "", f"m{k % 4}", str(k // 4)))
        (folder / "part-0.csv").write_text("\n".join(lines) + "\n")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    read = IO.read_predictions(spark, [f"{tmp_path}/confirm/*/*/*/*/part-*"], keep_path=True)
    assert len(jobs.getJobIdsForGroup("headers")) < 20  # no job per file
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = [tuple(r[c] for c in ("item_id", "event", "y_true", "y_pred", "model", "seed")) for r in IO.with_path_keys(read).collect()]
    assert sorted(got) == sorted(want)
    twice = IO.read_predictions(spark, [f"{tmp_path}/confirm/c/m0/*/*/part-*", f"{tmp_path}/confirm/c/*/*/*/part-*"])
    assert twice.count() == len(want)
    maps = {tuple(sorted((k, v) for k, v in r.p.items())) for r in IO.read_scored(spark, [f"{tmp_path}/confirm/*/*/*/*/part-*"]).collect()}
    assert maps == {(("a", None), ("b", None)), (("a", 0.5), ("b", 0.25))}
    with pytest.raises(Exception, match="no prediction files|PATH_NOT_FOUND"):
        IO.read_predictions(spark, [f"{tmp_path}/nothing*"])


def test_arrays_of_whole_files(spark, tmp_path):
    rows = [{"item_id": str(i), "text_raw": t, "label": "l"} for i, t in enumerate(["plain", 'a "}, {" b', "}{][", "", "ünï\n\\", "x" * 20_000, "}" * 50])]
    for k, text in enumerate([json.dumps(rows), json.dumps(rows, indent=2), "[]", " [\n" + json.dumps(rows[0]) + "\n] \n", json.dumps([{**rows[0], "more": {"a": [{"b": 1}]}}])]):
        folder = tmp_path / f"ev{k}"
        folder.mkdir()
        (folder / "train.json").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file is many splits
    try:
        got = [(r.event, r.split, r.item_id, r.text_raw) for r in IO.read_raw_json(spark, f"{tmp_path}/*/*").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    each = [(r["item_id"], r["text_raw"]) for r in rows]
    assert sorted(got) == sorted([(e, "train", *x) for e in ("ev0", "ev1") for x in each] + [(e, "train", *each[0]) for e in ("ev3", "ev4")])
    (tmp_path / "bad.json").write_text('[{"item_id": "1"')
    with pytest.raises(Exception, match="does not end"):
        IO.read_json_arrays(spark, f"{tmp_path}/bad.json").collect()


def test_written_arrays_are_json(spark):
    path = scratch_path(spark, "arrays")
    df = spark.createDataFrame([("a", "t", i, str(i), 'say "}"') for i in range(50)] + [("b", "t", 7, "7", None)], "e string, s string, n long, item_id string, text_raw string")
    IO.write_json_arrays(df, ["e", "s"], "n", path)
    files = [os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.startswith("part-")]
    found = sorted((json.load(open(f)) for f in files), key=len)
    assert [len(x) for x in found] == [1, 50] and [m["item_id"] for m in found[1]] == [str(i) for i in range(50)]


def test_hash_of_a_large_file(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(3 << 30)  # sparse
        f.seek(1 << 31)
        f.write(b"end of the middle")
    (tmp_path / "a small file").write_bytes(b"abc")
    got = {os.path.basename(r.path.replace("%20", " ")): (r.length, r.sha256) for r in IO.file_sha256(spark, [str(tmp_path)]).collect()}
    digest = hashlib.sha256()
    with open(tmp_path / "big.bin", "rb") as f:
        while piece := f.read(1 << 24):
            digest.update(piece)
    assert got == {"big.bin": (3 << 30, digest.hexdigest()), "a small file": (3, hashlib.sha256(b"abc").hexdigest())}


def test_inventory_refuses_a_loose_file(spark, tmp_path):
    for n in ("a.tsv", "b.tsv", "c.json"):
        (tmp_path / n).write_text(n)
    rules = (("tables", r"\.tsv$"), ("records", r"\.json$"))
    assert {tuple(r) for r in IO.artifact_inventory(IO.list_files(spark, [str(tmp_path)]), rules).collect()} == {("tables", 2, 10), ("records", 1, 6)}
    (tmp_path / "odd.bin").write_text("")
    with pytest.raises(ValueError, match="odd.bin"):
        IO.artifact_inventory(IO.list_files(spark, [str(tmp_path)]), rules)


def test_ledger_counts_a_repeated_append_once(spark, tmp_path):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    files = spark.createDataFrame([("r1", "a", "00"), ("r1", "b", "11")], "run_id string, path string, sha256 string")
    path = str(tmp_path / "ledger")
    assert IO.append_ledger(runs, files, path, "batch one") and not IO.append_ledger(runs, files, path, "batch one")
    assert IO.append_ledger(runs.limit(1), files, path, "2")
    # a job that died while it wrote leaves a folder that nobody reads
    runs.selectExpr("run_id", "'lost' AS status").write.json(f"{path}/_pending-3-x")
    got = IO.read_ledger(spark, path).collect()
    assert len(got) == 3 and {r.status for r in got} == {"succeeded"}
    assert sorted(len(r.output_artifacts or []) for r in got if r.run_id == "r1")[-1] == 2


def test_draws_agree_with_python(spark):
    assert spark.range(1).select(hash32("a", "b").alias("h")).first().h == hashed("a", "b")
