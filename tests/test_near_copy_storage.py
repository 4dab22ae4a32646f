"""Near copies: sketches never drop an alike pair, and the stage leaves only its verdict in the shared folder."""
import os

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gapcube.llm import shingles
from gapcube.session import shared_dir


def texts():
    words = np.random.default_rng(5).integers(0, 10**6, 400)
    base = [f"w{x}" for x in words]
    out = [" ".join(base[:k] + [f"x{k}{i}" for i in range(400 - k)]) for k in range(400, 200, -6)]  # from alike to far
    return out + [f"{' '.join(base)} end{i}" for i in range(6)]


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 40, 63, 64, 65, 900, 20_000)]
    sets += [np.append(s[: int(len(s) * 0.9)], rng.integers(0, 2**63, len(s) // 20).astype(np.uint64)) for s in sets]
    base = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    bits, at = shingles.sketches(np.concatenate(sets), base)
    assert set(np.diff(at)) <= {1 << k for k in range(9)}
    rows = [(i, bits[at[i]:at[i + 1]].tolist()) for i in range(len(sets))]
    df = spark.createDataFrame(rows, "i int, s array<long>")
    pairs = df.join(df.select(F.col("i").alias("j"), F.col("s").alias("t")), (F.size("t") <= 2 * F.size("s")) & (F.size("s") <= 2 * F.size("t")))
    for r in pairs.select("i", "j", shingles.differing("s", "t").alias("d")).collect():
        apart = len(set(sets[r.i].tolist()) ^ set(sets[r.j].tolist()))
        assert r.d <= apart and (r.d > 0 or apart % 2 == 0)


def test_only_the_verdict_stays_and_last_pairs_are_compared_in_steps(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    left = []
    for turns, steps in ((3, 2), (0, 1), (0, 0)):  # no steps: every pair is compared at the end
        monkeypatch.setattr(shingles, "TURNS", turns)
        monkeypatch.setattr(shingles, "STEPS", steps)
        top = shared_dir(spark).removeprefix("file://")
        before = set(os.listdir(top))
        kept = corpus_pipeline.drop_near_copies(spark, df, "")
        new = {n.rsplit("-", 1)[0] for n in set(os.listdir(top)) - before}
        assert new == {"near-copies"}
        left.append(sorted(r.doc_id for r in kept.collect()))
    assert left[0] == left[1] == left[2] and 1 < len(left[0]) < df.count()
