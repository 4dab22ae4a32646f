"""Whitening, ranked search and language-model scores against brute force."""
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapcube.llm import common, gru, search, whitening
from gapcube.llm import language_model as lm

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    y = x - x.mean(0)
    e, v = np.linalg.eigh(y.T @ y / len(y))
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    return e[:k], y @ v[:, :k] / np.sqrt(e[:k]), e.sum()


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * [1, 1, 1, 1e-2, 1, 1]).tolist()
    good += [good[0]] * 200  # a hot vector
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[3]), (None, good[3])]
    bad = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [float("inf")] * 6), (905, [1.0] * 4), (906, [1e30] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("component", F.lit("x")).withColumn("n", F.lit(7)).repartition(5)
    got = whitening.whitened(df, components=8).toPandas()
    vectors = [np.float32(v).astype(float) for _, v in rows]
    e, w, trace = plain_whitening(vectors, 8)
    assert len(got) == len(rows) * len(e) and set(got.n) == {len(rows)} and got.identity_error.max() < 1e-9
    x = (np.floor(1024 * np.array(vectors)) + 100_000).astype(int)
    far = ((len(x) * x - x.sum(0)) ** 2).sum(1)
    for c in range(1, len(e) + 1):
        mine = got[got.component == c]
        assert np.allclose(mine.explained, e[c - 1] / trace, rtol=1e-9)
        sign = np.sign((mine[mine.id == 1].whitened.iloc[0]) * w[1, c - 1])
        for i, v, d in zip(mine.id, mine.whitened, mine.deviation):
            k = len(good) if pd.isna(i) else int(i)
            assert abs(v * sign - w[k, c - 1]) < 1e-7 and int(d) == int(far[k])


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert whitening.whitened(df).count() == 0


def test_whitening_of_low_rank_and_large_entries(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-4, 5, (200, 2))
    vectors = np.stack([a[:, 0], a[:, 1], a[:, 0] + a[:, 1], np.full(200, 3)], 1) * 2.0 ** 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).toPandas()
    e, w, _ = plain_whitening(vectors, 8)
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-6
    assert np.allclose(np.abs(got[got.component == 1].sort_values("id").whitened), np.abs(w[:, 0]), atol=1e-6)
    x = (np.floor(1024 * vectors) + 100_000).astype(object)
    far = ((len(x) * x - x.sum(0)) ** 2).sum(1)  # beyond 64 bits
    assert [int(d) for d in got[got.component == 1].sort_values("id").deviation] == far.tolist()


def plain_search(docs, items, top):
    def terms(t):
        return re.findall(search.TERM, (t or "").translate(UP))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        asked, scores = Counter(terms(text)), []
        for i, c in counts:
            m = 25 + (75 * c.total() * n_docs) // max(total, 1)
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, text or "", r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top])]
    return Counter(out)


@pytest.mark.parametrize("size", [300, 1 << 20])  # many segments, or one for each task
def test_search_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(11)
    words = [w for k in range(60) for w in ["w%d" % k] * (60 // (k + 1))] + ["É", "é", "漢字", "A1"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randrange(40)))) for i in range(400)]
    docs += [(5, docs[5][1]), (None, "w1 w2"), (None, None), (401, ""), (402, "w9 " * 5000), (403, "x" * 9000), (404, "w1 w2"), (405, "W1-W2")]
    docs += [(1000 + i, "w3 w4 w5") for i in range(150)]  # ties
    items = [(1, "w1 w2 w2"), (1, "w40"), (2, "w3 W4 w5"), (2, "w3 W4 w5"), (3, None), (4, "nothing"), (None, "é 漢字"), (5, " ".join(words[:90])), (6, "x" * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS segment", "1 AS term").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(3))
    got = search.search(search.build_index(df, segment_bytes=size), asked, top=7).collect()
    assert Counter(map(tuple, got)) == plain_search(docs, items, 7)
    assert search.search(search.build_index(df.limit(0)), asked).count() == 0
    assert search.search(search.build_index(df.limit(3)), asked.limit(0)).count() == 0


def test_windows_skip_what_cannot_win():
    """Lists that aren't essential are unpacked only where block maxima leave a chance."""
    rng = np.random.default_rng(2)
    docs, total = 20_000, 20_000 * 50
    lists = []
    for some, weight in ((np.arange(0, docs, 2), 10), (rng.choice(docs, 40, replace=False), 9000)):
        some = np.sort(some).astype(np.int64)
        tf, n = np.ones(len(some), np.int64), rng.integers(20, 200, len(some))
        first = np.arange(0, len(some), search.BLOCK)
        size = np.diff(first, append=len(some))
        data, at, wide = search.packed([np.diff(some, prepend=0), tf, n], first, size)
        peaks, pairs = search.peaks_of(tf, n, np.arange(len(some)) // search.BLOCK)
        row = {"data": data.tobytes(), "starts": at[:-1].tolist(), "last": some[first + size - 1].tolist(), "size": size.tolist(), "wide": wide.tolist(), "peaks": peaks.tolist(), "pairs": pairs.tolist()}
        lists.append((search.Postings(row, docs, total), weight, some, n))
    got = search.best_of([x[:2] for x in lists], docs, 5)
    whole = np.zeros(docs, np.int64)
    for p, weight, some, n in lists:
        whole[some] += weight * search.impacts(np.ones(len(some), np.int64), n, docs, total)
    want = sorted(range(docs), key=lambda d: (-whole[d], d))[:5]
    assert got[0].tolist() == want and got[1].tolist() == [int(whole[d]) for d in want]
    assert len(lists[0][0].open) < len(lists[0][0].last) // 2


@needs_data
def test_search_agrees_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = search.op12_ranked_lexical_search(spark, DATA).toPandas().sort_values(["item_id", "rank"], ignore_index=True)
    want = con.execute(search.ORACLE).fetchdf().sort_values(["item_id", "rank"], ignore_index=True)[got.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def small_network(kind=np.float64):
    rng = np.random.default_rng(0)
    layout = gru.Layout(np.array([0, 2, 5, 9]), np.array([0, -1, 1]), 4)
    p = layout.start(np.full(layout.classes, 1 / layout.classes), np.full(layout.words, 0.3))
    codes = [rng.choice([0, 1, 2, 5, 8, 9, 10, 12, 17, 18, 20], k) for k in (5, 40, 3, 1, 17)]
    return layout, {k: v.astype(kind) + (0.1 if k == "u" else 0) for k, v in p.items()}, codes, rng


def test_gradients_of_a_window():
    layout, p, codes, rng = small_network()

    def loss():
        before, now, _ = next(gru.windows(codes, 2))
        return gru.gradients(p, layout, before, now, np.zeros((2, gru.STATE)))
    _, grads, _ = loss()
    rows, sums = grads["embed"]
    grads["embed"] = np.zeros_like(p["embed"])
    grads["embed"][rows] = sums
    for name, v in p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in v.shape)
            old = v[at]
            v[at] = old + 1e-4
            up = loss()[0]
            v[at] = old - 1e-4
            down = loss()[0]
            v[at] = old
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-5 * (1 + abs(grads[name][at])), name


def test_state_is_carried_and_probabilities_sum_to_one():
    layout, p, codes, _ = small_network()
    got = gru.score(p, layout, codes, slots=2)
    tails = [layout.words, layout.words + 2 * layout.buckets]  # one code of each tail class in use

    def steps(code):  # one document, one step at a time
        h, before, total = np.zeros((1, gru.STATE)), -1, 0.0
        for c in code:
            h = gru.forward(p, np.array([[before]]), h)[0][0]
            every = np.array([*range(layout.words), *tails])
            logs = gru.log_probabilities(p, layout, np.repeat(h, len(every), 0), every)
            assert abs(np.exp(logs).sum() - 1) < 1e-6
            total += float(gru.log_probabilities(p, layout, h, np.array([c]))[0])
            before = c
        return total
    assert np.allclose(got, [steps(c) for c in codes], atol=1e-5)


def plain_base(docs, held):
    tokens = {k: [w for w in re.split("[ \t-\r]+", (t or "").translate(UP)) if w] + [None] for k, (_, t) in enumerate(docs)}
    counts = Counter(w for k, (i, _) in enumerate(docs) if not held(i) for w in tokens[k])
    n, v = counts.total(), len(counts)
    return Counter((i, held(i), len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k]), 6)) for k, (i, _) in enumerate(docs))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("words", [3, 1024])
def test_scores_against_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(lm, "WORDS", words)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 3000)
    rng = random.Random(3)
    vocabulary = ["w%d" % k for k in range(50)] + ["É", "é", "İ", "a\xa0b"]
    docs = [(i, " \t".join(rng.choices(vocabulary, k=rng.randrange(30))).upper()) for i in range(200)]
    docs += [(7, docs[7][1])] * 2 + [(None, "w1 w2"), (None, None), (201, ""), (202, "long " * 3000), (203, "\x0b\n"), (204, "y" * 10_000)] + [(300 + i, f"new{i}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS learn", "'p' AS codes").repartition(3)
    got = lm.scored(df, common.crc_of_id() % 7 == 2).collect()
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_base(docs, held)
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm.scored(df.limit(0), F.lit(False)).count() == 0
    nothing = lm.scored(df.limit(5), F.lit(True)).collect()
    assert len(nothing) == 5 and all(r.base_score == 0 and abs(r.score) < 1e-6 and r.n_known == 0 for r in nothing)


def test_words_of_a_class_share_it(spark):
    """Frequent words, words of every tail class and the unknown type together have probability 1."""
    rng = random.Random(4)
    counts = [(b"w%d" % i, rng.choice([1, 1, 1, 2, 2, 3, 5, 8, 40])) for i in range(300)]
    corpus = lm.corpus_of(spark.createDataFrame(counts, "word binary, c long"))
    assert corpus.tokens == sum(c for _, c in counts) and corpus.types == 300
    top = {w for w, _ in corpus.top}
    rest = [c for w, c in counts if w not in top]
    for k in range(lm.TAIL):
        mine = [c for c in rest if c.bit_length() - 1 == k]
        assert (len(mine), sum(mine)) == (corpus.tail_words[k], corpus.tail_tokens[k])


def test_order_of_words_is_learnt():
    """On texts that repeat a cycle the network is far better than any score without context."""
    rng = np.random.default_rng(1)
    layout = gru.Layout(np.arange(0, 21, 5), np.array([0] + [-1] * 3), 2)
    p = layout.start(np.full(layout.classes, 1 / layout.classes), np.full(layout.words, 1 / 5))
    squares = {k: np.zeros_like(v) for k, v in p.items()}
    codes = [(rng.integers(20) + np.arange(60)) % 20 for _ in range(600)]
    gru.learn(p, squares, layout, codes[:500], slots=16)
    assert gru.score(p, layout, codes[500:]).sum() / 6000 > math.log(1 / 20) * 0.6
