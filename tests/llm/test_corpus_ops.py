"""Packing, duplicates, repeated passages and the pipeline against brute force."""
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from gapcube.llm import common, components, exact, packing, repeats, shingles, simhash, suffix, toxicity

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(UP)).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def uncovered(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = True
        out.append((b, gone))
    return out


def test_exact_duplicates(spark):
    rows = [(1, "Ab"), (5, "aB"), (5, "ab"), (None, "AB"), (2, None), (3, ""), (4, "É"), (6, "é"), (7, "x" * 50_000)] + [(100 + i, "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS keep_id", "2 AS kept").repartition(7)
    got = exact.exact_dedup(df, fan_in=2).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha((t or "").translate(UP))].append(i)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    for r in got:
        mine = groups[r.text_sha256]
        assert r.group_size == len(mine) and r.keep_id == max(x for x in mine if x is not None)
    assert kept == Counter(dict.fromkeys(groups, 1))
    small = exact.exact_dedup(df, largest=False).filter("kept").collect()
    assert {r.text_sha256: r.id for r in small} == {k: min(x for x in v if x is not None) for k, v in groups.items()}
    assert exact.exact_dedup(df.limit(0)).count() == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_best_fit_never_overfills():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 3000)
    bins, offsets, used = packing.best_fit(sizes, 100)
    assert used.max() <= 100 and used.sum() == sizes.sum() and len(used) <= -(-sizes.sum() // 100) * 1.01
    for b in range(len(used)):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert offsets[mine].tolist() == np.concatenate([[0], np.cumsum(sizes[mine])[:-1]]).tolist()


def check_packed(pieces, docs, size):
    want = {}
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for i, t in docs:
        want.setdefault(i, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    bins, sums = defaultdict(list), defaultdict(int)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
        sums[p.doc_id] += p.length
        assert any(len(w) >= p.start + p.length and zlib.crc32(w[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for w in want[p.doc_id])
    assert sums == {i: sum(map(len, w)) for i, w in want.items()}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    return len(bins), -(-sum(sums.values()) // size)


def test_packing(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["one", "two", "drei", "ü"], k=rng.randrange(120)))) for i in range(300)] + [(300, None), (301, ""), (302, "word " * 900), (5, "again"), (5, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS length").repartition(6)
    used, least = check_packed(packing.pack(df, size=128, group_items=20, fan_in=2).collect(), docs, 128)
    assert used <= least * 1.03 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_fingerprints_and_hash():
    rng = random.Random(2)
    texts = [None, "", "  ", "A", "b C", "x" * 5000 + " y z", " \t a\x0bb\x0cc d "] + [" ".join("".join(rng.choices("aBÉ漢", k=rng.randrange(1, 50))) for _ in range(rng.randrange(30))) for _ in range(150)]
    import pyarrow as pa
    assert [int(x) for x in simhash.fingerprints(*common.flat(pa.array(texts)))] == [fingerprint(t) for t in texts]


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    docs = []
    for g in range(20):
        base = rng.choices(words, k=120)
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(120)] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
    docs += [(900, None), (901, ""), (902, "\n")] + [(i, "same words here") for i in range(1000, 1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS first").repartition(5)
    got = {r.id: r for r in simhash.near_duplicates(df).collect()}
    fps = [fingerprint(t) for _, t in docs]
    top = components_of(fps)
    for k, (i, _) in enumerate(docs):
        assert got[i].fp & (2 ** 64 - 1) == fps[k] and got[i].component_id == docs[top[k]][0]
        assert got[i].first == (i == got[i].component_id)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_are_complete_for_every_plan(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 3}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    for parts in ((2,), (3,), (4,)):
        monkeypatch.setattr(simhash, "PARTS", parts)
        got = {tuple(sorted((fps[r.a], fps[r.b]))) for r in simhash.links_of(df).collect()}
        assert got == want


def test_dynamic_programming_spends_the_distance():
    cost = [[0, 5, 50, 500], [0, 1, 2, 300], [0, 9, 90, 900]]
    c, t = simhash.thresholds(cost, 3)
    assert sum(x + 1 for x in t) == 4 and c == min(sum(cost[i][x + 1] for i, x in enumerate(u)) for u in [(a, b, d) for a in range(-1, 3) for b in range(-1, 3) for d in range(-1, 3)] if sum(x + 1 for x in u) == 4)


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_suffix_arrays():
    rng = random.Random(1)
    for t in range(150):
        s = [rng.randrange(rng.choice([1, 2, 4, 26])) + 1 for _ in range(rng.randrange(150))] * rng.choice([1, 3]) + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix.suffix_array(np.array(s), 257).tolist() == want
        data = np.array(s[:-1], np.uint8)
        if len(data):
            found = suffix.common_prefixes(data, np.array(want)[1:], 1000, np.zeros(len(data), bool))
            for a, b in zip(want[1:], want[2:]):
                n = 0
                while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                    n += 1
                assert found[b] == n


@pytest.mark.parametrize("shard_bytes", [50, 100_000])  # the small one makes every anchor too large for a shard
def test_repeated_strings(spark, shard_bytes):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdé漢", k=rng.randrange(1, 6))) for _ in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(100)]
    shared = [" ".join(rng.choices(words, k=15)) for _ in range(3)]
    for _ in range(80):
        i = rng.randrange(100)
        texts[i] = texts[i][:rng.randrange(len(texts[i]) + 1)] + rng.choice(shared) + texts[i][-rng.randrange(1, 40):]
    texts += texts[:5] + ["", "x" * 500, "ab" * 200, None]
    docs = [(3 if i == 7 else i, t) for i, t in enumerate(texts)] + [(None, texts[20])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS place").repartition(5)
    want = sorted((i is not None, i or 0, len(b), int(g.sum()), b"".join(bytes([c]) for c, x in zip(b, g) if not x)) for (i, _), (b, g) in zip(docs, uncovered([t for _, t in docs], 40)))
    rows = repeats.with_spans(df, window=40, gram=16, shard_bytes=shard_bytes).select("doc_id", "_text", "_spans").collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, len(r._text.encode()), len(r._text.encode()) - len(repeats.cut_out(r._text.encode(), r._spans)[0]), repeats.cut_out(r._text.encode(), r._spans)[0]) for r in rows)
    assert got == want
    assert repeats.without_repeats(df.limit(0)).columns == df.columns


@needs_data
def test_pipeline_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    model = toxicity.train(toxicity.labelled_rows(spark, DATA))
    scored = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", toxicity.score(model).alias("s")).collect()
    left = {r.doc_id: docs[r.doc_id] for r in scored if r.s < 0.3}
    last = {}
    for i in sorted(left):
        last[(left[i] or "").translate(UP)] = i
    left = {i: left[i] for i in sorted(last.values())}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["exact_dedup"](spark, stages["toxicity"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA), DATA)
    assert {r.doc_id for r in kept.collect()} == set(left)
    ids = list(left)
    top = near_components([left[i] or "" for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if top[k] == k}
    assert {r.doc_id for r in stages["simhash_near_dedup"](spark, kept, DATA).collect()} == set(left)
    cut = uncovered(left.values(), 200)
    final = [(i, bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore")) for i, (b, g) in zip(left, cut)]
    used, least = check_packed(corpus_pipeline.run(spark, DATA).collect(), final, 2048)
    assert used <= least + 2


@needs_data
def test_exact_dedup_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = exact.op6_exact_dedup(spark, DATA).toPandas()
    want = con.execute(exact.ORACLE).fetchdf()[got.columns]
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), want.sort_values("doc_id", ignore_index=True), check_dtype=False)


def similarity(a, b):
    def of(t):
        w = t.translate(UP).replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in re.split("[ \t-\r]+", w) if x]
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or {" ".join(w)} - {""}
    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near_components(texts):
    """Smallest index of each text's component, by all pairs of five-word shingle sets."""
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("sample, turns", [(4096, 3), (1, 0)])  # all shared shingles are known as common, or none; some pairs left to the end, or all
def test_near_copies_of_every_similarity(spark, monkeypatch, sample, turns):
    monkeypatch.setattr(shingles, "SAMPLE", sample)
    monkeypatch.setattr(shingles, "TURNS", turns)
    rng = random.Random(7)
    words = ["w%d" % i for i in range(3000)]
    docs = []
    for g in range(40):
        base = rng.choices(words, k=rng.randrange(5, 200))
        docs.append((len(docs), " ".join(base)))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            copy = copy[rng.randrange(1 + len(base) // 12):]
            docs.append((len(docs), " ".join(copy).upper()))
    docs += [(900, None), (901, ""), (902, "\n"), (903, "a b"), (904, "A\tb"), (None, "a b"), (905, "a c"), (906, "a b c d e f g h"), (907, "a b c d e f g h i")]
    docs += [(1000 + i, " ".join(["q%d" % k for k in range(60)] + ["z%d" % i])) for i in range(60)]
    texts = [t or "" for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    far = [p for p in pairs if (fingerprint(texts[p[0]]) ^ fingerprint(texts[p[1]])).bit_count() > 3]
    for i, j in pairs:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    assert len(far) > 20  # pairs that three bits miss
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node").repartition(5)
    got = [(r.id, r.component_id, r.first) for r in shingles.near_copies(df).collect()]
    want = [(i, docs[top(k)][0], i == docs[top(k)][0]) for k, (i, _) in enumerate(docs)]
    assert Counter(got) == Counter(want)
    assert shingles.near_copies(df.limit(0)).count() == 0
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df.drop("node"), "").collect()}
    assert left == {i for i, c, first in want if first}


def test_packing_of_very_long_white_space(spark, monkeypatch):
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "LONG_RUN", 4)
    encode = packing.encoder(path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["".join(rng.choices([" ", " " * 5, "\n\t\r \n", "\xa0" * 4, " " * 6, "\x1c" * 5, "a", "'s", "12", "!", "é", "<|endoftext|>"], k=rng.randrange(12))) for _ in range(2000)]
    for t in texts:
        assert list(encode(t)) == lib.encode(t, add_special_tokens=False).ids
    monkeypatch.undo()
    n = 3_000_000
    docs = [(1, "a" + " " * n + "b"), (2, "\n" * n), (3, "x")]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("doc_id").sum("length").collect()
    coder = packing.encoder(path("byte_bpe_50k.json"))
    assert {r[0]: r[1] for r in got} == {i: len(coder(t)) + 1 for i, t in docs}
    short = {c: np.array(lib.encode(c * 50_000, add_special_tokens=False).ids) for c in " \n"}
    assert [*coder("a")] + [*coder(" " * (n - 1))] + [*coder(" b")] == [*coder(docs[0][1])]
    for c in " \n":  # the ids of a run repeat
        ids = np.array(coder(c * n))
        assert (ids[:len(short[c]) // 2] == short[c][:len(short[c]) // 2]).all()
