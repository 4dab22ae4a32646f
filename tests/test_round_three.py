import json
import math
import os
import re

import pytest

from gapcube.operators import similarity as SIM
from gapcube.operators import validate as V
from gapcube.operators.estimands import arm_cube
from gapcube.plans.fixtures import Fixture
from gapcube.session import scratch_path
from gapcube.sources import io as IO


@pytest.fixture
def replanned_joins(spark):
    """Joins are planned by sorting and broadcast at run time, when the sizes are known."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10485760")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_an_array_is_one_file_when_a_join_is_planned_anew(spark, replanned_joins):
    path = scratch_path(spark, "arrays")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        # messages of very different size, so that both sides of the join are coalesced differently
        df = spark.range(20000).selectExpr("concat('ev', id % 7) AS e", "concat('s', id % 3) AS s", "id AS n", "cast(id AS string) AS item_id", "repeat('x}', 10 * cast(id % 100 AS int)) AS text_raw", "'l' AS label")
        IO.write_json_arrays(df, ["e", "s"], "n", path)
        files = [os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.startswith("part-")]
        assert len(files) == 21
        for f in files:
            ids = [int(m["item_id"]) for m in json.load(open(f))]
            assert ids == sorted(ids) and len({i % 21 for i in ids}) == 1
        got = IO.read_raw_json(spark, f"{path}/*/*").selectExpr("count(*)", "count(distinct item_id)", "sum(length(text_raw))").first()
        assert tuple(got) == (20000, 20000, sum(20 * (i % 100) for i in range(20000)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_table_of_many_files_counts_once(spark, tmp_path, monkeypatch):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    for limit in (IO.ONE_CELL, 0):  # all files in a cell, none
        monkeypatch.setattr(IO, "ONE_CELL", limit)
        hashes = IO.file_sha256(spark, [f"{tmp_path}/{n}.parquet" for n in "ab"])
        assert hashes.count() == 5
        assert tuple(IO.same_hashes(hashes, ["a.parquet", "b.parquet"]).first()) == (True, 64, 2)


def test_texts_that_are_all_alike_give_one_pair_each_and_group(spark):
    # 40 texts to search for and 40 to search in: all 1,600 pairs reach the threshold, the best of each group is passed on
    texts = [f"the same words again and again in every one of these many texts and at last one of its own x{'abcdefgh'[i % 8]}{'abcdefghij'[i // 8]}" for i in range(80)]
    df = spark.createDataFrame([(str(i), i, "e", i >= 40, t) for i, t in enumerate(texts)], "item_id string, item_num long, event string, in_R boolean, text_norm string")
    weights = SIM.gram_weights(df, SIM.representatives(df))
    left, right = weights.filter("rep < 40").select("rep"), weights.filter("rep >= 40").selectExpr("rep", "explode(array(concat('g', rep % 2), 'all')) AS grp")
    vec = {}
    n_of = SIM.vocabulary_of(spark.read.schema("gram long, df long, n long").parquet(*weights.schema["g"].metadata["vocabulary"]))[1]
    for r in weights.collect():
        x = [(1 + math.log(k)) * (math.log(81 / (1 + n_of[g])) + 1) for g, k in zip(r.g, r.tf)]
        norm = math.sqrt(sum(v * v for v in x))
        vec[r.rep] = {g: v / norm for g, v in zip(r.g, x)}

    def cosine(a, b):
        return sum(v * vec[b].get(g, 0.0) for g, v in vec[a].items())
    got = {}
    for r in SIM.best_pairs(weights, left, right, 0.3).collect():
        assert r.sim == pytest.approx(cosine(r.l, r.r), abs=1e-9)
        got.setdefault(r.l, []).append((r.r, r.sim))
    assert set(got) == set(range(40))
    for a, pairs in got.items():
        for group in (range(40, 80), range(40, 80, 2), range(41, 80, 2)):
            top = max(cosine(a, b) for b in group)
            best = {b for b in group if cosine(a, b) > top - 1e-10}
            assert best <= {b for b, _ in pairs}
        assert len({b for b, _ in pairs}) < 30  # of 40, ties included


def test_probabilities_as_columns_are_written_like_a_map(spark):
    df = spark.createDataFrame([("1", "e", "a", "b b", 0.12345, 0.87655), ("2", "e", "b b", "a", 0.5, 0.00005)], ["item_id", "event", "y_true", "y_pred", "p_a", "p_b b"])
    mapped = df.selectExpr("item_id", "event", "y_true", "y_pred", "map('a', p_a, 'b b', `p_b b`) AS p")
    got = []
    for x in (df, mapped):
        path = scratch_path(spark, "written")
        IO.write_predictions(x, ["a", "b b"], path)
        got.append(sorted((r.item_id, tuple(sorted(r.p.items()))) for r in IO.read_scored(spark, [path]).collect()))
    assert got[0] == got[1] == [("1", (("a", 0.1234), ("b b", 0.8766))), ("2", (("a", 0.5), ("b b", 0.0)))]


def test_arms_are_counted_without_storing_the_rows(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    assert fx.arms.count() > 0 and "runs" not in fx.__dict__
    stored = arm_cube(fx.runs, fx.eclasses)
    assert fx.arms.exceptAll(stored).isEmpty() and stored.exceptAll(fx.arms).isEmpty()


def test_checks_deal_rows_over_as_many_tasks_as_they_need(spark, monkeypatch):
    pred = spark.range(3000).selectExpr("'a' AS system", "'1' AS seed", "cast(id % 2900 AS string) AS item_id", "concat('e', id % 3) AS event", "'x' AS y_true", "if(id % 10 = 0, 'z', 'x') AS y_pred")
    meta = spark.range(2800).selectExpr("cast(id AS string) AS item_id", "concat('e', id % 3) AS event", "if(id % 7 = 0, 'y', 'x') AS label")
    classes = spark.sql("SELECT array('x', 'y') AS classes")
    want = V.row_checks(pred, meta, classes).first()
    monkeypatch.setattr(V, "TASK_ROWS", 100)
    checked = V.checked_events(pred, meta, classes)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(item_id#\d+, 30\)", plan)
    got = V.row_checks(pred, meta, classes).first()
    assert got == want
    ids = [(i % 2900, i) for i in range(3000)]
    assert got.unknown_items == sum(k >= 2800 for k, _ in ids) and got.stray_classes == 300
    assert got.wrong_label == sum(k < 2800 and k % 7 == 0 for k, _ in ids)
    assert got.wrong_event == sum(k < 2800 and k % 3 != i % 3 for k, i in ids)


def test_runs_of_an_item_are_whole_lists(spark):
    """Which runs an item is in follows from four flags; no list is filtered by a function per row."""
    import duckdb
    from gapcube.plans.fixtures import RUNS_SQL
    d = "/root/testdata/sf0.001"
    rows = Fixture(spark, d).run_rows
    assert ".scope" not in rows._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    names = ["model", "seed", "run", "item_id", "event", "in_R", "in_T", "y_true", "y_pred"]
    want = con.execute(f"WITH {RUNS_SQL} SELECT {', '.join(names)} FROM runs").fetchall()
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(want)


def test_terms_are_exchanged_once(spark, monkeypatch):
    """Weights by hand; pairs of text and term go out by term once and come back by text once, however many blocks."""
    from gapcube.operators import models as M
    monkeypatch.setattr(M, "BLOCK_BYTES", 10)
    texts = {"1": "ab cd ab cd ef", "2": "AB cd gh", "3": "", "4": "cd", "5": None, "6": "xx yy"}
    w = M.tfidf_weights(spark.createDataFrame(list(texts.items()), "item_id string, text string"))
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RepartitionByExpression \[term#", plan)) == 1 and len(re.findall("RepartitionByExpression", plan)) == 3 and "Join" not in plan
    terms = {k: (lambda t: t + [f"{a} {b}" for a, b in zip(t, t[1:])])((x or "").lower().split()) for k, x in texts.items()}
    df = {t: sum(t in v for v in terms.values()) for v in terms.values() for t in v}
    want = {}
    for k, v in terms.items():
        x = {t: (1 + math.log(v.count(t))) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in v if df[t] >= 2}
        norm = math.sqrt(sum(y * y for y in x.values()))
        want |= {(k, t): y / norm for t, y in x.items()}
    got = {(r.item_id, r.term): r.w for r in w.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
