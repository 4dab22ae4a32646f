"""A worked example, definitions on generated corpora, and rejected inputs."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapcube.operators import cube as C
from gapcube.operators import filters as FL
from gapcube.operators import resample as R
from gapcube.operators import validate as V

# flood: road -> road, road, food; food -> food; help -> road. storm: food -> food; help -> help, help, road.
WORKED = [(f"m{i}", e, y, p) for i, (e, y, p) in enumerate([
    ("flood", "road", "road"), ("flood", "road", "road"), ("flood", "road", "food"), ("flood", "food", "food"), ("flood", "help", "road"),
    ("storm", "food", "food"), ("storm", "help", "help"), ("storm", "help", "help"), ("storm", "help", "road")])]


def frames(spark, rows, truth=None):
    """Predictions of one system and seed, and the metadata they should agree with."""
    pred = spark.createDataFrame([("sys", "9", *r) for r in rows], "system string, seed string, item_id string, event string, y_true string, y_pred string")
    meta = spark.createDataFrame([(i, e, "any", y) for i, e, y, _ in truth or rows], "item_id string, event string, hazard string, label string")
    return pred, meta, C.class_list(meta)


def generated(seed):
    """Events of very different sizes; each has its own class shares, and its own share of rows moved to the next class."""
    g = np.random.default_rng(100 + seed)
    names, rows = np.array(["road", "food", "help", "other", "news"]), []
    for k, size in enumerate((7, 25, 90, 140)):
        true = g.choice(5, size, p=g.dirichlet(np.full(5, 0.5)))
        said = (true + (g.random(size) < g.uniform(0.1, 0.6))) % 5
        rows += [(f"{k}/{i}", f"ev{k}", names[a], names[b]) for i, (a, b) in enumerate(zip(true, said))]
    return rows + [(f"all/{c}", "ev3", c, c) for c in names]


def macro(rows, listed, every):
    """Mean F1 over the classes that a label list holds, from counts of (true, said) pairs."""
    pairs = Counter((y, p) for _, _, y, p in rows)
    true, said = Counter(y for _, _, y, _ in rows), Counter(p for _, _, _, p in rows)
    chosen = {"P": set(true), "D": set(true) | set(said), "O": every}[listed]
    return sum(2 * pairs[c, c] / (true[c] + said[c]) if true[c] + said[c] else 0.0 for c in chosen) / len(chosen)


def test_worked_example(spark):
    pred, meta, classes = frames(spark, WORKED)
    cube = C.confusion_cube(pred, classes)
    ev = {r.event: r for r in C.event_scores(cube).collect()}
    # flood: road 2*2/(3+3), food 2*1/(1+2), help 0; storm: food 1, help 2*2/(3+2), road said but not true
    assert [ev["flood"][f"f1_{k}"] for k in "PDO"] == pytest.approx([4 / 9] * 3)
    assert [ev["storm"][f"f1_{k}"] for k in "PDO"] == pytest.approx([0.9, 0.6, 0.6])
    # together: road 4/(3+4), food 4/(2+3), help 4/(4+2)
    s = C.score_cube(cube).first()
    assert s.pooled_P == pytest.approx(214 / 315) and s.A_P == pytest.approx(214 / 315 - (4 / 9 + 0.9) / 2)


def test_small_cells(spark):
    pred, _, _ = frames(spark, WORKED)  # cells of one message: flood food, flood help, storm food
    r = FL.removal_report(C.pair_counts(pred), 2).first()
    assert (r.removed_cells, r.removed_messages, r.messages_left) == (3, 3, 6) and FL.remove_small_cells(pred, 2).count() == 6


@pytest.mark.parametrize("seed", range(3))
def test_definitions_and_sums(spark, seed):
    rows = generated(seed)
    pred, meta, classes = frames(spark, rows)
    cube = C.confusion_cube(pred, classes).cache()
    s = C.score_cube(cube).first()
    events, every = sorted({r[1] for r in rows}), {r[2] for r in rows}
    for k in "PDO":
        assert s[f"pooled_{k}"] == pytest.approx(macro(rows, k, every))
        assert s[f"per_event_{k}"] == pytest.approx(np.mean([macro([r for r in rows if r[1] == e], k, every) for e in events]))
    for parts in (("T1", "T2", "T3", "T4"), ("T1", "T2alt", "T3alt", "T4"), ("T1", "T2", "T3c", "T4c"), ("W", "N")):
        assert sum(s[p] for p in parts) == pytest.approx(s.A_P, abs=1e-12), parts
    assert s.scoring + s.reweighting == pytest.approx(s.A_P, abs=1e-9)
    # a draw is a corpus in which the drawn events stand that often
    draw = spark.createDataFrame([(5, "ev1", 1), (5, "ev3", 3)], "b long, event string, m long")
    again = cube.filter("event IN ('ev1', 'ev3')")
    for copy in ("second", "third"):
        again = again.unionByName(cube.filter("event = 'ev3'").withColumn("event", F.lit(copy)))
    got, want = R.draw_scores(C.cell_features(cube), draw).first(), C.score_cube(again).first()
    assert [got[n] for n in ("A_P", "A_D", "A_O", *C.TERMS)] == pytest.approx([want[n] for n in ("A_P", "A_D", "A_O", *C.TERMS)], abs=1e-12)
    without = {r.left_out: r.A_P for r in R.jackknife(C.cell_features(cube)).collect()}
    assert without == pytest.approx({e: C.score_cube(cube.filter(F.col("event") != e)).first().A_P for e in events}, abs=1e-9)


def test_accepted_inputs(spark):
    pred, meta, classes = frames(spark, WORKED)
    V.require_valid(pred, meta, classes)
    V.require_valid(pred.filter("event = 'storm'"), meta, classes, partial=True)
    with pytest.raises(V.ValidationError):
        V.assert_no_text(meta.withColumn("text", F.lit("words")))


FAULTS = [
    ("moved and unlisted", [("m0", "storm", "road", "road"), *WORKED[1:8], ("m8", "storm", "help", "boat")],
     ["1 rows whose event disagrees", "1 predictions outside the class list", "incomplete events: ['flood'"]),
    ("twice and relabelled", [*WORKED[:8], ("m8", "storm", "food", "road"), WORKED[3], WORKED[3]], ["2 duplicate item rows", "1 rows whose y_true disagrees"]),
    ("unknown and absent", [*[r for r in WORKED if r[1] == "flood"], ("n1", "flood", "road", "road")], ["1 items not in the metadata", "events with no predictions: ['storm']"]),
]


@pytest.mark.parametrize("name, rows, said", FAULTS, ids=[f[0] for f in FAULTS])
def test_rejected_inputs_name_every_fault(spark, name, rows, said):
    pred, meta, classes = frames(spark, rows, WORKED)
    with pytest.raises(V.ValidationError) as err:
        V.require_valid(pred, meta, classes)
    assert all(text in str(err.value) for text in said)


def test_signature(spark):
    pred, meta, classes = frames(spark, [r for r in WORKED if r[1] == "storm"], WORKED)
    texts = [r.signature for r in V.signatures(C.score_cube(C.confusion_cube(pred, classes)), V.meta_fingerprint(meta), meta).collect()]
    assert len(texts) == 9 and all("|events:1+partial|min-cell:0|meta:" in t for t in texts)
