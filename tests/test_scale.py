"""What queries store and exchange must not outgrow their input."""
import os

import pytest

from gapcube.plans import catalog, fixtures

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@needs_data
def test_masked_samples_read_texts_of_the_sample_only(spark):
    fixtures.forget()
    try:
        assert catalog.QUERIES["P8_masked_samples"](spark, DATA).count() > 0
        fx = fixtures.fixture(spark, DATA)
        assert "dsplit" not in fx.__dict__  # the table that stores every text with its key
        assert sorted(r.item_id for r in fx.dpool.collect()) == sorted(r.item_id for r in fx.dsplit.filter("NOT in_R").collect())
        assert fx.dpool.columns == ["item_id", "item_num", "event"]
    finally:
        fixtures.forget()


def test_fits_exchange_words_and_not_pairs(spark):
    from gapcube.operators import fits
    rows = [("1", "e", "a", "one two two one two"), ("2", "e", "b", "x"), ("3", "e", "b", None), ("4", "e", "a", "two one")]
    coded = fits.coded_texts(spark.createDataFrame(rows, "item_id string, event string, label string, text string"))
    table = coded.orderBy("item_id").toArrow()
    assert [len(c or []) for c in table.column("codes").to_pylist()] == [5, 0, 0, 2]
    row, code = fits.rows_of(table.column("codes"))
    assert sorted(row.tolist()) == [0] * 9 + [3] * 3  # words and pairs; no pair across texts
    terms = {}
    for r, c in zip(row.tolist(), code.tolist()):
        terms.setdefault(r, []).append(c)
    assert sorted(terms[0].count(c) for c in set(terms[0])) == [1, 1, 2, 2, 3]  # one, two, "one two", "two two", "two one"
    assert set(terms[3]) <= set(terms[0]) and len(set(terms[3])) == 3


def test_fingerprints_join_near_copies_first(spark):
    from gapcube.llm import shingles
    near = [(i, 1 << i) for i in range(40)]  # any two differ in two bits
    rows = [*near, (100, 1 << 3), (101, 0b1111 << 50), (102, 0)]
    got = shingles.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()
    up = {n: n for n, _ in rows}
    for a, b in sorted((r.a, r.b) for r in got):
        low, high = sorted((up[a], up[b]))
        up = {n: low if t == high else t for n, t in up.items()}
    assert {n for n, t in up.items() if t == 0} == {*range(40), 100, 102}  # 101 is four bits away from 0
    assert len(got) <= 2 * len(rows)  # not the 861 pairs of the cluster
    made = spark.createDataFrame([(i, " ".join("w%d" % k for k in range(300)) + f" z{i}") for i in range(30)], "doc_id long, text string")
    assert sum(r.first for r in shingles.near_copies(made).collect()) == 1
