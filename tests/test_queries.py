"""Registered queries against their reference SQL at the smallest scale (the full comparison is tools/check.py)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, cells  # noqa: E402

DATA = "/root/testdata/sf0.001"
NAMES = ["C1_confusion_cube", "C6_scores", "G1_split_terms", "FL2_threshold_sweep", "R2_bootstrap_draws", "R8_jackknife", "P1_random_holdout", "P3_chrono_pools", "V8_validation_report",
         "N7_canonical_corpus", "FL7_within_event_duplicates", "K1_rank_agreement", "ES2_estimands", "M5_prior_matching", "Q3_results_table"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
