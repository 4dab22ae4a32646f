"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Every query builds its own inputs."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapcube.operators import cube as C  # noqa: E402
from gapcube.operators import resample as R  # noqa: E402
from gapcube.plans import catalog, fixtures  # noqa: E402
from gapcube.session import local_session  # noqa: E402

QUERIES = ["C6_scores", "FL3_gap_by_threshold", "FL6_cross_event_duplicates", "FL7_within_event_duplicates",
           "V8_validation_report", "P2_temporal_holdout", "P10_training_samples", "G11_headline_shares", "R19_fixed_rate_null", "K2_paired_bootstrap",
           "N4_near_duplicates", "N7_canonical_corpus", "N10_event_profile", "M1_tfidf_weights", "M4_argmax_softmax", "M5_prior_matching"]
DRAWS = 2000


def cube_and_draws(spark, d):
    """The cube of all systems and 2,000 crossed draws of every summary, with intervals."""
    fx = fixtures.fixture(spark, d)
    names = ["A_P", "A_D", "A_O", *C.TERMS]
    draws = R.bootstrap(fx.features, R.event_draws(spark, fx.cube.select("event"), DRAWS), R.seed_draws(spark, fx.cube.select("system", "seed"), DRAWS), names)
    return R.percentiles(draws, ["system"], names)


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "gapcube-bench")
    runs = {"cube_and_2000_draws": cube_and_draws, **{q: catalog.QUERIES[q] for q in QUERIES}}
    only = sys.argv[1:]
    catalog.QUERIES["S14_config_hashes"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    times = {}
    for name, fn in runs.items():
        if only and name not in only:
            continue
        fixtures.forget()
        t = time.time()
        fn(spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
