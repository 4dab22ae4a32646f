"""Training plans and capped training samples.

A plan describes pools by their sizes and membership rule; the E x N pool memberships are never stored. Samples are the
lowest hashes of each run. Pool sizes are known from event counts, so one pass over the rows keeps the draws below the
share of the hash range that a run needs, with some slack; a count per run proves that enough were kept, and only runs
that fell short are drawn again from a wider range. What is kept and ranked is about `cap` rows per run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, hash32
from gapcube.operators.filters import text_digest
from gapcube.operators.select import take_lowest_hash
from gapcube.session import written

CAP, CHRONO_MIN = 6000, 3000


def capped(cap: int):
    return lambda n: F.least(n, F.lit(cap))


def training_plan(meta: DataFrame, splits: DataFrame, pools: DataFrame, cap: int = CAP, chrono_min: int = CHRONO_MIN) -> DataFrame:
    """(run_key, pool_n, n_train, eval_n) of the random, temporal, held-out, chronological and size-matched conditions;
    where `splits` has text_norm also those whose pool has no text of the holdout."""
    tot = splits.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("in_R"), 1)).alias("n_R"), F.count(F.when(F.col("in_T"), 1)).alias("n_T"))
    single = tot.select(F.explode(F.array(
        F.struct(F.lit("id_random").alias("run_key"), (F.col("n_all") - F.col("n_R")).alias("pool_n"), F.col("n_R").alias("eval_n")),
        F.struct(F.lit("id_temporal").alias("run_key"), (F.col("n_all") - F.col("n_T")).alias("pool_n"), F.col("n_T").alias("eval_n")))).alias("r")).select("r.*", F.lit(None).cast("bigint").alias("n_override"))
    if "text_norm" in splits.columns:
        for part, kind in (("in_R", "id_random_dedup"), ("in_T", "id_temporal_dedup")):
            sizes = dedup_pool(splits, part).agg(F.count(F.lit(1)).alias("pool_n")).withColumn("eval_n", tot.select("n_" + part[-1]).scalar())
            single = single.unionByName(sizes.select(F.lit(kind).alias("run_key"), "pool_n", "eval_n", F.lit(None).cast("bigint").alias("n_override")))
    p = pools.withColumn("n_all", tot.select("n_all").scalar())
    rest, chrono = F.col("n_all") - F.col("n"), F.col("chrono_pool_n")
    none = F.lit(None).cast("bigint")

    def run(kind, pool, override, when=None):
        s = F.struct(F.concat(F.lit(kind + ":"), F.col("event")).alias("run_key"), pool.alias("pool_n"), F.col("n").alias("eval_n"), override.alias("n_override"))
        return s if when is None else F.when(when, s)
    per_event = p.select(F.explode(F.array_compact(F.array(
        run("loeo", rest, none), run("chrono", chrono, none, chrono >= chrono_min), run("loeon", rest, chrono, (chrono >= chrono_min) & (chrono < cap))))).alias("r")).select("r.*")
    return single.unionByName(per_event).select("run_key", "pool_n", "eval_n", F.least(F.coalesce("n_override", "pool_n"), F.lit(cap)).alias("n_train"))


def full_pool_plan(splits: DataFrame, pools: DataFrame) -> DataFrame:
    """Sizes of the uncapped arm: every held-out run trains on as many rows as the in-distribution pool has."""
    tot = splits.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(~F.col("in_R"), 1)).alias("n_full"))
    one = tot.select(F.lit("id_random_full").alias("run_key"), F.col("n_full").alias("pool_n"), F.col("n_full").alias("n_train"))
    p = pools.withColumn("n_all", tot.select("n_all").scalar()).withColumn("n_full", tot.select("n_full").scalar())
    return one.unionByName(p.select(F.concat(F.lit("loeo_full:"), "event").alias("run_key"), (F.col("n_all") - F.col("n")).alias("pool_n"), F.col("n_full").alias("n_train")))


def dedup_pool(corpus: DataFrame, part: str = "in_R") -> DataFrame:
    """Items outside a holdout whose normalised text does not occur in it."""
    keyed = corpus.select("item_id", "item_num", "event", text_digest().alias("k"), F.col(part).alias("held"))
    seen = keyed.filter("held").select("k").distinct()
    return keyed.filter("NOT held").join(seen, "k", "left_anti").select("item_id", "item_num", "event")


def fuzzy_dedup_pool(pool: DataFrame, near: DataFrame) -> DataFrame:
    """A deduplicated pool without the listed near duplicates."""
    return pool.join(near.select("item_id"), "item_id", "left_anti")


def with_draw(df: DataFrame, *parts: str) -> DataFrame:
    return df.withColumn("draw", hash32(*[F.col(p) for p in parts]))


#: The range of a draw, and the standard deviations and rows by which a run's share of it is widened.
RANGE, SLACK, MORE = 1 << 32, 6.0, 32


def lowest_draws(runs: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first `need` rows of each run by (draw, item_num). Item ids are unique in a pool, so draws are spread evenly.

    `runs` (run_key, seed, pool_n, need, ...) has a row per run; `rows_of(runs)` gives the pool rows of the runs with
    all columns of the runs and `draw`.
    """
    share = (F.col("need") + SLACK * F.sqrt("need") + MORE) / F.greatest("pool_n", F.lit(1))
    runs = written(runs.withColumn("limit", F.least(F.lit(float(RANGE)), F.ceil(share * RANGE).cast("double"))), "runs")
    found = None
    while True:
        drawn = written(rows_of(runs).filter("draw < `limit`"), "drawn")
        have = drawn.groupBy("run_key", "seed").agg(F.count(F.lit(1)).alias("have"))
        short = runs.join(have, ["run_key", "seed"], "left").filter(f"coalesce(have, 0) < need AND `limit` < {RANGE}")
        short = written(short.drop("have").withColumn("limit", F.least(F.lit(float(RANGE)), F.col("limit") * 4)), "short")
        done = short.isEmpty()
        part = drawn if done else drawn.join(short.select("run_key", "seed"), ["run_key", "seed"], "left_anti")
        found = part if found is None else found.unionByName(part)
        if done:
            break
        runs = short
    rank = F.row_number().over(Window.partitionBy("run_key", "seed").orderBy("draw", "item_num"))
    return found.withColumn("rank", rank).filter("rank <= need").drop("rank", "draw", "limit", "pool_n", "need")


def meeting(rows: DataFrame, runs: DataFrame, when: str) -> DataFrame:
    """Every row beside the runs x for which `when` holds: one array of runs (events times seeds), exploded in place."""
    listed = runs.agg(F.collect_list(F.struct(*runs.columns)).alias("all_runs"))
    both = rows.withColumn("all_runs", listed.scalar()).select(*rows.columns, F.explode(F.expr(f"filter(all_runs, x -> {when})")).alias("x")).select(*rows.columns, "x.*")
    return with_draw(both, "run_key", "seed", "item_id")


def seeded(df: DataFrame, seeds: Sequence[str]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def sample_pool(pool: DataFrame, run_key: str, seeds: Sequence[str], cap: int = CAP) -> DataFrame:
    """(run_key, seed, item_id, item_num, event): seeded samples of one pool."""
    size = pool.agg(F.count(F.lit(1)).alias("pool_n"))
    runs = seeded(size.select(F.lit(run_key).alias("run_key"), "pool_n", F.least("pool_n", F.lit(cap)).alias("need")), seeds)
    return lowest_draws(runs, lambda r: meeting(pool.select("item_id", "item_num", "event"), r, "true")).select("run_key", "seed", "item_id", "item_num", "event")


def heldout_runs(meta: DataFrame, seeds: Sequence[str], cap: int, kind: str) -> DataFrame:
    sizes = meta.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t"))
    rest = (F.col("t") - F.col("n")).alias("pool_n")
    runs = sizes.withColumn("t", total.scalar()).select(F.col("event").alias("held_out"), F.concat(F.lit(kind + ":"), "event").alias("run_key"), rest)
    return seeded(runs.withColumn("need", F.least("pool_n", F.lit(cap))), seeds)


def sample_heldout(meta: DataFrame, seeds: Sequence[str], cap: int = CAP, kind: str = "loeo", carry: Sequence[str] = ()) -> DataFrame:
    """Samples of every held-out run: the pool of `kind:e` is every message of the other events."""
    rows = meta.select("item_id", "item_num", "event", *carry)
    return lowest_draws(heldout_runs(meta, seeds, cap, kind), lambda r: meeting(rows, r, "x.held_out <> event"))


def sample_chrono(meta: DataFrame, pools: DataFrame, seeds: Sequence[str], cap: int = CAP, chrono_min: int = CHRONO_MIN, carry: Sequence[str] = ()) -> DataFrame:
    """Samples of every eligible chronological run: messages posted before the held-out event's first post."""
    some = pools.filter(F.col("chrono_pool_n") >= chrono_min)
    runs = seeded(some.select(F.col("event").alias("held_out"), "first_post", F.concat(F.lit("chrono:"), "event").alias("run_key"), F.col("chrono_pool_n").alias("pool_n"), F.least("chrono_pool_n", F.lit(cap)).alias("need")), seeds)
    rows = meta.select("item_id", "item_num", "event", "posted_at", *carry)
    return lowest_draws(runs, lambda r: meeting(rows, r, "posted_at < x.first_post").drop("posted_at", "first_post"))


def sample_size_matched(meta: DataFrame, pools: DataFrame, seeds: Sequence[str], cap: int = CAP, chrono_min: int = CHRONO_MIN, carry: Sequence[str] = ()) -> DataFrame:
    """Held-out samples of the size of the chronological run of the same event."""
    wanted = pools.filter(F.col("chrono_pool_n") >= chrono_min).select(F.col("event").alias("held_out"), F.least("chrono_pool_n", F.lit(cap)).alias("size"))
    runs = heldout_runs(meta, seeds, cap, "loeon").join(wanted, "held_out").withColumn("need", F.least("pool_n", "size")).drop("size")
    rows = meta.select("item_id", "item_num", "event", *carry)
    return lowest_draws(runs, lambda r: meeting(rows, r, "x.held_out <> event"))


def sample_paired(base: DataFrame, pool: DataFrame, run_key: str, cap: int = CAP) -> DataFrame:
    """Keep the base run's sample where the pool allows and fill up from the rest of the pool."""
    kept = base.join(pool.select("item_id"), "item_id", "left_semi").withColumn("run_key", F.lit(run_key))
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    have = base.select("seed").distinct().join(kept.groupBy("seed").agg(F.count(F.lit(1)).alias("kept")), "seed", "left").na.fill(0, ["kept"])
    runs = have.withColumn("size", size.scalar()).select(F.lit(run_key).alias("run_key"), "seed", (F.col("size") - F.col("kept")).alias("pool_n"), (F.least("size", F.lit(cap)) - F.col("kept")).alias("need"))

    def rest(runs: DataFrame) -> DataFrame:
        both = meeting(pool.select("item_id", "item_num", "event"), runs, "true").join(base.select("seed", "item_id"), ["seed", "item_id"], "left_anti")
        return both.withColumn("draw", hash32(F.concat(F.col("run_key"), F.lit("|fill")), F.col("seed"), F.col("item_id")))
    names = ["run_key", "seed", "item_id", "item_num", "event"]
    return kept.select(*names).unionByName(lowest_draws(runs, rest).select(*names))


def sample_fingerprint(sample: DataFrame, by: Sequence[str] = ("run_key", "seed")) -> DataFrame:
    """SHA-256 of the comma-joined sorted ids of each capped sample (at most `cap` ids per run)."""
    ids = F.transform(F.array_sort(F.collect_list("item_num")), lambda i: i.cast("string"))
    return sample.groupBy(*by).agg(F.count(F.lit(1)).alias("n_train"), F.sha2(F.array_join(ids, ","), 256).alias("train_ids_sha256"))


def verify_training_ids(samples: DataFrame, recorded: DataFrame) -> DataFrame:
    """Runs whose rebuilt sample differs from the recorded fingerprint or size."""
    now = sample_fingerprint(samples).select("run_key", "seed", F.col("n_train").alias("n_now"), F.col("train_ids_sha256").alias("sha_now"))
    j = recorded.join(now, ["run_key", "seed"], "left")
    bad = ~(F.col("sha_now").eqNullSafe(F.col("train_ids_sha256")) & F.col("n_now").eqNullSafe(F.col("n_train")))
    return j.agg(F.count(F.lit(1)).alias("runs_checked"), F.count(F.when(bad, 1)).alias("mismatches"),
                 F.array_join(F.array_sort(F.collect_list(F.when(bad, F.concat("run_key", F.lit("/"), "seed")))), ",").alias("mismatched_runs"))


def train_event_counts(sample: DataFrame, by: Sequence[str] = ("run_key", "seed")) -> DataFrame:
    return sample.groupBy(*by, "event").agg(F.count(F.lit(1)).alias("n"))


def hazard_tvd(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total-variation distance of the hazard mix of two samples per group. Inputs: (by, hazard, n)."""
    def mix(df, name):
        g = Window.partitionBy(*by)
        h = df.groupBy(*by, "hazard").agg(F.sum("n").alias("n"))
        return h.select(*by, "hazard", (dbl("n") / F.sum(dbl("n")).over(g)).alias(name))
    j = mix(a, "p1").join(mix(b, "p2"), [*by, "hazard"], "full_outer").na.fill(0.0, ["p1", "p2"])
    return j.groupBy(*by).agg((0.5 * F.sum(F.abs(F.col("p1") - F.col("p2")))).alias("tvd"))


def diversity_matched(pools: DataFrame, cap: int = CAP, chrono_min: int = CHRONO_MIN, tries: int = 200) -> DataFrame:
    """Per eligible event: the first of `tries` random sets of k other events whose pool is large enough.

    k is the number of source events of the chronological pool. Works on event sizes only.
    """
    e = pools.filter(F.col("chrono_pool_n") >= chrono_min).select("event", F.col("n_source_events").alias("k"), F.least("chrono_pool_n", F.lit(cap)).alias("need"))
    others = pools.select(F.col("event").alias("other"), F.col("n").alias("other_n"))
    each = e.join(others, F.col("event") != F.col("other")).select("*", F.explode(F.expr(f"sequence(0, {tries - 1})")).alias("try"))
    rank = F.row_number().over(Window.partitionBy("event", "try").orderBy(hash32("divk", F.col("event"), F.col("try"), F.col("other")), "other"))
    chosen = each.withColumn("rk", rank).filter("rk <= k").groupBy("event", "k", "need", "try").agg(
        F.sum("other_n").alias("pool_n"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("chosen"))
    first = chosen.filter("pool_n >= need").groupBy("event").agg(F.min(F.struct("try", "k", "need", "pool_n", "chosen")).alias("f"))
    return first.select("event", F.col("f.try").cast("bigint").alias("try"), "f.k", F.col("f.need").alias("n_train"), "f.pool_n", "f.chosen")


def source_validation_split(meta: DataFrame, held_out: str, protected: Sequence[str], seed: str, n_train: int = 6000, n_val: int = 600) -> DataFrame:
    """Disjoint training and source-validation rows outside the held-out and protected events."""
    pool = meta.filter((F.col("event") != held_out) & ~F.col("event").isin(list(protected)))
    rows = pool.select("item_id", "item_num", "event", F.lit(0).alias("g"), hash32("conv", held_out, seed, F.col("item_id")).alias("draw"))
    both = take_lowest_hash(rows, ["g"], "draw", "item_num", capped(n_train + n_val))
    train = take_lowest_hash(both, ["g"], "draw", "item_num", capped(n_train)).select("item_id", F.lit("train").alias("part"))
    return both.select("item_id", "event").join(train, "item_id", "left").select("item_id", "event", F.coalesce("part", F.lit("validation")).alias("part"))


def cap_share(meta: DataFrame, cap: int = CAP) -> DataFrame:
    """Range over held-out events of the share of the other messages that the cap draws."""
    n = meta.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(cap)) / (F.sum(dbl("n")).over(Window.partitionBy()) - dbl("n"))
    return n.select(share.alias("s")).agg(F.min("s").alias("share_min"), F.max("s").alias("share_max"))
