"""Random, temporal and chronological holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, hash32
from gapcube.operators.select import take_lowest, take_lowest_hash

ID_BITS = (48, 36, 24, 12)  # ids refine by blocks; the last bounds how many rows are ranked together: 2^12


def micros(t="posted_at") -> Column:
    return F.unix_micros(F.col(t).cast("timestamp"))


def time_levels(us: str) -> list[Column]:
    """Days, 30 seconds, 5 milliseconds and microseconds of a time: at most 6,000 values of one below the one before (days
    apart), so a histogram that is narrowed level by level is short however long and dense a group is."""
    return [F.floor(F.col(us) / unit).cast("bigint") for unit in (86_400_000_000, 30_000_000, 5000)] + [F.col(us)]


def fraction_quota(frac: float):
    return lambda n: F.ceil(dbl(n) * F.lit(frac))


def random_holdout(meta: DataFrame, frac: float = 0.2, seed: str = "20260928") -> DataFrame:
    """ceil(frac * n) items of every event in hash order."""
    rows = meta.select("event", "item_id", "item_num", hash32("R", seed, F.col("item_id")).alias("draw"))
    return take_lowest_hash(rows, ["event"], "draw", "item_num", fraction_quota(frac)).select("event", "item_id", "item_num")


def temporal_holdout(meta: DataFrame, frac: float = 0.2) -> DataFrame:
    """The last ceil(frac * n) items of every event by (time, id)."""
    rows = meta.select("event", "item_id", "item_num", "posted_at", micros().alias("us"))
    levels = [-c for c in (*time_levels("us"), *[F.shiftright(F.col("item_num"), b) for b in ID_BITS])]
    order = [F.col("us").desc(), F.col("item_num").desc()]
    return take_lowest(rows, ["event"], levels, order, fraction_quota(frac)).select("event", "item_id", "item_num", "posted_at")


def temporal_cutoffs(temporal: DataFrame) -> DataFrame:
    return temporal.groupBy("event").agg(F.min("posted_at").alias("t_cutoff"), F.count(F.lit(1)).alias("n_T"))


def chrono_pools(meta: DataFrame) -> DataFrame:
    """Per event: size, first post, and the messages of other events posted strictly before it.

    An event's own messages are never before its first post, so a pool is a prefix of the corpus in time. Each row is
    placed among the sorted first posts (one short array), counts are combined per position, and a running sum over the
    positions gives every pool without pairing rows with events.
    """
    events = meta.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("posted_at").alias("first_post"))
    firsts = events.agg(F.array_sort(F.collect_list("first_post")).alias("a"))
    placed = meta.select("posted_at").withColumn("firsts", firsts.scalar()).select(
        F.expr("size(filter(firsts, f -> f <= posted_at))").alias("position"))
    counts = placed.groupBy("position").agg(F.count(F.lit(1)).alias("rows"))
    running = counts.select("position", F.sum("rows").over(
        Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    by_time = events.select("*", F.unix_micros(F.col("first_post").cast("timestamp")).alias("us"))
    earlier = Window.orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    ranked = by_time.select("event", "n", "first_post", F.count("event").over(earlier).alias("n_source_events"))
    # a row lies before this first post when at most n_source_events first posts are at or before the row
    j = ranked.join(running, running.position <= ranked.n_source_events, "left")
    return j.groupBy("event", "n", "first_post", "n_source_events").agg(
        F.coalesce(F.max("upto"), F.lit(0)).cast("bigint").alias("chrono_pool_n"))


def chrono_sources(pools: DataFrame) -> DataFrame:
    """(event, source event) pairs of the chronological pools: events whose first post is earlier."""
    a, b = pools.alias("a"), pools.alias("b")
    return a.join(b, F.col("b.first_post") < F.col("a.first_post")).select(
        F.col("a.event").alias("event"), F.col("b.event").alias("source_event"))


def future_share(pools: DataFrame) -> DataFrame:
    """Share of the other events' messages that a chronological pool leaves out."""
    total = Window.partitionBy()
    return pools.select("event", (1.0 - dbl("chrono_pool_n") / (F.sum(dbl("n")).over(total) - dbl("n"))).alias("future_share"))


def split_items(meta: DataFrame, frac: float = 0.2, seed: str = "20260928") -> DataFrame:
    """Every item with its holdout flags."""
    r = random_holdout(meta, frac, seed).select("item_id", F.lit(True).alias("r"))
    t = temporal_holdout(meta, frac).select("item_id", F.lit(True).alias("t"))
    return meta.join(r, "item_id", "left").join(t, "item_id", "left").select(
        *meta.columns, F.coalesce("r", F.lit(False)).alias("in_R"), F.coalesce("t", F.lit(False)).alias("in_T"))


def split_manifest(meta: DataFrame, splits: DataFrame, pools: DataFrame) -> DataFrame:
    """One row per event and holdout part: sizes, first post and cutoff (the tabular form of the split manifest)."""
    sizes = splits.groupBy("event").agg(
        F.count(F.when(F.col("in_R"), 1)).alias("n_R"), F.count(F.when(F.col("in_T"), 1)).alias("n_T"),
        F.min(F.when(F.col("in_T"), F.col("posted_at"))).alias("t_cutoff"))
    return pools.join(sizes, "event")
