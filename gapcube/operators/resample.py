"""Bootstrap, jackknife and fixed-rate resampling as joins with draw tables.

A draw is a table of multiplicities. Scores of a draw come from the additive cell sums of `cube`, weighted by how often
the draw took the event; a mean over drawn seeds becomes a mean weighted by how often it took the seed. The event and
seed slots of a draw depend on hashes only, so a lost task recomputes the same draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl, hash32
from gapcube.operators import cube as C

CI = {"lo95": 0.025, "hi95": 0.975}
CI_ALL = {"q025": 0.025, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q975": 0.975}


def numbered(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct names (events, seeds) with their position in sorted order and the group size; short tables only."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    d = df.select(*by, name).distinct()
    return d.select(*by, name, (F.row_number().over(group.orderBy(name)) - 1).alias("pos"), F.count(F.lit(1)).over(group).alias("size"))


def event_draws(spark: SparkSession, events: DataFrame, draws: int, tag: str = "ev", by: Sequence[str] = ()) -> DataFrame:
    """(b, *by, event, m): E events drawn with replacement in each draw; with `by`, from the events of each group."""
    e = numbered(events, by, "event")
    groups = e.filter("pos = 0").agg(F.collect_list(F.struct(*by, "size")).alias("u"))  # one entry per group
    slots = spark.range(draws).select(F.col("id").alias("b")).withColumn("u", groups.scalar()).select("b", F.explode("u").alias("u")).select(
        "b", "u.*", F.explode(F.expr("sequence(0L, u.size - 1)")).alias("slot"))
    picked = slots.select("b", *by, (hash32(tag, F.col("b"), F.col("slot")) % F.col("size")).alias("pos"))
    return picked.join(e.drop("size"), [*by, "pos"]).groupBy("b", *by, "event").agg(F.count(F.lit(1)).alias("m"))


def seed_draws(spark: SparkSession, runs: DataFrame, draws: int, unit: str = "system", tag: str = "sd") -> DataFrame:
    """(b, unit, seed, ms, n_seeds): each unit's seeds drawn with replacement in each draw."""
    s = numbered(runs, [unit], "seed")
    units = s.filter("pos = 0").agg(F.collect_list(F.struct(unit, "size")).alias("u"))  # one entry per system
    slots = spark.range(draws).select(F.col("id").alias("b")).withColumn("u", units.scalar()).select("b", F.explode("u").alias("u")).select(
        "b", "u.*", F.explode(F.expr("sequence(0L, u.size - 1)")).alias("slot"))
    picked = slots.select("b", unit, "size", (hash32(tag, F.col(unit), F.col("b"), F.col("slot")) % F.col("size")).alias("pos"))
    return picked.join(s.drop("size"), [unit, "pos"]).groupBy("b", unit, "seed").agg(
        F.count(F.lit(1)).alias("ms"), F.max("size").alias("n_seeds"))


def draw_scores(features: DataFrame, draws: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Scores of every (draw, run); draws may differ by some of the keys."""
    joined = features.join(draws, ["event", *[k for k in keys if k in draws.columns]])
    return C.scores(C.class_sums(joined, ["b", *keys], "m"), ["b", *keys])


def seed_weighted(per_run: DataFrame, seeds: DataFrame, columns: Sequence[str], by: Sequence[str] = ("b", "system")) -> DataFrame:
    """Mean of each column over the drawn seeds."""
    j = per_run.join(seeds, ["b", by[-1], "seed"])
    return j.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("ms")) / F.max("n_seeds")).alias(c) for c in columns])


def bootstrap(features: DataFrame, event_draw: DataFrame, seed_draw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Seed-mean values of every (draw, system): crossed resampling of events and seeds."""
    return seed_weighted(draw_scores(features, event_draw), seed_draw, columns)


def percentiles(draws: DataFrame, by: Sequence[str], columns: Sequence[str], points: dict[str, float] = CI) -> DataFrame:
    """Linear-interpolation percentiles of each column over draws."""
    ps = list(points.values())
    packed = draws.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in columns])
    return packed.select(*by, *[F.element_at(c, i + 1).alias(f"{c}_{n}") for c in columns for i, n in enumerate(points)])


def share_missing_class(event_draw: DataFrame, cube: DataFrame) -> DataFrame:
    """Share of draws in which some class is absent from every drawn event, per system."""
    seen = cube.filter("tp + fn > 0").select("system", "event", "cls").distinct()
    k = cube.groupBy("system").agg(F.countDistinct("cls").alias("k"))
    per = event_draw.join(seen, "event").groupBy("system", "b").agg(F.countDistinct("cls").alias("n"))
    return per.join(k, "system").groupBy("system").agg(
        F.avg((F.col("n") < F.col("k")).cast("double")).alias("share_missing"), F.count(F.lit(1)).alias("n_draws"))


def jackknife(features: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Scores with each event left out: totals minus the event's own cells."""
    by = [*keys, "left_out"]
    own = features.withColumnRenamed("event", "left_out")
    total = C.class_sums(features, keys)
    mine = C.class_sums(own, by)
    names = ["n_events", *C.SUMS]
    rest = mine.alias("o").join(total.alias("t"), [*keys, "cls"]).select(
        *by, "cls", *[(F.col(f"t.{c}") - F.col(f"o.{c}")).alias(c) for c in names])
    exact = rest.select(*by, "cls", *[F.when(F.abs(c) < 1e-9, 0.0).otherwise(F.col(c)).alias(c) for c in names])
    return C.scores(exact, by)


def jackknife_summary(values: DataFrame, full: DataFrame, column: str = "A_P") -> DataFrame:
    """Range of the leave-one-event-out values and the most influential event, per system."""
    j = values.join(full.select("system", F.col(column).alias("whole")), "system")
    influence = F.struct(F.round(F.abs(F.col(column) - F.col("whole")), 12).alias("d"), "left_out")
    return j.groupBy("system").agg(
        F.min(column).alias("jack_min"), F.max(column).alias("jack_max"), F.max(F.abs(F.col(column) - F.col("whole"))).alias("max_deviation"),
        F.max_by("left_out", influence).alias("most_influential_event"), F.max_by(column, influence).alias("value_without_it"))


def event_boot(contrib: DataFrame, event_draw: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Percentile interval of an event mean under resampled events."""
    d = contrib.join(event_draw, "event").groupBy(*by, "b").agg((F.sum(F.col(column) * F.col("m")) / F.sum("m")).alias("v"))
    return percentiles(d, by, ["v"])


def hierarchical_boot(spark: SparkSession, table: DataFrame, draws: int, by: Sequence[str], column: str) -> DataFrame:
    """Events drawn, then seeds drawn anew inside every drawn event; draws of the table mean.

    A drawn slot keeps its number, because two slots of the same event draw their seeds separately.
    """
    e = numbered(table, by, "event")
    s = numbered(table, by, "seed")
    groups = e.filter("pos = 0").agg(F.collect_list(F.struct(*by, "size")).alias("u"))  # one entry per group
    slots = spark.range(draws).select(F.col("id").alias("b")).withColumn("u", groups.scalar()).select("b", F.explode("u").alias("u")).select(
        "b", "u.*", F.explode(F.expr("sequence(0L, u.size - 1)")).alias("slot"))
    picked = slots.select(*by, "b", "slot", (hash32("hev", F.col("b"), F.col("slot")) % F.col("size")).alias("pos")).join(
        e.select(*by, "event", "pos"), [*by, "pos"]).drop("pos")
    inner = picked.join(s.select(*by, "size", F.col("pos").alias("j")), list(by)).select(
        *by, "b", "slot", "event", (hash32("hsd", F.col("b"), F.col("slot"), F.col("j")) % F.col("size")).alias("pos"))
    taken = inner.join(s.select(*by, "seed", "pos"), [*by, "pos"]).groupBy(*by, "b", "event", "seed").agg(F.count(F.lit(1)).alias("m"))
    return taken.join(table, [*by, "event", "seed"]).groupBy(*by, "b").agg((F.sum(F.col(column) * F.col("m")) / F.sum("m")).alias("v"))
