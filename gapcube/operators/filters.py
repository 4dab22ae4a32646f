"""Cell, duplicate and subset filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import dbl
from gapcube.operators import cube as C
from gapcube.session import written

THRESHOLDS = (5, 10, 15, 20, 30)


def cell_sizes(rows: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    return rows.groupBy(*keys, "event", label).agg(F.count(F.lit(1)).alias("cell_n"))


def remove_small_cells(pred: DataFrame, min_cell: int, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Drop the rows of event-class cells (by true label) with fewer than min_cell rows.

    The list of small cells is tiny and each holds fewer than min_cell rows, so neither side of the join is skewed.
    """
    small = cell_sizes(pred, keys, "y_true").filter(F.col("cell_n") < min_cell).drop("cell_n")
    return pred.join(small, [*keys, "event", "y_true"], "left_anti")


def remove_small_pairs(pairs: DataFrame, min_cell: int, keys: Sequence[str] = C.RUN) -> DataFrame:
    """The same removal on reduced counts: the size of a cell is the sum of its pair counts."""
    cell = Window.partitionBy(*keys, "event", "y_true")
    return pairs.withColumn("_n", F.sum("n").over(cell)).filter(F.col("_n") >= min_cell).drop("_n")


def removal_report(pairs: DataFrame, min_cell: int, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Cells and messages a threshold removes, and the messages left."""
    cells = pairs.groupBy(*keys, "event", "y_true").agg(F.sum("n").alias("n"))
    small = F.col("n") < min_cell
    return cells.groupBy(*keys).agg(
        F.count(F.when(small, 1)).alias("removed_cells"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("removed_messages"),
        F.coalesce(F.sum(F.when(~small, F.col("n"))), F.lit(0)).alias("messages_left"))


def threshold_sweep(meta: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Cells and messages below each threshold; one pass for all thresholds."""
    cells = cell_sizes(meta)
    each = cells.select("event", "cell_n", F.explode(F.array(*map(F.lit, thresholds))).alias("t"))
    small = F.col("cell_n") < F.col("t")
    return each.groupBy("t").agg(
        F.count(F.when(small, 1)).alias("cells"), F.coalesce(F.sum(F.when(small, F.col("cell_n"))), F.lit(0)).alias("messages"),
        F.countDistinct(F.when(~small, F.col("event"))).alias("events_left"),
        F.count(F.lit(1)).alias("cells_total"), F.sum("cell_n").alias("messages_total"))


def cube_by_threshold(pairs: DataFrame, classes: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """One cube per threshold (key t): cells under it lose their messages, events with nothing left vanish."""
    cell = Window.partitionBy(*C.RUN, "event", "y_true")
    sized = pairs.withColumn("_n", F.sum("n").over(cell))
    each = sized.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("t")).filter("_n >= t").drop("_n")
    return C.cube_from_pairs(each, classes, ("t", *C.RUN))


def small_cells(cube: DataFrame, limit: int = 15) -> DataFrame:
    """Cells with support below the limit and their seed-mean F1."""
    cells = cell_table(cube)
    return cells.filter(F.col("support") < limit)


def cell_table(cube: DataFrame, keys: Sequence[str] = ("system",)) -> DataFrame:
    """Support and seed-mean F1 of every cell with support."""
    from gapcube.functions.columns import f1
    return cube.filter("tp + fn > 0").groupBy(*keys, "event", "cls").agg(
        F.max(F.col("tp") + F.col("fn")).alias("support"), F.avg(f1()).alias("f1"))


def zero_cells(cube: DataFrame, pairs: DataFrame, samples: DataFrame, meta_cells: DataFrame,
               min_support: int = 50, max_f1: float = 0.05) -> DataFrame:
    """Large cells scored near zero: top prediction and share, class count in the training sample and training events.

    `samples`: (system, seed, event, label, n) rows of the class in each held-out run's sample. `meta_cells`: (event, label, cell_n).
    """
    cells = cell_table(cube).filter((F.col("support") >= min_support) & (F.col("f1") < max_f1))
    votes = pairs.groupBy("system", "event", F.col("y_true").alias("cls"), "y_pred").agg(F.sum("n").alias("v"))
    top = votes.groupBy("system", "event", "cls").agg(
        F.max(F.struct("v", "y_pred")).alias("best"), F.sum("v").alias("total"))
    train = samples.groupBy("system", "event", F.col("label").alias("cls")).agg(F.avg("n").alias("train_sample_n_mean"))
    total = meta_cells.groupBy(F.col("label").alias("cls")).agg(F.sum("cell_n").alias("all_n"))
    own = meta_cells.select("event", F.col("label").alias("cls"), "cell_n")
    return (cells.join(top, ["system", "event", "cls"]).join(train, ["system", "event", "cls"], "left")
            .join(total, "cls").join(own, ["event", "cls"])
            .select("system", "event", "cls", "support", "f1", F.col("best.y_pred").alias("top_prediction"),
                    (dbl("best.v") / dbl("total")).alias("top_prediction_share"),
                    F.coalesce("train_sample_n_mean", F.lit(0.0)).alias("train_sample_n_mean"),
                    (F.col("all_n") - F.col("cell_n")).alias("train_events_n")))


def text_digest(c="text_norm"):
    """Texts are grouped by their SHA-256 so that shuffles carry 32 bytes instead of whole texts."""
    return F.unhex(F.sha2(F.col(c), 256))


def cross_event_duplicates(corpus: DataFrame) -> DataFrame:
    """Items whose normalised text occurs in more than one event.

    The grouped side has one row per text that really spans events; the rows of a hot text stay on the streamed side of
    the join, where adaptive skew handling may split them.
    """
    keyed = written(corpus.select("item_id", "event", text_digest().alias("k")), "keys")  # texts are normalised once
    shared = keyed.groupBy("k").agg(F.min("event").alias("a"), F.max("event").alias("b")).filter("a <> b").select("k")
    return keyed.join(shared, "k", "left_semi").select("item_id", "event")


def within_event_duplicates(corpus: DataFrame) -> DataFrame:
    """Items other than the one with the smallest id of each (event, normalised text).

    The kept ids are a grouped minimum (combined before the shuffle), and the anti join runs on (event, id), so a text
    with a third of all rows never forms one group in one task.
    """
    kept = corpus.groupBy("event", text_digest().alias("k")).agg(F.min("item_num").alias("item_num")).select("event", "item_num")
    return corpus.select("item_id", "item_num", "event").join(kept, ["event", "item_num"], "left_anti").select("item_id", "event")


def subset(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the listed events."""
    return df.join(events.select("event").distinct(), "event", "left_semi")


def restrict(runs: DataFrame, items: DataFrame) -> DataFrame:
    """A run's predictions on a holdout's items."""
    return runs.join(items.select("item_id"), "item_id", "left_semi")


def frequent_class_macro(cube: DataFrame, reference: str, arm_column: str = "arm", k: int = 5,
                         keys: Sequence[str] = ("model", "seed")) -> DataFrame:
    """Per-event macro-F1 of every arm over the classes with at least k rows in the reference arm."""
    from gapcube.functions.columns import f1
    listed = cube.filter((F.col(arm_column) == reference) & (F.col("tp") + F.col("fn") >= k)).select(*keys, "event", "cls")
    return cube.join(listed, [*keys, "event", "cls"], "left_semi").groupBy(*keys, arm_column, "event").agg(F.avg(f1()).alias("f1_frequent"))


def stray_predictions(cube: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Per (run, event): predictions of classes the event does not contain, and how many such classes."""
    absent = F.col("tp") + F.col("fn") == 0
    return cube.groupBy(*keys, "event").agg(
        F.coalesce(F.sum(F.when(absent, F.col("fp"))), F.lit(0)).alias("stray_rows"),
        F.count(F.when(absent & (F.col("fp") > 0), 1)).alias("stray_classes"), F.count(F.when(absent, 1)).alias("absent_classes"))


def stray_by_class(cube: DataFrame) -> DataFrame:
    """Mean stray predictions per seed and class; seeds without any count as zero."""
    absent = F.col("tp") + F.col("fn") == 0
    per_seed = cube.groupBy("system", "seed", "cls").agg(F.coalesce(F.sum(F.when(absent, F.col("fp"))), F.lit(0)).alias("n"))
    return per_seed.groupBy("system", "cls").agg(F.avg("n").alias("stray_per_seed"))
