"""Consistency checks of predictions against the metadata, and small label utilities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import f1
from gapcube.operators import cube as C
from gapcube.session import written


#: Rows of a task that checks items, on average, while a shuffle into that many tasks needs no sort, and beyond that. Sorting,
#: counting and ranking takes about 900 bytes a row; a shuffle into more than `UNSORTED` tasks holds the rows of its writers, too.
TASK_ROWS, MOST_ROWS, UNSORTED = 1 << 17, 1 << 21, 200


class ValidationError(ValueError):
    pass


def tasks_for(rows: int, least: int) -> int:
    """Tasks to deal rows over, at least `least`."""
    return max(least, min(-(-rows // TASK_ROWS), UNSORTED), -(-rows // MOST_ROWS))


def checked_events(pred: DataFrame, meta: DataFrame, classes: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """One row per run and predicted event with every count the checks need: rows, items (each item counts in one event of
    its run), unknown, wrong_event, wrong_label, stray, known.

    Rows are exchanged once, by item: that serves the join with the metadata, the counts of an item, and the mark of an
    item's first event; what follows is combined before it moves. An item's rows of one run meet in one task.
    """
    keys = list(keys)
    m = meta.select("item_id", F.col("event").alias("m_event"), F.col("label").alias("m_label"))
    known = F.col("m_event").isNotNull()
    spark = pred.sparkSession
    parts = tasks_for(pred.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pred.select(*keys, "item_id", "event", "y_true", "y_pred").repartition(parts, "item_id").join(m, "item_id", "left").withColumn("classes", classes.scalar())
    tests = {"rows": F.lit(True), "unknown": ~known, "wrong_event": known & (F.col("event") != F.col("m_event")), "wrong_label": known & (F.col("y_true") != F.col("m_label")),
             "stray": ~F.array_contains("classes", F.col("y_pred")), "known": known}
    per_item = rows.groupBy("item_id", *keys, "event").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in tests.items()])
    first = F.row_number().over(Window.partitionBy("item_id", *keys).orderBy("event")) == 1
    return per_item.withColumn("items", first.cast("bigint")).groupBy(*keys, "event").agg(*[F.sum(n).alias(n) for n in (*tests, "items")])


def dup_rows(pred: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Rows after the first of each item: counts per item are combined before they are summed."""
    per_item = pred.groupBy(*keys, "item_id").agg(F.count(F.lit(1)).alias("c"))
    return per_item.groupBy(*keys).agg(F.sum(F.col("c") - 1).alias("dup_rows"))


def row_checks(pred: DataFrame, meta: DataFrame, classes: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Unknown items, wrong events, wrong labels and stray classes per run."""
    return run_checks(checked_events(pred, meta, classes, keys), keys).drop("dup_rows")


def run_checks(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return checked.groupBy(*keys).agg(F.sum(F.col("rows") - F.col("items")).alias("dup_rows"), F.sum("unknown").alias("unknown_items"), F.sum("wrong_event").alias("wrong_event"),
                                      F.sum("wrong_label").alias("wrong_label"), F.sum("stray").alias("stray_classes"))


def event_coverage(pred: DataFrame, meta: DataFrame, keys: Sequence[str] = C.RUN) -> DataFrame:
    """Per (run, event of the corpus): known rows and expected rows."""
    known = pred.join(meta.select("item_id"), "item_id", "left_semi").groupBy(*keys, "event").agg(F.count(F.lit(1)).alias("known"))
    return coverage_of(known, pred.select(*keys).distinct(), meta, keys)


def coverage_of(known: DataFrame, runs: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    size = meta.groupBy("event").agg(F.count(F.lit(1)).alias("size"))
    names = size.agg(F.collect_list(F.struct("event", "size")).alias("e"))  # one entry per event
    every = runs.withColumn("e", names.scalar()).select(*keys, F.explode("e").alias("e")).select(*keys, "e.*")
    return every.join(known.select(*keys, "event", F.col("known").alias("got")), [*keys, "event"], "left").na.fill(0, ["got"])


def _quoted(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", "), F.lit("]"))


def validation_report(pred: DataFrame, meta: DataFrame, classes: DataFrame, partial: bool = False, keys: Sequence[str] = C.RUN) -> DataFrame:
    """One row per run with every count and the combined message (empty when the run is consistent)."""
    keys = list(keys)
    checked = written(checked_events(pred, meta, classes, keys), "checked")  # a row per run and event
    cover = coverage_of(checked, checked.select(*keys).distinct(), meta, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when((F.col("got") > 0) & (F.col("got") != F.col("size")), F.col("event")))).alias("incomplete"),
        F.array_sort(F.collect_list(F.when(F.col("got") == 0, F.col("event")))).alias("absent"))
    j = run_checks(checked, keys).join(cover, keys)
    said = [
        F.when(F.col("dup_rows") > 0, F.concat(F.col("dup_rows").cast("string"), F.lit(" duplicate item rows"))),
        F.when(F.col("unknown_items") > 0, F.concat(F.col("unknown_items").cast("string"), F.lit(" items not in the metadata"))),
        F.when(F.col("wrong_event") > 0, F.concat(F.col("wrong_event").cast("string"), F.lit(" rows whose event disagrees with the metadata"))),
        F.when(F.col("wrong_label") > 0, F.concat(F.col("wrong_label").cast("string"), F.lit(" rows whose y_true disagrees with the metadata"))),
        F.when(F.col("stray_classes") > 0, F.concat(F.col("stray_classes").cast("string"), F.lit(" predictions outside the class list"))),
        F.when(F.size("incomplete") > 0, F.concat(F.lit("incomplete events: "), _quoted(F.col("incomplete")))),
    ]
    if not partial:
        said.append(F.when(F.size("absent") > 0, F.concat(F.lit("events with no predictions: "), _quoted(F.col("absent")))))
    return j.select(*keys, "dup_rows", "unknown_items", "wrong_event", "wrong_label", "stray_classes", F.size("incomplete").cast("bigint").alias("n_incomplete"),
                    F.size("absent").cast("bigint").alias("n_absent"), F.concat_ws("; ", *said).alias("problems"))


def require_valid(pred: DataFrame, meta: DataFrame, classes: DataFrame, partial: bool = False, keys: Sequence[str] = C.RUN) -> None:
    """Raise with the combined message of the first inconsistent run."""
    bad = validation_report(pred, meta, classes, partial, keys).filter("problems <> ''").select("problems").head()
    if bad:
        raise ValidationError(bad[0])


def complete_seeds(run_events: DataFrame, events: DataFrame, unit: str = "system") -> DataFrame:
    """Per seed: whether it has a run for every event, and the first missing event otherwise."""
    names = events.select("event").distinct().agg(F.array_sort(F.collect_list("event")).alias("all_events"))
    have = run_events.select(unit, "seed", "event").distinct().groupBy(unit, "seed").agg(F.collect_list("event").alias("have"))
    missing = F.array_except("all_events", "have")
    return have.withColumn("all_events", names.scalar()).select(
        unit, "seed", (F.size(missing) == 0).alias("complete"), F.when(F.size(missing) > 0, F.array_min(missing)).alias("first_missing"))


def assert_aligned(a: DataFrame, b: DataFrame, items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: items held by only one of the two runs or outside the holdout, and truth labels that differ."""
    j = a.select(*by, "item_id", F.col("y_true").alias("ya")).join(b.select(*by, "item_id", F.col("y_true").alias("yb")), [*by, "item_id"], "full_outer")
    k = j.join(items.select("item_id", F.lit(1).alias("listed")), "item_id", "left")
    return k.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.count(F.when(F.col("ya").isNull() | F.col("yb").isNull(), 1)).alias("unpaired"),
        F.count(F.when(F.col("listed").isNull(), 1)).alias("outside"), F.count(F.when(F.col("ya") != F.col("yb"), 1)).alias("label_conflicts"))


def size_matched(runs: DataFrame, kind: str, against: str) -> DataFrame:
    """Pairs of runs of one event and seed whose training sizes must agree. `runs`: (kind, event, seed, n_train)."""
    a = runs.filter(F.col("kind") == kind).select("event", "seed", F.col("n_train").alias("n"))
    b = runs.filter(F.col("kind") == against).select("event", "seed", F.col("n_train").alias("n_other"))
    return a.join(b, ["event", "seed"]).select("event", "seed", "n", "n_other", (F.col("n") == F.col("n_other")).alias("matched"))


def cross_source_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two sources hold the same item ids with the same events."""
    j = a.select("item_id", F.col("event").alias("ea")).join(b.select("item_id", F.col("event").alias("eb")), "item_id", "full_outer")
    return j.agg(F.count("ea").alias("rows_a"), F.count("eb").alias("rows_b"),
                 F.coalesce(F.bool_and(F.col("ea").isNotNull() & F.col("eb").isNotNull()), F.lit(True)).alias("same_ids"),
                 F.coalesce(F.bool_and(F.col("ea").eqNullSafe(F.col("eb"))), F.lit(True)).alias("same_events"))


TEXT_COLUMNS = ("text", "text_norm")


def assert_no_text(df: DataFrame) -> DataFrame:
    found = [c for c in df.columns if c in TEXT_COLUMNS]
    if found:
        raise ValidationError(f"text columns {found}")
    return df


def remap_labels(df: DataFrame, mapping: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Merge classes before counting."""
    return reduce(lambda d, c: d.replace(mapping, subset=[c]), columns, df)


def row_level_macro(pred: DataFrame, classes: DataFrame, keys: Sequence[str] = ("system", "seed", "event"), names: str = "f1_{}") -> DataFrame:
    """A second scorer that counts rows per class of each level instead of reading the cube; used to check the first.
    Without `event` among the keys the scores are pooled."""
    keys = list(keys)
    true = pred.groupBy(*keys, F.col("y_true").alias("cls")).agg(F.count(F.lit(1)).alias("n_true"))
    said = pred.groupBy(*keys, F.col("y_pred").alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    hit = pred.filter("y_true = y_pred").groupBy(*keys, F.col("y_true").alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    on = [*keys, "cls"]
    grid = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("c", classes.scalar()).select(*keys, F.explode("c").alias("cls"))
    cells = grid.join(true, on, "left").join(said, on, "left").join(hit, on, "left").na.fill(0)
    cells = cells.select(*on, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"))
    f = f1()
    return cells.groupBy(*keys).agg(*[F.avg(f if cond is None else F.when(cond, f)).alias(names.format(c)) for c, cond in (
        ("P", F.col("tp") + F.col("fn") > 0), ("D", F.col("tp") + F.col("fn") + F.col("fp") > 0), ("O", None))])


def meta_fingerprint(meta: DataFrame) -> DataFrame:
    """Twelve hex digits that pin the metadata: an order-free XOR per event, then SHA-256 over the events."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", "item_id", "event", "hazard", "label")), 1, 15), 16, 10).cast("bigint")
    per = meta.groupBy("event").agg(F.bit_xor(row).alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("event", "x")))
    return per.agg(F.substring(F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p.event, F.lit(":"), p.x.cast("string"))), ","), 256), 1, 12).alias("meta"))


def signatures(scores: DataFrame, fingerprint: DataFrame, meta: DataFrame, min_cell: int = 0) -> DataFrame:
    """The string that states how each summary was computed."""
    n_all = meta.agg(F.countDistinct("event").alias("n"))
    each = scores.select("system", "seed", F.col("n_events").cast("bigint").alias("n"), F.explode(F.array(*map(F.lit, C.CONVENTIONS))).alias("labels")).select(
        "*", F.explode(F.array(F.lit("pooled"), F.lit("per-event"), F.lit("difference"))).alias("summary"))
    each = each.withColumn("meta", fingerprint.scalar()).withColumn("n_all", n_all.scalar())
    events = F.concat(F.col("n").cast("string"), F.when(F.col("n") < F.col("n_all"), "+partial").otherwise(""))
    return each.select("system", "seed", "labels", "summary", F.concat(
        F.lit("loeo-macro-f1|summary:"), "summary", F.lit("|labels:"), "labels", F.lit("|zero-div:0|events:"), events,
        F.lit(f"|min-cell:{min_cell}|meta:"), "meta", F.lit("|v:1.2.0")).alias("signature"))
