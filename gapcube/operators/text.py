"""Text normalisation, corpus preparation and duplicate statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.functions.columns import col, dbl
from gapcube.operators.filters import text_digest
from gapcube.operators.select import RANKED
from gapcube.operators.splits import time_levels
from gapcube.session import written

# Unicode white space and word characters, spelled so that every regex engine agrees; the id epoch in ms.
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}"
WORD = r"\p{L}\p{N}_"
EPOCH_MS = 1288834974657


def strip(c) -> Column:
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(c) -> Column:
    """Links and user names become placeholders."""
    x = F.regexp_replace(col(c), f"http[^{SPACE}]+", "[URL]")
    return strip(F.regexp_replace(x, f"@[{WORD}]+", "[USER]"))


def dedup_key(c) -> Column:
    """Lower-case ASCII words and hashtags without a leading retweet mark or placeholders."""
    x = F.lower(normalize_text(c))
    x = F.regexp_replace(x, rf"^rt[{SPACE}]+\[user\]:?[{SPACE}]*", "")
    x = F.regexp_replace(x, r"\[url\]|\[user\]", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9#]+", " "))


def is_retweet(c) -> Column:
    return col(c).rlike(f"^RT[{SPACE}]+@")


def id_to_time(c) -> Column:
    """Posting time held in the upper bits of an item id."""
    return F.timestamp_millis(F.shiftright(col(c).cast("bigint"), 22) + F.lit(EPOCH_MS))


def mask_tokens(c) -> Column:
    """Hashtags and digit runs become placeholders."""
    x = F.regexp_replace(col(c), f"#[{WORD}]+", "[HASHTAG]")
    return F.regexp_replace(x, rf"(?<![{WORD}\[])\p{{Nd}}[\p{{Nd}},.:]*", "[NUM]")


def mask_summary(corpus: DataFrame, text: str = "text") -> DataFrame:
    masked = mask_tokens(text)
    return corpus.agg(F.count(F.lit(1)).alias("n"), F.avg((masked != F.col(text)).cast("double")).alias("share_changed"),
                      F.sum(F.length(masked)).alias("masked_chars"))


def first_per_id(raw: DataFrame, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per item id, the first in source order: a grouped minimum, combined before the shuffle."""
    return raw.groupBy("item_id").agg(F.min(F.struct(*order, *carry)).alias("r")).select("item_id", *[F.col(f"r.{c}").alias(c) for c in carry])


def id_conflicts(raw: DataFrame) -> DataFrame:
    """Repeated ids and ids with more than one label."""
    per = raw.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("a"), F.max("label").alias("b"))
    return per.agg(F.sum(F.col("c") - 1).alias("duplicate_ids"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("conflicting_ids"))


def prepared(rows: DataFrame) -> DataFrame:
    """Derived columns of a canonical corpus."""
    return rows.select("item_id", "event", "label", *[c for c in ("hazard", "split", "protected") if c in rows.columns], normalize_text("text_raw").alias("text"), dedup_key("text_raw").alias("text_norm"),
                       is_retweet("text_raw").cast("bigint").alias("is_retweet"))


def build_canonical(raw: DataFrame, hazards: DataFrame | None = None, order: Sequence[str] = ("source_order",)) -> DataFrame:
    """Rows with a text and a label, then the first row of every id."""
    rows = raw.withColumn("label", strip("label")).filter("length(text_raw) > 0 AND length(label) > 0")
    carry = [c for c in ("event", "split", "label", "text_raw", "hazard") if c in rows.columns]
    one = first_per_id(rows, order, carry)
    return prepared(one if hazards is None else one.join(hazards, "event", "left"))


def build_canonical_mapped(raw: DataFrame, label_map: dict[str, str], order: Sequence[str] = ("source_order",)) -> DataFrame:
    """Mapped labels only, then the first row of every id, and only then rows with a text."""
    names = F.create_map(*[F.lit(v) for kv in label_map.items() for v in kv])
    rows = raw.withColumn("label", F.element_at(names, strip("label"))).filter("label IS NOT NULL")
    carry = [c for c in ("event", "label", "text_raw", "hazard") if c in rows.columns]
    return prepared(first_per_id(rows, order, carry)).filter("length(text) > 0")


def dropped_labels(raw: DataFrame, label_map: dict[str, str]) -> DataFrame:
    return raw.select(strip("label").alias("label")).filter(~F.col("label").isin(list(label_map))).groupBy("label").agg(F.count(F.lit(1)).alias("dropped"))


def combine_corpora(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two corpora with a flag for the protected one."""
    return a.withColumn("protected", F.lit(0).cast("bigint")).unionByName(b.withColumn("protected", F.lit(1).cast("bigint")))


def repeated_ids(corpus: DataFrame) -> DataFrame:
    """Ids that occur more than once; empty for a consistent corpus."""
    return corpus.groupBy("item_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")


def duplicate_rows(corpus: DataFrame) -> DataFrame:
    """Rows repeating an earlier text of the same event, per event."""
    per = corpus.groupBy("event", text_digest().alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("event").agg(F.sum(F.col("c") - 1).alias("within_event_duplicate_rows"))


def time_histogram_median(corpus: DataFrame, t: str = "posted_at") -> DataFrame:
    """Exact median time of every event: both middle positions are narrowed from days to microseconds by counts, so no
    window holds more buckets of an event than its days or the parts of one coarser bucket."""
    rows = corpus.select("event", F.unix_micros(F.col(t).cast("timestamp")).alias("us")).filter("us IS NOT NULL")
    names = [f"l{i}" for i in range(len(time_levels("us")))]
    rows = rows.select("event", *[c.alias(n) for c, n in zip(time_levels("us"), names)])
    found, fixed = None, []  # (event, the bucket of every level so far, position in it, its rows)
    while names[-1] not in fixed:
        # a bucket of few rows is counted by microseconds at once
        name = names[-1] if found is not None and found.agg(F.max("c")).first()[0] <= RANKED else names[len(fixed)]
        some = rows if found is None else rows.join(found.select("event", *fixed).distinct(), ["event", *fixed], "left_semi")
        counts = some.groupBy("event", *fixed, name).agg(F.count(F.lit(1)).alias("c"))
        group = Window.partitionBy("event", *fixed)
        counts = counts.select("*", F.sum("c").over(group.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(group).alias("n"))
        if found is None:
            narrowed = counts.select("*", F.explode(F.array(F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2"))).alias("position"))
        else:
            narrowed = counts.join(found.select("event", *fixed, "position"), ["event", *fixed])
        narrowed = narrowed.filter("upto - c < position AND position <= upto")
        found = written(narrowed.select("event", *fixed, name, (F.col("position") - F.col("upto") + F.col("c")).alias("position"), "c"), "middle")
        fixed.append(name)
        if found.isEmpty():
            break
    if names[-1] not in fixed:
        found = found.withColumn(names[-1], F.lit(None).cast("bigint"))
    # where the positions are equal both rows stand for one time
    return found.groupBy("event").agg(F.timestamp_micros(F.floor((F.min(names[-1]) + F.max(names[-1])) / 2)).alias("median_post"))


def event_profile(corpus: DataFrame) -> DataFrame:
    """Per event: size, first, median and last post, span in days, retweet share, classes and repeated texts."""
    us = F.unix_micros(F.col("posted_at").cast("timestamp"))
    a = corpus.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.min("posted_at").alias("first_post"), F.max("posted_at").alias("last_post"),
        F.round((F.max(us) - F.min(us)) / 86400e6, 2).alias("span_days"), F.round(F.avg(dbl("is_retweet")), 4).alias("retweet_share"))
    classes = corpus.groupBy("event", "label").agg(F.lit(1).alias("one")).groupBy("event").agg(F.count(F.lit(1)).alias("n_classes"))
    return a.join(time_histogram_median(corpus), "event").join(classes, "event").join(duplicate_rows(corpus), "event")


def split_counts(corpus: DataFrame) -> DataFrame:
    """Messages per event and official split."""
    return corpus.groupBy("event", "split").agg(F.count(F.lit(1)).alias("n"))


def leakage_counts(corpus: DataFrame) -> DataFrame:
    """Texts in more than one event, and test rows whose text occurs in the same event's other splits."""
    per = corpus.groupBy("event", text_digest().alias("k")).agg(
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"), F.count(F.when(F.col("split") != "test", 1)).alias("n_other"))
    leak = per.agg(F.coalesce(F.sum(F.when(F.col("n_other") > 0, F.col("n_test"))), F.lit(0)).alias("leaked_test_rows"))
    cross = per.groupBy("k").agg(F.count(F.lit(1)).alias("e")).agg(F.count(F.when(F.col("e") > 1, 1)).alias("cross_event_texts"))
    return leak.select("leaked_test_rows", F.lit(1).alias("j")).join(cross.select("cross_event_texts", F.lit(1).alias("j")), "j").drop("j")


def shared_with(corpus: DataFrame, other: DataFrame) -> DataFrame:
    """Rows per event whose text also occurs in another source: row counts per text first, then the join."""
    mine = corpus.groupBy("event", text_digest().alias("k")).agg(F.count(F.lit(1)).alias("c"))
    theirs = other.select(text_digest().alias("k")).distinct().withColumn("hit", F.lit(1))
    return mine.join(theirs, "k", "left").groupBy("event").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("c"))), F.lit(0)).alias("shared_rows"))


def corpus_facts(corpus: DataFrame) -> DataFrame:
    """Descriptive facts of a corpus with holdout flag in_R, all from event-class cells."""
    cells = corpus.groupBy("event", "label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("in_R"), 1)).alias("r"))
    k = cells.agg(F.countDistinct("label").alias("k"))
    per = cells.groupBy("event").agg(F.count(F.lit(1)).alias("present"), F.sum("r").alias("r")).withColumn("k", k.scalar())
    a = per.agg(F.max("k").alias("n_classes"), F.count(F.lit(1)).alias("n_events"), F.min("present").alias("classes_per_event_min"), F.max("present").alias("classes_per_event_max"),
                F.count(F.when(F.col("present") < F.col("k"), 1)).alias("events_lacking_a_class"), F.avg(dbl("k") - dbl("present")).alias("mean_absent_classes"), F.floor(F.median("r")).alias("R_size_median"))
    b = cells.filter("r > 0").agg(F.count(F.lit(1)).alias("R_cells_present"), F.avg((F.col("r") < 5).cast("double")).alias("R_cells_lt5_share"))
    c = cells.filter("r > 0").groupBy("label").agg(F.sum("r").alias("r")).agg(F.min("r").alias("pooled_R_min_class"))
    d = duplicate_rows(corpus).agg(F.sum("within_event_duplicate_rows").alias("within_event_duplicate_rows"))
    one = F.lit(1).alias("j")
    out = a.select("*", one)
    for part in (b, c, d):
        out = out.join(part.select("*", one), "j")
    return out.drop("j")
