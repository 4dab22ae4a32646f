"""Exact duplicates by a tree-merge of digest runs (DataFrame functions only).

Every partition of the input makes one run of digests. In each binomial round `fan_in` neighbouring runs meet and
equal digests merge into one entry that keeps the size and the winning row; the exchange is keyed by run group *and*
digest, so no round puts a run into one task and the last round is spread over all digests. A group of copies with a
third of all rows is one entry per run before the first exchange. The verdict travels down the same way: root to
(run, digest), then to rows by (run, digest), so that copies are never joined by one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import ascii_lower, text_or_empty
from gapcube.session import written

#: Runs that meet in one round.
FAN_IN = 8
KEY = ["text_sha256", "_len", "_check"]  # the digest, and two more facts that verify equality


def normalised(text: str | Column) -> Column:
    return ascii_lower(text_or_empty(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, largest: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, text_check.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest (or smallest) id stays; a null id loses against any other, and of repeated rows with the same id exactly
    one is kept. `text_check` is xxhash64 of the normalised text. Empty input gives empty output; other columns are ignored.
    """
    text = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("_t"), F.monotonically_increasing_id().alias("_row")).select(
        "id", "_row", F.spark_partition_id().alias("_run"), F.sha2("_t", 256).alias("text_sha256"),
        F.octet_length("_t").alias("_len"), F.xxhash64("_t").alias("_check"))
    rows = written(rows, "digests")
    best = F.max("_best") if largest else F.min("_best")
    claim = F.struct("id", "_row") if largest else F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("_row").alias("_row"))
    runs = rows.withColumn("_best", claim).groupBy(*KEY, "_run").agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    last = rows.agg(F.max("_run")).first()[0] or 0
    level, width = runs, 1
    while True:
        width *= fan_in
        level = level.groupBy(*KEY, F.floor(F.col("_run") / width).alias("_group")).agg(best.alias("_best"), F.sum("_n").alias("_n")) \
            .withColumn("_run", F.col("_group") * width).drop("_group")
        if width > last:
            break
    verdict = runs.select(*KEY, "_run").join(level.select(*KEY, "_best", "_n"), KEY)
    return rows.join(verdict, [*KEY, "_run"]).select(
        F.col("id"), F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256", F.col("_check").alias("text_check"))


def op6_exact_dedup(spark, sf_dir):
    from gapcube.llm.common import table
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
