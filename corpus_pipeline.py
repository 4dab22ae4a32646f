"""Documents to packed training sequences: toxicity filter, exact and near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents; the last returns the packed pieces. Rows are never lost to repeated ids: decisions are joined by the id
*and* a hash of the text. Empty and null texts pass every filter once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapcube.llm import exact, packing, repeats, shingles, toxicity
from gapcube.llm.common import table, text_or_empty
from gapcube.session import settled, ship, written

#: Documents with a score of at least this are rejected.
REJECT = toxicity.THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from labelled documents outside the held-out quarter."""
    model = toxicity.train(toxicity.labelled_rows(spark, sf_dir, docs))
    return docs.withColumn("_score", toxicity.score(model)).filter(F.col("_score") < REJECT).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z) the row with the largest id."""
    verdict = exact.exact_dedup(docs).filter("kept").select("id", F.col("text_check").alias("_check")).distinct()
    return keep(docs.withColumn("_check", F.xxhash64(exact.normalised("text"))), verdict, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id: SimHash links, checked on five-word shingles (similarity
    0.8 or more), and the pairs that fingerprints miss."""
    verdict = settled(lambda: shingles.near_copies(docs).filter("first").select("id", F.col("text_check").alias("_check")).distinct(), "near-copies")
    return keep(docs.withColumn("_check", F.xxhash64(text_or_empty())), verdict, docs.columns)


def keep(docs: DataFrame, verdict: DataFrame, columns: list[str]) -> DataFrame:
    """Rows named by (id, _check); of repeated rows one. Spark limits each window before the exchange, so a row that is
    repeated very often costs one row per task."""
    one = Window.partitionBy("_id", "_check").orderBy(F.monotonically_increasing_id())
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    rows = rows.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1")
    named = verdict.select(F.coalesce("id", F.lit(-(1 << 63))).alias("_id"), "_check")
    return rows.join(named, ["_id", "_check"], "left_semi").select(*columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that also start elsewhere; rows stay, `n_chars` follows the text."""
    out = repeats.without_repeats(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: No stage but the second can be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is stored and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
