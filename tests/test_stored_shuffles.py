"""Storing a table leaves none of its shuffle files behind."""
import time
from pathlib import Path

from pyspark.sql import functions as F

from gapcube.session import CLEANUP, written


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).glob("*/shuffle_*")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    old, before = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    wide = spark.range(100_000).groupBy((F.col("id") % 1009).alias("k")).count()
    stored = written(wide, "counts")
    for _ in range(100):  # they are removed in the background
        if not shuffle_files(spark) - old:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - old
    assert spark.conf.get(CLEANUP, None) == before
    assert stored.count() == wide.count() == 1009 and written(wide, "again").agg(F.sum("count")).first()[0] == 100_000
