import glob

import pyarrow.parquet as pq

from gapcube.session import written


def test_stored_tables_are_packed_tightly(spark):
    stored = written(spark.range(1000).selectExpr("id", "repeat('text ', 20) AS text"), "packed")
    path = stored.inputFiles()[0].replace("file://", "")
    assert pq.ParquetFile(glob.glob(path)[0]).metadata.row_group(0).column(1).compression == "ZSTD"
    assert stored.count() == 1000


def test_wide_rows_are_stored_one_by_one(spark):
    """Blocks are cells of many MB: row groups end by size after each row, not after a hundred rows."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from gapcube.operators.similarity import ONE_BY_ONE
    from gapcube.session import written
    from gapcube.sources.io import file_system
    cell = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 15)), lambda i: F.sha2(F.concat_ws("|", i, F.col("id")), 512)), "")).alias("cell")
    stored = written(spark.range(0, 40, 1, 1).select("id", cell), "wide", ONE_BY_ONE)
    groups, rows = 0, 0
    for path in stored.inputFiles():
        system, name = file_system(path)
        with system.open_input_file(name) as f:
            meta = pq.ParquetFile(f).metadata
            groups, rows = groups + meta.num_row_groups, rows + meta.num_rows
    assert rows == 40 and groups > 1
    assert stored.agg(F.count_distinct("cell")).head()[0] == 40
