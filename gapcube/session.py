"""Session helpers: the shared scratch folder and a local test session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "gapcube") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; their Python may not see the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gapcube-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # only the folder made here
    with zipfile.ZipFile(os.path.join(folder, "gapcube.zip"), "w") as z:
        for at, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.join("gapcube", os.path.relpath(os.path.join(at, n), top)))
    spark.sparkContext.addPyFile(os.path.join(folder, "gapcube.zip"))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or a new local one where it is unset and the master is local."""
    ship(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not configured and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="gapcube-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # only the folder made here
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: Spark removes the shuffle files of a finished write under this setting, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back. Stored tables are packed more tightly than
    Spark's default, as they stay until the job ends; the write's shuffle files go at once. `options` go to the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for made in _made[-1:]:
        made.append(path)
    return out


#: Paths stored within each call of settled() that has not ended.
_made: list[list[str]] = []


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that written() stored."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others are left alone."""
    for t in tables:
        if hasattr(t, "stored_at"):
            removed(t.sparkSession, [t.stored_at])


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() returns, stored; those stored on the way are deleted, so nothing else may read them."""
    _made.append([])
    try:
        out = written(make(), name)
    finally:
        *old, last = _made.pop() or [None]
    removed(out.sparkSession, old)
    for made in _made[-1:]:
        made.append(last)
    return out
