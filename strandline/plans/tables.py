"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session on one machine
    without it (a test) gets a temporary folder, which is then recorded."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, whatever store holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_roots: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the application's own part of that
    folder goes when the driver ends."""
    root = f"{shared_folder(spark)}/strandline-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(_drop_root, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _drop_root(root: str) -> None:
    spark = _roots.pop(root, None)
    try:
        if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete_path(spark, root)
    except Exception:  # the session is already gone; the store's own expiry cleans up
        pass


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go as soon as it ends.  For actions whose
    result is written: nothing reads their shuffles again."""
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES)
        else:
            spark.conf.set(_SHUFFLES, before)


def write_table(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Writes and reads back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with brief_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the tables that a plan reads, for those that nothing reads again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out anew where it has fewer partitions than there are cores: a
    small file may be one row group, which only one task can read.  Larger scans
    stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
