"""Session settings and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.shared_files import delete

#: Rows and bytes of text of a stored table that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 64 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "ledgerlens", cores: str = "*", partitions: int = 8, **extra):
    """A session for tests and benches; a cluster brings its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _shipped(application: str, spark: SparkSession) -> None:
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ledgerlens-code-")
    archive = shutil.make_archive(f"{folder}/ledgerlens", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once for each application."""
    _shipped(spark.sparkContext.applicationId, spark)


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode a new one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/ledgerlens/{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: object):
    """A session setting for the time of a ``with`` block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application has stored on the way; its results must have been written.

    DataFrames that read such a copy are of no use afterwards.  Other applications' copies stay.
    """
    delete(spark, _scratch_root(spark))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy survives lost executors, is computed in one pass and stays columnar,
    so later steps prune the columns they do not use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(stored: DataFrame) -> bool:
    """Whether a stored table has few enough rows and bytes to be broadcast; measured."""
    cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in stored.columns]
    size = stored.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(
        F.sum(sum(cells, F.lit(0))), F.lit(0)).alias("bytes")).first()
    return size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES


def broadcast_if_small(stored: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if it is small; else as it is."""
    return F.broadcast(stored) if is_small(stored) else stored
