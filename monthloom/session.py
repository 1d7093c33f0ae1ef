"""Session defaults and the two shared folders a job may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that hold from a laptop to a large cluster.  Partition
# counts are left to adaptive execution: it starts from an upper bound and
# coalesces to the advisory size, and splits partitions made large by one key.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def sized_for(input_bytes: int, cores: int, target: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Shuffle settings for an input size: partitions near ``target`` bytes.

    The count is an upper bound that adaptive execution coalesces, so that a
    reduce task fits in memory before any skew splitting sets in.
    """
    partitions = max(2 * cores, -(-input_bytes // target))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target),
    }


def build_session(app: str = "monthloom", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the defaults above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``.

    A folder of our own is set only for local masters, where driver and
    executors share a disk; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder there")
    own = tempfile.mkdtemp(prefix="monthloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder, for tables written between steps."""
    path = os.path.join(checkpoint_root(spark), "monthloom", f"{name}-{uuid.uuid4().hex}")
    _OWNED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_OWNED: dict[str, list[str]] = {}  # paths by application


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written in it, so results have to be used or saved inside.

    Without it the tables stay in the shared folder, as a lazy result may still read them.
    """
    before = len(_OWNED.setdefault(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        owned = _OWNED[spark.sparkContext.applicationId]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        for name in owned[before:]:
            path = hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del owned[before:]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder, for results that several jobs read.

    Unlike a cache it neither occupies executors nor is lost with them.  An
    enclosing ``scratch`` deletes it.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
