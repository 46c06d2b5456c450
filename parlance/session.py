"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders to delete when the driver ends: JVM path and Hadoop settings, kept beyond the session.
_scratch: list[tuple] = []


def _forget(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends, stopped session or not."""
    context = spark.sparkContext
    _scratch.append((context._jvm.org.apache.hadoop.fs.Path(path), context._jsc.hadoopConfiguration()))


def _delete_scratch() -> None:
    for path, conf in _scratch:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            path.getFileSystem(conf).delete(path, True)


atexit.register(_delete_scratch)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="parlance-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is there goes when the driver ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _forget(spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed scratch table, for steps that read them more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more, before the driver ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each of them ends, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def with_checkpoints(spark: SparkSession) -> None:
    """Have reliable checkpoints go to the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
        _forget(spark, context.getCheckpointDir())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
