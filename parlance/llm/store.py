"""Intermediate tables in the shared folder, and column picking that survives clashing names."""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import scratch_path

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once, whole documents among them; Spark's own default
#: of 10,000 is lowered to this for the session, any other setting of the user's stays.
BATCH_ROWS = "1000"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows without an id act as the last id: nothing counts as later, and they come back as null.
NO_ID = 2**63 - 1
#: Fewest groups that grouped work is dealt to, so that small tables still use every core.
LEAST_GROUPS = 64

_written: list[tuple[SparkSession, str]] = []


def place(names: list[str], name: str) -> int:
    """Where a column stands; an exact match wins over one in another case."""
    if name in names:
        return names.index(name)
    folded = [n.lower() for n in names]
    if name.lower() not in folded:
        raise ValueError(f"column {name} is missing: {names}")
    return folded.index(name.lower())


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: ``pick(df, id="doc_id")``.

    Works by position, so extra columns that differ only in case or repeat a name do no harm;
    an exact match wins over one in another case, and the first over later ones.
    """
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{place(names, old)}").alias(new) for new, old in columns.items()])


def bounded_batches(spark: SparkSession) -> None:
    """Send fewer rows to a Python worker at once, as a row can hold a whole text."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)


def with_id(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """Picked columns with ``id`` as a long; null becomes :data:`NO_ID`.

    Every operator on documents starts here, so this also bounds the batches of its workers.
    """
    bounded_batches(df.sparkSession)
    picked = pick(df, id=id_col, **columns)
    return picked.withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)))


def public_id(name: str) -> F.Column:
    """The id as the caller knows it."""
    return F.when(F.col("id") != NO_ID, F.col("id")).alias(name)


@contextlib.contextmanager
def transient_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a finished action are deleted at once."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def temporary_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder whose files go when the driver ends."""
    path = scratch_path(spark, name)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage for good.

    The files outlive any executor. They go when :func:`discard` is called or the driver ends.
    """
    spark = df.sparkSession
    path = temporary_path(spark, name)
    with transient_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later result reads."""
    for table in tables:
        _delete(table.sparkSession, table._scratch)


def _at_exit() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be over already
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


atexit.register(_at_exit)


def groups_for(amount: int | None, each: int) -> int:
    """How many groups of about ``each`` hold ``amount``."""
    return max(LEAST_GROUPS, -(-int(amount or 0) // each))
