"""Stage tables, label sheets, lexicon files, norms, models and metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.lexicon import merge_lexicons, parse_lexicon
from parlance.schema import KEY, validate_schema
from parlance.session import tidied

PARTITIONS = ("date", "classe")
# Stored bytes that one slice of a join of stages moves, and slices at most.
_SLICE_BYTES, _MAX_SLICES = 64 << 20, 8
_MARK_CONF = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def require(spark: SparkSession, path: str) -> str:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return path


def write_stage(df: DataFrame, path: str, partition_by: Iterable[str] = (), slices: int = 1, key: str = KEY) -> None:
    """Write a stage table as Parquet, optionally in folders for partition pruning.

    In ``slices`` by the hash of ``key``, one after another, a join on the key moves a slice of
    both sides at a time, and what it moved is gone before the next one. The success marker
    comes with the last slice.
    """
    names = list(partition_by)
    with tidied(df.sparkSession):
        for i in range(slices):
            part = df if slices == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i)
            writer = part.write.mode("append" if i else "overwrite").option("compression", "zstd")
            writer = writer.option(_MARK_CONF, str(i == slices - 1).lower())
            (writer.partitionBy(*names) if names else writer).parquet(path)


def slices_of(spark: SparkSession, path: str) -> int:
    """Slices in which a join moves the table at ``path``; one if it is small or not there."""
    if not _exists(spark, path):
        return 1
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(1, min(_MAX_SLICES, fs.getContentSummary(target).getLength() // _SLICE_BYTES))


def read_stage(
    spark: SparkSession, path: str, required: Iterable[str] = (), schema: T.StructType | None = None
) -> DataFrame:
    """Read a stage table and check its columns.

    Pass the schema for partitioned tables, or folder names like ``1981`` become numbers.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    validate_schema(df, required, path)
    return df


def read_partitioned(spark: SparkSession, path: str, partition_by: Iterable[str]) -> DataFrame:
    """Read a partitioned stage with its folder names as strings, ``1981`` included."""
    names = set(partition_by)
    found = spark.read.parquet(path).schema
    fields = [
        T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in found
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def materialize(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    force: bool = False,
    partition_by: Iterable[str] = (),
    slices: int = 1,
) -> DataFrame:
    """Return the finished stage at ``path``, building it when missing or forced.

    Only the success marker proves that a stage is finished; a half-written folder is
    built again.
    """
    names = list(partition_by)
    if force or not _exists(spark, path.rstrip("/") + "/_SUCCESS"):
        with tidied(spark):
            write_stage(build(), path, names, slices)
    return read_partitioned(spark, path, names)


def read_labels(spark: SparkSession, path: str, columns: Iterable[str] = (KEY, "label")) -> DataFrame:
    """A label sheet, every column a string, with ``line`` for the order of the rows.

    A sheet is one file: row ids then grow along the file.
    """
    require(spark, path)
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    sheet = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .schema(schema).csv(path)
    )
    validate_schema(sheet, columns, path)
    return sheet.withColumn("line", F.monotonically_increasing_id())


def write_labels(sheet: DataFrame, path: str) -> None:
    """Write a label sheet with a header; blanks inside the cells are kept."""
    with tidied(sheet.sparkSession):
        (
            sheet.write.mode("overwrite").option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one lexicon file: lower-cased, trimmed, no comments, no repeats."""
    return parse_lexicon(spark.read.text(require(spark, path)))


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated concreteness norms as ``(word, conc_m, line)``."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(require(spark, path))
    return raw.select(
        F.col("Word").alias("word"),
        F.col("`Conc.M`").try_cast("double").alias("conc_m"),
        F.monotonically_increasing_id().alias("line"),
    )


def write_bucketed(
    df: DataFrame, name: str, path: str, key: str, buckets: int, partition_by: Sequence[str] = ()
) -> DataFrame:
    """A stage as a table bucketed and sorted by its key, in folders of ``partition_by``.

    Tables with the same number of buckets join on the key without an exchange, and a filter
    on a partition column reads its folders only. Rows are dealt to their buckets before the
    write, so a folder has one file per bucket.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(
    spark: SparkSession, name: str, path: str, schema: T.StructType, key: str, buckets: int, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Make a stage that another session wrote known to this one."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {by} "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Small result tables as JSON lines in one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def save_settings(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    """A small nested record as JSON, numbers in full precision."""
    line = spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(require(spark, path)).first().value)
