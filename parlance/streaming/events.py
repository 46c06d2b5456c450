"""Windowed totals of an event stream in event time: duplicates, late rows and released state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

RESULT = "start timestamp, kind string, n long, total double"


@dataclass(frozen=True)
class EventTime:
    """Which columns say what, how late a row may come, and how wide a window is."""

    time: str = "ts"
    key: str = "event_id"
    kind: str = "event_type"
    value: str = "value"
    delay: str = "1 day"
    window: str = "1 day"


def start_totals(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    schema: T.StructType,
    columns: EventTime = EventTime(),
    files_per_trigger: int = 1,
) -> StreamingQuery:
    """Rows, and the sum of their values, per window and kind, once a window is over.

    A key counts once within the delay; rows later than the watermark are left out and
    counted by :func:`late_rows`. Keys and windows behind the watermark leave the state store,
    so it holds about one delay of the stream. Each batch owns one folder of the output and
    overwrites it, so a batch that runs again leaves the same rows. Stops when all files of
    the source are done.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(source).withWatermark(columns.time, columns.delay)
    once = rows.dropDuplicatesWithinWatermark([columns.key])
    totals = once.groupBy(F.window(columns.time, columns.window).alias("w"), F.col(columns.kind).alias("kind")).agg(
        F.count("*").alias("n"), F.sum(columns.value).alias("total")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        totals.select(F.col("w.start").alias("start"), "kind", "n", "total")
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_totals(spark: SparkSession, output: str) -> DataFrame:
    """The windows that are over, of all batches."""
    return spark.read.schema(f"{RESULT}, batch_id long").parquet(output).drop("batch_id")


def late_rows(query: StreamingQuery) -> int:
    """Rows of this run that came after the watermark, by the stream's own progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Keys and windows that the state store still holds."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
