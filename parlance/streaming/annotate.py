"""Incremental annotation: score new sentences as their files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parlance.schema import KEY, SENTENCES


def start_annotation(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    label: Column,
    schema: T.StructType = SENTENCES,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Label every sentence file below ``source`` once, and stop when all are done.

    Keys of earlier rows are left out by the state store, so a batch costs what it brings,
    whatever came before. Each batch owns one folder of the output and overwrites it: run
    again after a failure, it leaves the same keys. Rows with one key are one sentence.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(source).select(KEY, label.alias("label")).dropDuplicates([KEY])

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_annotations(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(f"{KEY} string, label string, batch_id long").parquet(output).drop("batch_id")
