"""Streaming forms: windowed counts with late data, and resumable classification in batches (STR-01, STR-02)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import combine
from cohortloom.sources import readers, writers


def windowed_counts(events: DataFrame, time: str, entity: str, window: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """entity, begin, end and n of each sliding window; rows later than `late` are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window, slide), entity)
    return grouped.agg(F.count("*").alias("n")).select(entity, F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "n")


def classify_remaining(rows: DataFrame, log: str, keys: list[str], classify: Callable[[DataFrame], DataFrame]) -> None:
    """STR-01: classify the rows that the log lacks and append the results."""
    spark = rows.sparkSession
    todo = combine.remaining(rows, spark.read.parquet(log), keys) if readers.exists(spark, log) else rows
    writers.append_log(classify(todo), log)


def classify_stream(rows: DataFrame, log: str, checkpoint: str, keys: list[str], classify: Callable[[DataFrame], DataFrame]):
    """The same for a stream: each micro-batch is classified once, also after a restart."""

    def batch(df: DataFrame, _: int) -> None:
        classify_remaining(df.dropDuplicates(keys), log, keys, classify)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
