"""Deliveries of reads as streams: rows that come twice or late, figures by time, and any batch operator on what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_only(rows: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """Rows without those whose keys came before, as far back as ``delay`` by the column ``time``; state older than that is forgotten."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_time(rows: DataFrame, time: str, by: str, size: str = "1 hour", delay: str = "7 days") -> DataFrame:
    """Rows (window_start, by, n_reads, n_bases) per stretch of time; rows later than ``delay`` are left out, as a stream must let go of its state."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counted = timed.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n_reads", "n_bases")


def apply_to_new(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A batch operator (matching against fixed references, quality filters) on each batch of new rows, written below ``out`` by batch number.

    A batch that is run again replaces its own folder, so results hold each row once. All that is there is taken, then the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
