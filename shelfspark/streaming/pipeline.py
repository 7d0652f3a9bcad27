"""Items as a stream: keep-first with bounded state, progress counts, durable partial results, cancellation between batches."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.scalar import first_filled


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """The first row to arrive of each key within the watermark; rows without key pass. State ends with the watermark."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    tagged = timed.withColumn("_key", F.coalesce(first_filled(F.col(key).cast("string")), F.concat(F.lit("\u0000row "), F.expr("uuid()"))))
    return tagged.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_time")


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows by event-time window; late rows within the delay still count."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    return timed.groupBy(F.window("_time", window).alias("w"), by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("window_start"), by, "rows")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", stop: Callable[[], bool] | None = None) -> int:
    """Runs what has arrived into parquet and returns the batches. Each batch is durable; ``stop`` ends the run between batches."""
    done = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal done
        if stop and stop():
            raise InterruptedError("cancelled")
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)
        done += 1

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as problem:
        if "cancelled" not in str(problem):
            raise
    return done


def landing(folder: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    return folder
