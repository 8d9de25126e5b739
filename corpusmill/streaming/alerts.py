"""Event streams: late rows are taken up to ten minutes after the latest time met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def error_rates(stream: DataFrame, most: float = 0.05, least: int = 10) -> DataFrame:
    """Sliding windows of 15 minutes, one a minute apart, in which more than `most` of at least `least` events are errors."""
    seen = stream.withWatermark("ts", LATE).groupBy(F.window("ts", "15 minutes", "1 minute").alias("w"))
    n = seen.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return n.filter((F.col("n") >= least) & (F.col("errors") > most * F.col("n"))).select(F.col("w.end").alias("at"), "n", "errors")


def first_of_each(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Repeated keys within the watermark are dropped."""
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def counts_by_day(stream: DataFrame) -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """What is there now, into Parquet at path; a later call goes on where this one ended."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
