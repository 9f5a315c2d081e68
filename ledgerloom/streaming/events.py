"""Event streams: daily activity and account totals, the same code for batch and Structured Streaming. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily(events: DataFrame, late: str = "1 day", exact: bool = False) -> DataFrame:
    """Count, sum and users of each type by day. Streams keep a day open for `late`; distinct users are approximate there."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    users = F.count_distinct("user_id") if exact and not events.isStreaming else F.approx_count_distinct("user_id")
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), users.alias("users"))


def balances(events: DataFrame) -> DataFrame:
    """Credits and debits by account."""
    credit = F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(0.0)
    return events.groupBy("user_id").agg(F.sum(credit).alias("credits"), F.sum(F.col("value") - credit).alias("debits"))
