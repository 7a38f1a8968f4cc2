"""Streaming forms of ingest and of the session index (X1-X3), by Structured Streaming over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calendar
from tidemark.sources.shared import shared_path


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return shared_path(spark, "stream")


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet as a stream, whether it is one file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders; a table that is one file is found by its name there.
    one = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in spark.read.parquet(path).inputFiles())
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else reader.parquet(path)


def accumulate_once(posts: DataFrame, key: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark; state older than it goes."""
    return posts.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def run_once(spark: SparkSession, sf_dir: str, name: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All files that are there through ``step``, appended to a Parquet table that is returned."""
    out = shared_folder(spark)
    stream = step(file_stream(spark, sf_dir, name))
    stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def write_daily_sums(batch: DataFrame, number: int, out: str) -> None:
    """Sums of a batch's posts by the day and minute class that decide their session, not by session: the calendar may change yet.

    The batch number is part of the path, so a batch that runs again replaces its own rows."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    part = F.when(minute < calendar.OPEN_MINUTE, 0).when(minute < calendar.CLOSE_MINUTE, 1).otherwise(2)
    sums = batch.filter(F.col("score").isNotNull()).groupBy("instrument", F.to_date("ts").alias("day"), part.alias("part")).agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))
    sums.write.mode("overwrite").parquet(f"{out}/sums/batch={number}")


def attribute(sums: DataFrame, days: DataFrame) -> DataFrame:
    """Sums by day under today's calendar as means by date and session; a provisional day that the calendar replaced loses its posts here."""
    at = F.when(F.col("part") == 0, F.lit(8 * 60)).when(F.col("part") == 1, F.lit(12 * 60)).otherwise(F.lit(20 * 60))
    stamped = sums.groupBy("instrument", "day", "part").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    stamped = stamped.withColumn("ts", F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + at * 60).cast("timestamp_ntz"))
    placed = calendar.assign_session(stamped, days).filter("session_date IS NOT NULL")
    return placed.groupBy("instrument", F.col("session_date").alias("date"), "session").agg((F.sum("total") / F.sum("n")).alias("sentiment_index"), F.sum("n").alias("item_count"))


def daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of posts, summed batch by batch."""
    out = shared_folder(spark)
    v = F.col("value")
    posts = file_stream(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp_ntz").alias("ts"), ((v - 100) / (v + 100)).alias("score"))
    step = lambda batch, number: write_daily_sums(batch, number, out)
    posts.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/sums")


def session_index(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    """The stream's sums attributed by the calendar at reading time."""
    return attribute(daily_sums(spark, sf_dir), days)
