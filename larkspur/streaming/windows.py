"""Structured Streaming forms of the scheduled jobs: late rows, hourly archive, sliding limits, rewritten history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.sinks import dates_between, drop_dates


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame, late: str = "4 days") -> DataFrame:
    """Events by hour and type. With a watermark, hours are final when they are older than it; on a batch it changes nothing."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    held = events.withWatermark("ts", length) if events.isStreaming else events
    return held.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    held = events.withWatermark("ts", gap) if events.isStreaming else events
    return held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hour_gaps(hours: DataFrame) -> DataFrame:
    """Hours between the first and the last that have no row."""
    span = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return every.join(hours.select("hour").distinct(), "hour", "left_anti")


def replacing_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write pulls over what is there by ``date``. Every row has its pull's range (``pull_start``, ``pull_end``) and ``version``.

    Each date of a pull's range is replaced, one that has no rows any more too.
    Where pulls of one micro-batch overlap, a date is of the highest version. A
    micro-batch that is run again after a failure gives the same files' rows.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest: dict[dt.date, int] = {}
        for pull in batch.select("pull_start", "pull_end", "version").distinct().collect():  # a row for each pull
            for day in dates_between(pull["pull_start"], pull["pull_end"]):
                newest[day] = max(pull["version"], newest.get(day, pull["version"]))
        if not newest:
            return
        drop_dates(spark, path, newest)
        wanted = F.broadcast(spark.createDataFrame(list(newest.items()), "date date, version long"))
        held = batch.withColumn("version", F.col("version").cast("long")).join(wanted, ["date", "version"], "left_semi")
        held.drop("pull_start", "pull_end").repartition("date").write.mode("append").partitionBy("date").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
