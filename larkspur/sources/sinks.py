"""Sinks: range-overwriting writer, sorted JSON reports, manifests."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dates_between(start: dt.date, end: dt.date) -> list[dt.date]:
    return [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]


def drop_dates(spark: SparkSession, path: str, dates: Iterable[dt.date]) -> None:
    """Delete the partitions of these dates."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for day in dates:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/date={day}")
        folder.getFileSystem(conf).delete(folder, True)


def write_range(rows: DataFrame, path: str, start: str, end: str, dry_run: bool = False) -> dict[str, int]:
    """Replace all partitions by date of a range: those are deleted first, so that a date that has vanished from the source vanishes here too."""
    spark = rows.sparkSession
    held = rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    counts = {str(r["date"]): r["count"] for r in held.groupBy("date").count().collect()}  # a row for each date of the range
    if dry_run:
        return counts
    drop_dates(spark, path, dates_between(dt.date.fromisoformat(start), dt.date.fromisoformat(end)))
    held.repartition("date").sortWithinPartitions("query", "page").write.mode("append").partitionBy("date").parquet(path)
    return counts


def dumps(report: Any) -> str:
    """Sorted keys, no escapes, a line feed at the end: equal reports are equal bytes."""
    return json.dumps(report, sort_keys=True, ensure_ascii=False, indent=2, default=str) + "\n"


def write_jsonl(rows: DataFrame, path: str) -> int:
    rows.write.mode("overwrite").json(path)
    return rows.count()


def manifest(rows: DataFrame, start: str, end: str, truncated: bool = False, epoch_changed: bool = False, trimmed: int = 4) -> DataFrame:
    """One row about a pull. It is usable if nothing was cut off, every page has a locale and no epoch changed."""
    locales = rows.groupBy(F.coalesce("locale", F.lit("")).alias("locale")).agg(F.count(F.lit(1)).alias("n"), F.sum("impressions").alias("imp"), F.sum(F.when(F.col("is_anonymized"), F.col("impressions")).otherwise(0)).alias("anon"))
    out = locales.agg(F.sum("n").alias("row_count"), F.round(F.coalesce(F.try_divide(F.sum("anon").cast("double"), F.sum("imp").cast("double")), F.lit(0.0)), 4).alias("anonymized_share"), F.sum(F.when(F.col("locale") == "", F.col("n")).otherwise(0)).alias("unmapped"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("locale", "n")))).alias("locales_seen"))
    return out.select(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(trimmed).alias("trimmed_days"), "row_count", "anonymized_share", "unmapped", "locales_seen", (F.lit(not truncated and not epoch_changed) & (F.col("unmapped") == 0)).alias("usable"))


def raised_epochs(now: DataFrame, before: DataFrame) -> DataFrame:
    """Dates whose history was rewritten since the last pull; a date not seen before hasn't changed."""
    old = before.select("data_date", F.col("epoch_version").alias("_before"))
    return now.join(old, "data_date", "left").filter(F.col("epoch_version") > F.coalesce("_before", "epoch_version")).select("data_date", "_before", "epoch_version")
