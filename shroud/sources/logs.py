"""Audit sinks and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.operators import mask as MK

DEV_LOG_TTL_DAYS = 7   # fixed value: dev-log expiry


def write_request_log(rows: DataFrame, path: str) -> None:
    """A5: append audit rows, partitioned by day (no message text in the rows)."""
    rows.write.mode("append").partitionBy("log_date").parquet(path)


def write_dev_log(rows: DataFrame, exchanges: DataFrame, path: str, key: str = "request_id") -> None:
    """Audit row + anonymized prompt + raw response, keyed sortable by time.

    ``exchanges`` has key, text (as the user wrote it) and response (as the provider sent
    it, with tokens in place of values). Texts are masked here: none is stored as written.
    """
    said = MK.mask_texts(exchanges, "text", [key, "response"]).select(key, F.col("masked").alias("prompt"), "response")
    dev = rows.join(said, key, "left").withColumn(
        "log_key", F.concat(F.lit("devlog:"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(":"),
                            F.coalesce(F.col("api_key_id"), F.lit("unknown"))))
    dev.write.mode("append").partitionBy("log_date").parquet(path)


def live_dev_log(dev: DataFrame, as_of: Column) -> DataFrame:
    """A6 retention: entries younger than 7 days at ``as_of`` (partition-pruned on log_date)."""
    return dev.where((F.col("log_date") >= F.to_date(as_of - F.expr(f"INTERVAL {DEV_LOG_TTL_DAYS} DAYS")))
                     & (F.col("ts") >= as_of - F.expr(f"INTERVAL {DEV_LOG_TTL_DAYS} DAYS")))


def latest_logs(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest N = min(limit or 100, 500), total order so ties are stable."""
    n = min(limit if limit is not None else 100, 500)
    return logs.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(n)


def write_report(section: DataFrame, path: str, run_date: str) -> None:
    """One dataset per report section, partitioned by run date."""
    section.withColumn("run_date", F.lit(run_date)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def latest_report(reports: DataFrame) -> DataFrame:
    """A10: the newest dated report (scalar subquery on run_date, partition-pruned)."""
    newest = reports.agg(F.max("run_date").alias("_m"))
    return reports.join(newest, F.col("run_date") == F.col("_m")).drop("_m")
