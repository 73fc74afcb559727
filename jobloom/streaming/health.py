"""Source health over a stream of run-log rows."""

from pyspark.sql import DataFrame, functions as F


def source_health_stream(runs: DataFrame, late: str = "1 hour", window: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Runs, fetched rows and errors per source and sliding window."""
    failed = F.length(F.coalesce("errors", F.lit(""))) > 0
    return (
        runs.withWatermark("started_at", late)
        .groupBy(F.window("started_at", window, slide).alias("w"), "source")
        .agg(
            F.count(F.lit(1)).alias("runs"), F.sum("jobs_fetched").alias("fetched"), F.count_if(failed).alias("failed_runs"),
            F.max("started_at").alias("last_run"),
        )
        .select(F.col("w.start").alias("window_start"), "source", "runs", "fetched", "failed_runs", "last_run")
    )
