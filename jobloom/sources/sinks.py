"""Snapshot, run log and notification writers."""

from pyspark.sql import DataFrame, functions as F


def run_log_rows(batch: DataFrame, upserted: DataFrame, errors: DataFrame, started_at, finished_at) -> DataFrame:
    """One row per source: fetched and stored counts, and the whole error."""
    fetched = batch.groupBy("source").agg(F.count(F.lit(1)).alias("jobs_fetched"))
    stored = upserted.groupBy("source").agg(F.count(F.lit(1)).alias("jobs_upserted"))
    said = errors.select("source", F.col("error").alias("errors"))
    j = fetched.join(stored, "source", "full_outer").join(said, "source", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("source", started_at.alias("started_at"), finished_at.alias("finished_at"), zero("jobs_fetched"), zero("jobs_upserted"), "errors")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_catalogue(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A new snapshot folder, active and inactive rows apart."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("is_active").parquet(path)


def read_catalogue(spark, path: str) -> DataFrame:
    """A snapshot; the folder name gives ``is_active`` back as a boolean."""
    return spark.read.parquet(path).withColumn("is_active", F.col("is_active").cast("boolean"))
