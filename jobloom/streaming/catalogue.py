"""Feeds arriving as files: streaming upsert and streaming alerts."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.operators.alerts import search_matches
from jobloom.operators.dedupe import best_per_link, last_per_listing, linked, sized, usable
from jobloom.operators.lifecycle import upsert
from jobloom.runtime import broadcast_if_small, settle
from jobloom.sources.feeds import normalize_feed

BUCKETS = 256
NEWS_ROWS = 2_000_000  # of one number each
LANDED_SCHEMA = "seq long, source string, ats_slug string, company_name string, company_url string, career_page_url string, payload string"


def landed_stream(spark: SparkSession, path: str, schema: str = LANDED_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """Arriving payload files with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def normalized_batch(batch: DataFrame, as_of, days: int) -> DataFrame:
    """The same projection the batch run uses, on one micro-batch."""
    return normalize_feed(batch, as_of, days)


def _bucket(n: int):
    return F.pmod(F.xxhash64("source", "external_id"), F.lit(n)).cast("int")


def create_bucketed(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A catalogue stored by hash of its key, so that a change touches few buckets."""
    rows = df.withColumn("bucket", _bucket(buckets)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _news(rows: DataFrame, stored: DataFrame, stamp: str, buckets: int) -> DataFrame:
    """Rows with a bucket that are not older than what is stored under their key; only keys and times of the stored rows are read."""
    key = ["bucket", "source", "external_id"]
    known = stored.select(*key, F.col("last_seen_at").alias("_stored"))
    met = rows.withColumn("bucket", _bucket(buckets)).join(known, key, "left")
    return met.filter(F.col("_stored").isNull() | ~F.coalesce(F.col("_stored") > F.col(stamp), F.lit(False)))


def apply_batch(batch: DataFrame, path: str, stamp: str, buckets: int = BUCKETS, chosen=None) -> None:
    """Upsert one deduplicated batch, rewriting only the buckets it touches.

    Each row is stamped with its own time; what is stored newer stays, and a
    bucket for which the batch has nothing newer is not rewritten.  ``chosen``
    gives the rows that count of a batch that is not deduplicated; it keeps
    their ``_row``, by which the texts of those that are news are fetched.

    Applying the same batch again gives the same catalogue, so a batch that is
    replayed after a lost executor or driver does no harm.
    """
    stored = batch.sparkSession.read.parquet(path)
    numbered = batch.withColumn("_row", F.monotonically_increasing_id())
    news_of = lambda rows: _news(chosen(rows) if chosen else rows, stored, stamp, buckets).select("_row", "bucket")
    if news_of(numbered).isEmpty():
        return  # before any text is written
    rows = settle(numbered, "batch")
    news = settle(news_of(rows).distinct(), "news")
    touched = [r[0] for r in news.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    rows = rows.join(broadcast_if_small(news.select("_row"), NEWS_ROWS), "_row", "left_semi").drop("_row")
    within = F.col("bucket").isin(touched)
    after = upsert(stored.filter(within).drop("bucket"), rows, None, stamp).withColumn("bucket", _bucket(buckets))
    # Files of touched buckets are replaced when the job commits, after all were read.
    after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stream_upsert(rows: DataFrame, path: str, checkpoint: str, as_of_column: str = "last_seen_at", buckets: int = BUCKETS):
    """Start the upsert of a stream of canonical rows; available data, then stop.

    The row with the newest ``as_of_column`` wins, within a batch (then by
    ``seq``, where rows carry one) and across batches in any order; rows
    without a time are left out.
    """

    def run(batch, _batch_id):
        own = [F.col("seq")] if "seq" in batch.columns else []
        timed = batch.filter(F.col(as_of_column).isNotNull())
        at = F.struct(F.unix_micros(as_of_column).alias("at"), *own)

        def chosen(df):
            """What ``batch_dedupe`` would keep, slim: texts are measured and links read where they lie, and do not move."""
            slim = linked(sized(usable(df))).select("_row", "source", "external_id", "_link", "_size", as_of_column, at.alias("_seq"))
            return best_per_link(last_per_listing(slim, "_seq"))

        apply_batch(timed, path, as_of_column, buckets, chosen)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_alerts(listings: DataFrame, searches: DataFrame, out: str, checkpoint: str, as_of, late: str = "7 days"):
    """Every new listing tested once against every search; no list is cut.

    A listing seen again within ``late`` is dropped before matching.  The
    output is keyed by batch, so a replayed batch replaces its own rows.
    """
    once = listings.withWatermark("first_seen_at", late).dropDuplicatesWithinWatermark(["id"])

    def run(batch, batch_id):
        if batch.isEmpty():
            return
        hits = search_matches(searches, batch, as_of, look=None)
        hits.select("search_id", F.col("id").alias("listing_id")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
