"""Streaming twins of the batch operators, run to the end of their input."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.changes import ALERT_CTES, BATCH, SHOWN, UPSERT, current, next_batch
from jobloom.queries.searching import ACCEPT
from jobloom.queries.selections import HOST
from jobloom.queries.projections import CANON
from jobloom.queries.sql_views import AS_OF, with_enriched, with_listings
from jobloom.runtime import settle, shared_folder
from jobloom.streaming import catalogue, health, timers
from jobloom import lexicons as lx

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS


def table_stream(spark, sf, name):
    """One of the given tables, read as a stream of files."""
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def finish(stream, spark, name, mode="append"):
    """Run a stream over what is there and return what it wrote."""
    out = shared_folder(spark, name)
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "offsets")) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


PICKED = f"""usable AS (SELECT *, lower({CANON}) AS link FROM batch WHERE {HOST} NOT IN ({', '.join(sv.q(h) for h in lx.API_HOSTS)})),
picked AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY source, link ORDER BY length(description_text) DESC, id) = 1)"""


LATER = "2024-02-20T00:00:00"
STREAMED = UPSERT.replace("FULL JOIN batch n", "FULL JOIN picked n").replace(AS_OF, f"TIMESTAMP '{LATER.replace('T', ' ')}'")


@query("stream_upsert", "E1 D1", with_listings(STREAMED, BATCH + ", " + PICKED))
def _(spark, sf):
    landed, store = shared_folder(spark, "rows"), shared_folder(spark, "store")
    catalogue.create_bucketed(current(spark, sf), store, 16)
    rows = next_batch(spark, sf, spark.read.parquet(store)).withColumns({
        "last_seen_at": F.lit(LATER + "Z").cast("timestamp"), "description_html": F.lit(None).cast("string"), "seq": C("id")})
    rows = settle(rows, "arrived")  # by all tasks; the files of the stream are made of it
    rows.coalesce(1).write.parquet(landed)
    # The second batch is older than the first: a late delivery, which must change nothing.
    late = rows.withColumns({"last_seen_at": C("last_seen_at") - F.expr("INTERVAL 60 DAYS"), "title": F.lit("late")})
    late.coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    catalogue.stream_upsert(stream, store, shared_folder(spark, "offsets"), buckets=16).awaitTermination()
    return spark.read.parquet(store).select(*SHOWN)


@query("stream_alerts", "E2 J11", with_enriched("SELECT search_id, id AS listing_id FROM m", ALERT_CTES))
def _(spark, sf):
    landed, out = shared_folder(spark, "rows"), shared_folder(spark, "alerts")
    rows = fx.enriched(spark, sf).drop("embedding", "seniority_signals", "description_html")
    rows.write.parquet(landed)
    stream = spark.readStream.schema(rows.schema).parquet(landed)
    catalogue.stream_alerts(stream, fx.saved_searches(spark, sf), out, shared_folder(spark, "offsets"), NOW, "40 days").awaitTermination()
    return spark.read.parquet(out).select("search_id", "listing_id")


TIMERS = """ch AS (SELECT saved_id, status, applied_at FROM saved WHERE status <> 'saved'), wm AS (SELECT max(applied_at) AS w FROM ch)"""


@query("stream_followups", "E3 D9", f"WITH {sv.SAVED}, {TIMERS} SELECT saved_id, 'follow_up' AS event, applied_at + INTERVAL 7 DAY AS at FROM ch, wm WHERE status = 'applied' AND applied_at + INTERVAL 7 DAY <= w UNION ALL SELECT saved_id, 'ghosted', applied_at + INTERVAL 14 DAY FROM ch, wm WHERE status = 'applied' AND applied_at + INTERVAL 14 DAY <= w")
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STATE_STORE)
    landed = shared_folder(spark, "changes")
    saved = fx.saved(spark, sf).filter("status <> 'saved'")
    first = saved.select("saved_id", F.lit(1).alias("seq"), F.lit("applied").alias("status"), C("applied_at").alias("changed_at"))
    later = saved.filter("status = 'interview'").select("saved_id", F.lit(2).alias("seq"), "status", C("applied_at").alias("changed_at"))
    changes = first.unionByName(later)
    changes.write.parquet(landed)
    stream = spark.readStream.schema(changes.schema).parquet(landed)
    out = finish(timers.followup_events(stream), spark, "events")
    return out.select("saved_id", "event", F.timestamp_millis("at_ms").alias("at"))


HOURS = """w AS (SELECT source, started_at, jobs_fetched, errors, date_trunc('hour', started_at) - to_hours(CAST(i AS INT)) AS window_start FROM runs, range(24) t(i))"""


@query("stream_source_health", "E4 G3", f"WITH {sv.RUNS}, {HOURS} SELECT window_start, source, count(*) AS runs, CAST(sum(jobs_fetched) AS BIGINT) AS fetched, count(*) FILTER (WHERE coalesce(errors, '') <> '') AS failed_runs, max(started_at) AS last_run FROM w WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(started_at) - INTERVAL 1 HOUR FROM runs) GROUP BY ALL")
def _(spark, sf):
    events = table_stream(spark, sf, "events")
    runs = events.select(C("event_type").alias("source"), fx.instant("ts").alias("started_at"), F.floor("value").cast("bigint").alias("jobs_fetched"),
        F.when(C("value") < 1, "x").when(C("event_id") % 3 == 0, "").alias("errors"))
    return finish(health.source_health_stream(runs), spark, "health")


PER_SECOND = f"WITH {ACCEPT}, n AS (SELECT key, sec, count(*) AS n FROM s GROUP BY ALL) SELECT key, sec, n, CAST(len(list_filter(taken, lambda x: x = sec)) AS BIGINT) AS accepted FROM n JOIN acc USING (key)"


@query("stream_throttle", "E5 T8", PER_SECOND)
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STATE_STORE)
    rows = table_stream(spark, sf, "events").select("event_id", C("user_id").alias("key"), fx.instant("ts").alias("ts"))
    return finish(timers.throttle_stream(rows, 3, 21_600), spark, "throttle")
