"""Feed payloads in, documents out."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.sql_views import CUTOFF, q, with_enriched, with_listings
from jobloom.runtime import shared_folder
from jobloom.sources import export, feeds

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS
BOARDED = ", ".join(q(s) for s, m in feeds.FIELD_MAPS.items() if m.get("board"))
DROPS = ", ".join(q(s) for s, m in feeds.FIELD_MAPS.items() if m["stale"] == "drop")
SLUG = "trim(lower(regexp_replace(title, '[^a-zA-Z0-9]+', '-', 'g')), '-')"
LINK = f"""CASE WHEN source = 'personio' THEN 'https://' || board || '.jobs.personio.de/job/' || id WHEN source = 'bamboohr' THEN 'https://' || board || '.bamboohr.com/careers/' || id
  WHEN source = 'smartrecruiters' AND contains(apply_url, 'api.smartrecruiters.com/') THEN 'https://jobs.smartrecruiters.com/' || board || '/' || id || '-' || {SLUG} || '-software-engineer?oga=true'
  ELSE regexp_replace(regexp_replace(apply_url, '#.*$', ''), '\\?$', '') END"""
FEED_SQL = with_listings(f"""SELECT source, CASE WHEN source IN ({BOARDED}) THEN board || ':' || id ELSE CAST(id AS VARCHAR) END AS external_id, title || ' software engineer' AS title, company_name,
  {LINK} AS apply_url, CASE WHEN source = 'personio' AND posted_at < {CUTOFF} THEN NULL ELSE posted_at END AS posted_at, description_text AS body
  FROM (SELECT *, split_part(external_id, ':', 1) AS board FROM listings) WHERE source NOT IN ({DROPS}) OR posted_at IS NULL OR posted_at >= {CUTOFF}""")
SHOWN = ["source", "external_id", "title", "company_name", "apply_url", "posted_at"]


def shown(df):
    return df.select(*SHOWN, C("description_text").alias("body"))


@query("normalize_feed", "S1 F10", FEED_SQL)
def _(spark, sf):
    landed = shared_folder(spark, "landed")
    fx.raw_feed(spark, sf).write.partitionBy("source").parquet(landed)
    return shown(feeds.normalize_feed(spark.read.parquet(landed), NOW, DAYS))


@query("landed_stream", "S9 S1", FEED_SQL)
def _(spark, sf):
    from jobloom.streaming.catalogue import landed_stream, normalized_batch

    landed, out = shared_folder(spark, "landed"), shared_folder(spark, "normalized")
    fx.raw_feed(spark, sf).write.parquet(landed)

    def run(batch, batch_id):
        shown(normalized_batch(batch, NOW, DAYS)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = landed_stream(spark, landed)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", shared_folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("read_xml_feed", "S2 S1", with_listings(f"""SELECT 'b0:' || id AS external_id, title || ' engineer' AS title, CASE WHEN posted_at >= {CUTOFF} THEN date_trunc('second', posted_at) END AS posted_at,
  'https://b0.jobs.personio.de/job/' || id AS apply_url FROM listings"""))
def _(spark, sf):
    where = shared_folder(spark, "xml")
    df = fx.listings(spark, sf).select(
        C("id").cast("string").alias("id"), F.concat("title", F.lit(" engineer")).alias("name"), C("location_raw").alias("office"),
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"))
    df.write.format("xml").option("rowTag", "position").option("rootTag", "positions").save(where)
    raw = feeds.read_xml_feed(spark, where, "position", feeds.POSITION_SCHEMA, "personio")
    raw = raw.withColumns({"ats_slug": F.lit("b0"), "company_name": F.lit("Firm")})
    return feeds.normalize_feed(raw, NOW, DAYS, ["personio"]).select("external_id", "title", "posted_at", "apply_url")


@query("read_rss_feed", "S2 S1", with_listings(f"""SELECT CASE WHEN id % 3 = 0 THEN 'https://rss.example.com/' || id ELSE 'wwr-' || id END AS external_id, 'Firm ' || id % 7 AS company_name, title || ' engineer' AS title,
  CASE WHEN id % 4 = 0 THEN 'Remote' WHEN id % 4 = 1 THEN 'Anywhere' ELSE 'Land ' || id % 5 END AS location_raw, date_trunc('second', posted_at) AS posted_at,
  'https://rss.example.com/' || id AS apply_url FROM listings WHERE posted_at IS NULL OR date_trunc('second', posted_at) >= {CUTOFF}"""))
def _(spark, sf):
    """News items; a third has no guid, places stand in either of two elements or in none."""
    where = shared_folder(spark, "rss")
    key = C("id").cast("string")
    link = F.concat(F.lit("https://rss.example.com/"), key)
    df = fx.listings(spark, sf).select(
        F.when(C("id") % 3 != 0, F.concat(F.lit("wwr-"), key)).alias("guid"), link.alias("link"),
        F.concat(F.lit("Firm "), (C("id") % 7).cast("string"), F.lit(": "), "title", F.lit(" engineer")).alias("title"),
        F.concat(F.lit("<p>"), "description_text", F.lit("</p>")).alias("description"),
        F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'").alias("pubDate"),
        F.when(C("id") % 4 == 1, "Anywhere").alias("region"), F.when(C("id") % 4 > 1, F.concat(F.lit("Land "), (C("id") % 5).cast("string"))).alias("country"))
    df.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(where)
    raw = feeds.read_xml_feed(spark, where, "item", feeds.NEWS_SCHEMA, "weworkremotely")
    return feeds.normalize_feed(raw, NOW, DAYS, ["weworkremotely"]).select("external_id", "company_name", "title", "location_raw", "posted_at", "apply_url")


@query("posting_export", "S7 P33 P34 P35 P36 P40", with_enriched(f"SELECT id, title, 'https://listings.example.com/jobs/' || id AS url, company_name AS employer FROM enriched WHERE is_active AND anchor >= {CUTOFF} - INTERVAL 12 HOUR"))
def _(spark, sf):
    docs = export.posting_export(fx.enriched(spark, sf), NOW, DAYS)
    return docs.select("id", F.get_json_object("document", "$.title").alias("title"), F.get_json_object("document", "$.url").alias("url"),
                       F.get_json_object("document", "$.hiringOrganization.name").alias("employer"))


@query("posting_documents", "S7")
def _(spark, sf):
    where = shared_folder(spark, "documents")
    export.write_documents(export.posting_export(fx.enriched(spark, sf), NOW, DAYS), where)
    return spark.read.text(where).select(F.get_json_object("value", "$.url").alias("url"), F.get_json_object("value", "$.employmentType").alias("employment"))
