"""Filters, orders, pages and set operations."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.functions import seniority, times
from jobloom.operators import dedupe, filters, ranking, relations
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.sql_views import AS_OF, CUTOFF, FRESH, TRUST, with_enriched, with_listings

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS


@query("fresh", "F1", with_listings(f"SELECT id, source FROM listings WHERE {FRESH}"))
def _(spark, sf):
    return filters.fresh(fx.listings(spark, sf), NOW, DAYS).select("id", "source")


@query("stale", "F2", with_listings(f"SELECT id, source FROM listings WHERE is_active AND anchor < {CUTOFF}"))
def _(spark, sf):
    return filters.stale(fx.listings(spark, sf), NOW, DAYS).select("id", "source")


@query("facet_filter", "F3", with_enriched("SELECT id, title FROM enriched WHERE workplace_type = 'remote' AND location_raw ILIKE '%lahore%' AND company_name ILIKE '%supplier%' AND employment_type ILIKE '%full%'"))
def _(spark, sf):
    return filters.facet_filter(fx.enriched(spark, sf), workplace="Remote", city="lahore", company="SUPPLIER", employment_type="full").select("id", "title")


@query("stage_filter", "F4", with_enriched("SELECT id, 'eligible' AS asked FROM enriched WHERE junior_eligible UNION ALL SELECT id, 'new_grad' FROM enriched WHERE career_stage = 'new_grad' UNION ALL SELECT id, 'senior' FROM enriched WHERE career_stage = 'senior'"))
def _(spark, sf):
    # Titles alone decide eligibility here, without the contradiction rule.
    e = fx.enriched(spark, sf).withColumn("junior_eligible", seniority.junior_eligible(C("career_stage"), C("years_required_min"), C("title")))
    asks = {"junior": "eligible", "new-grad": "new_grad", "senior": "senior"}
    parts = [filters.stage_filter(e, a).select("id", F.lit(n).alias("asked")) for a, n in asks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tag_overlap", "F5", with_enriched("SELECT id FROM enriched WHERE list_has_any(skills, ['java', 'cloud', 'der']) OR list_has_any(tech_tags, ['java', 'cloud', 'der'])"))
def _(spark, sf):
    return filters.tag_overlap(fx.enriched(spark, sf), [" Java", "cloud", "", "der"]).select("id")


@query("region_filter", "F6", with_listings(f"SELECT id FROM listings WHERE {sv.REGION}"))
def _(spark, sf):
    return filters.region_filter(fx.enriched(spark, sf)).select("id")


EXCLUDED = "(career_stage IN ('mid', 'senior') OR coalesce(years_required_min >= 3, false) OR (NOT junior_eligible AND career_stage NOT IN ('internship', 'new_grad', 'junior')))"


@query("exclude_for_level", "F7", with_enriched(f"SELECT id, career_stage FROM enriched WHERE NOT {EXCLUDED}"))
def _(spark, sf):
    return filters.exclude_for_level(fx.enriched(spark, sf), "entry-level").select("id", "career_stage")


@query("embed_candidates", "F8", with_listings(f"SELECT id FROM listings WHERE {FRESH} AND apply_url IS NOT NULL AND (embedding IS NULL OR embedding_provider <> 'a' OR id % 3 <> 0)"))
def _(spark, sf):
    df = fx.listings(spark, sf).withColumn("embedding_hash", F.when(C("id") % 3 == 0, "known"))
    return filters.embed_candidates(df, "a", NOW, DAYS).select("id")


@query("clamp_window", "F9", f"WITH {sv.SEARCHES} SELECT search_id, greatest(1, least(30, coalesce(TRY_CAST(posted_within AS INT), 7))) AS days FROM searches")
def _(spark, sf):
    return fx.saved_searches(spark, sf).select("search_id", times.clamp_window(C("posted_within")).alias("days"))


@query("ingest_drop", "F10", with_listings(f"SELECT id FROM listings WHERE (posted_at IS NULL OR posted_at >= {CUTOFF}) AND NOT (id % 7 = 0 AND last_seen_at < {AS_OF})"))
def _(spark, sf):
    df = fx.listings(spark, sf).withColumn("expires_at", F.when(C("id") % 7 == 0, C("last_seen_at")))
    return filters.ingest_drop(df, NOW, DAYS).select("id")


TOTAL = f"{TRUST}, CASE WHEN posted_at IS NULL THEN 1 ELSE 0 END"


@query("relevance_page", "O1 O4", with_listings(f"SELECT id, 21 - row_number() OVER (ORDER BY rank DESC, {TOTAL}, posted_at DESC NULLS LAST, id) + 0.0 AS score FROM (SELECT *, length(description_text) // 500 AS rank FROM listings WHERE {FRESH}) ORDER BY rank DESC, {TOTAL}, posted_at DESC NULLS LAST, id LIMIT 20"))
def _(spark, sf):
    df = filters.fresh(fx.listings(spark, sf), NOW, DAYS).withColumn("rank", F.floor(F.length("description_text") / 500))
    return ranking.page(df, ranking.relevance_order(), 1, 20).select("id", "score")


@query("newest_page", "O2 O4", with_listings(f"SELECT id, posted_at FROM listings WHERE {FRESH} ORDER BY posted_at DESC NULLS LAST, first_seen_at DESC, {TOTAL}, id LIMIT 20 OFFSET 20"))
def _(spark, sf):
    return ranking.page(filters.fresh(fx.listings(spark, sf), NOW, DAYS), ranking.newest_order(), 2, 20).select("id", "posted_at")


@query("company_page", "O3 O4", with_listings(f"SELECT id, company_name, 101 - row_number() OVER (ORDER BY lower(company_name), posted_at DESC NULLS LAST, id) + 0.0 AS score FROM listings WHERE {FRESH} ORDER BY lower(company_name), posted_at DESC NULLS LAST, id LIMIT 100"))
def _(spark, sf):
    return ranking.page(filters.fresh(fx.listings(spark, sf), NOW, DAYS), ranking.company_order(), 0, 500).select("id", "company_name", "score")


@query("page_total", "G14", with_enriched(f"SELECT count(*) AS total FROM enriched WHERE {FRESH} AND workplace_type = 'remote'"))
def _(spark, sf):
    df = filters.facet_filter(filters.fresh(fx.listings(spark, sf), NOW, DAYS), workplace="remote")
    return df.agg(F.count(F.lit(1)).alias("total"))


NOTICES = f"notices AS (SELECT event_id AS notification_id, user_id, ts AS created_at, '/jobs/' || (event_id % 97) AS link, event_id % 2 = 0 AS is_read FROM events)"


def notices(spark, sf):
    return fx.table(spark, sf, "events").select(C("event_id").alias("notification_id"), "user_id", fx.instant("ts").alias("created_at"),
        F.concat(F.lit("/jobs/"), (C("event_id") % 97).cast("string")).alias("link"), (C("event_id") % 2 == 0).alias("is_read"))


@query("recent_notifications", "O7", f"WITH {NOTICES} SELECT user_id, notification_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS position FROM notices QUALIFY position <= 50")
def _(spark, sf):
    return ranking.recent_per_user(notices(spark, sf), 50).select("user_id", "notification_id", "position")


@query("union_batches", "U1", with_listings("SELECT source, count(*) AS n, count(company_name) AS with_company FROM (SELECT source, company_name FROM listings UNION ALL SELECT 'extra', NULL FROM listings WHERE id % 2 = 0) GROUP BY source"))
def _(spark, sf):
    df = fx.listings(spark, sf)
    both = relations.union_batches(df.select("source", "company_name"), df.filter("id % 2 = 0").select(F.lit("extra").alias("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("company_name").alias("with_company"))


@query("union_candidates", "U2", "SELECT user_id, listing_id, max(score) AS score FROM (SELECT user_id, event_id % 50 AS listing_id, value AS score FROM events UNION ALL SELECT user_id, event_id % 70, value / 2 FROM events) GROUP BY ALL")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    a = e.select("user_id", (C("event_id") % 50).alias("listing_id"), C("value").alias("score"))
    return relations.union_candidates(a, e.select("user_id", (C("event_id") % 70).alias("listing_id"), (C("value") / 2).alias("score")))


@query("tag_difference", "U4", with_enriched("SELECT id, array_to_string(list_sort(list_filter(list_concat(skills, tech_tags), lambda t: NOT list_contains(['python', 'the'], t))), '|') AS gaps FROM enriched"))
def _(spark, sf):
    have = F.array(F.lit("python"), F.lit("the"))
    return fx.enriched(spark, sf).select("id", relations.tag_difference(F.concat("skills", "tech_tags"), have).alias("gaps"))


@query("tag_intersection", "U5", with_enriched("SELECT id, array_to_string(list_sort(list_intersect(list_concat(skills, tech_tags), ['python', 'the', 'java', 'le'])), '|') AS shared FROM enriched"))
def _(spark, sf):
    have = F.array(*[F.lit(x) for x in ("python", "the", "java", "le")])
    return fx.enriched(spark, sf).select("id", relations.tag_intersection(F.concat("skills", "tech_tags"), have).alias("shared"))


# ---- duplicate and latest picks --------------------------------------------

SURV1 = f"""keyed AS (SELECT *, lower(regexp_replace(regexp_replace(split_part(regexp_replace(apply_url, '^https?://(www\\.)?', '', 'i'), '?', 1), '/$', ''), '#.*$', '')) AS apply_key FROM enriched),
w1 AS (SELECT *, CASE WHEN is_active AND apply_key <> '' THEN row_number() OVER (PARTITION BY is_active, apply_key ORDER BY {sv.PREF}, first_seen_at, id) END AS rn1 FROM keyed),
w2 AS (SELECT *, CASE WHEN is_active AND coalesce(rn1, 1) = 1 THEN row_number() OVER (PARTITION BY is_active AND coalesce(rn1, 1) = 1, lower(trim(title)), lower(trim(company_name)), career_stage
  ORDER BY {sv.PREF}, CASE WHEN posted_at IS NULL THEN 1 ELSE 0 END, first_seen_at, id) END AS rn2 FROM w1)"""


@query("link_duplicates", "W1 J12", with_enriched("SELECT id, coalesce(rn1 > 1, false) AS dup_link FROM w1", SURV1))
def _(spark, sf):
    return dedupe.flag_link_duplicates(fx.listings(spark, sf)).select("id", "dup_link")


@query("title_duplicates", "W2 J12", with_enriched("SELECT id, coalesce(rn2 > 1, false) AS dup_title FROM w2", SURV1))
def _(spark, sf):
    df = dedupe.flag_link_duplicates(fx.enriched(spark, sf))
    return dedupe.flag_title_duplicates(df, ~C("dup_link")).select("id", "dup_title")


def arrivals(spark, sf):
    """Every listing arrives twice or more, under ids shared by three rows."""
    df = fx.listings(spark, sf)
    ext = F.concat(F.lit("x"), F.floor(C("id") / 3).cast("string"))
    return df.withColumns({"external_id": ext, "seq": C("id")})


ARRIVALS = "arrivals AS (SELECT * REPLACE ('x' || (id // 3) AS external_id), id AS seq FROM listings)"
LAST = "last_rows AS (SELECT *, min(seq) OVER (PARTITION BY source, external_id) AS first_seq FROM arrivals QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY seq DESC) = 1)"


@query("last_per_listing", "W3", with_listings("SELECT id, source, external_id, first_seq FROM last_rows", ARRIVALS + ", " + LAST))
def _(spark, sf):
    return dedupe.last_per_listing(arrivals(spark, sf)).select("id", "source", "external_id", "first_seq")


def _canon():
    from jobloom.queries.projections import CANON, host_sql

    return CANON, host_sql("apply_url")


CANON, HOST = _canon()
BEST = f"best AS (SELECT * FROM (SELECT *, lower({CANON}) AS link FROM last_rows) WHERE link <> '' QUALIFY row_number() OVER (PARTITION BY source, link ORDER BY {TRUST}, length(description_text) + length(description_html) DESC, first_seq) = 1)"


@query("best_per_link", "W4", with_listings("SELECT id, source FROM best", ARRIVALS + ", " + LAST + ", " + BEST))
def _(spark, sf):
    return dedupe.best_per_link(dedupe.last_per_listing(dedupe.sized(arrivals(spark, sf)))).select("id", "source")


@query("batch_dedupe", "W3 W4 P4", with_listings("SELECT id, source FROM best",
    f"arrivals AS (SELECT * REPLACE ('x' || (id // 3) AS external_id), id AS seq FROM listings WHERE {HOST} NOT IN ({', '.join(sv.q(h) for h in lx.API_HOSTS)})), " + LAST + ", " + BEST))
def _(spark, sf):
    return dedupe.batch_dedupe(arrivals(spark, sf)).select("id", "source")


@query("unique_labels", "W8", with_enriched("""SELECT id, array_to_string(list_filter(raw, lambda t, i: list_position(list_transform(raw, lambda x: lower(x)), lower(t)) = i), '|') AS labels
  FROM (SELECT id, list_filter(list_transform(list_concat([source, upper(source)], list_concat(skills, [title, upper(title)])), lambda x: trim(x)), lambda x: x <> '') AS raw FROM enriched)"""))
def _(spark, sf):
    lists = fx.enriched(spark, sf).select("id", F.concat(F.array("source", F.upper("source")), "skills", F.array("title", F.upper("title"))).alias("labels"))
    return relations.unique_labels(lists, ["id"], "labels")


@query("unique_label_array", "W8", with_enriched("""SELECT id, array_to_string(list_filter(raw, lambda t, i: list_position(list_transform(raw, lambda x: lower(x)), lower(t)) = i), '|') AS labels
  FROM (SELECT id, list_transform(list_concat([source, upper(source)], skills), lambda x: trim(x)) AS raw FROM enriched)"""))
def _(spark, sf):
    return fx.enriched(spark, sf).select("id", relations.unique_label_array(F.concat(F.array("source", F.upper("source")), "skills")).alias("labels"))


@query("latest_document", "W9", "SELECT user_id, event_id AS doc_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 11 = 0 DESC, ts DESC, event_id DESC) = 1")
def _(spark, sf):
    docs = fx.table(spark, sf, "events").select("user_id", C("event_id").alias("doc_id"), (C("event_id") % 11 == 0).alias("is_primary"), fx.instant("ts").alias("created_at"))
    return relations.latest_document(docs).select("user_id", "doc_id")
