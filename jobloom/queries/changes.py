"""Catalogue, registry and application changes."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.operators import alerts, dedupe, lifecycle
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.projections import BOARD_CTE, BOARD_SLUG, BOARD_TYPE, board_urls
from jobloom.queries.rollup import REG_CLEAN
from jobloom.queries.selections import NOTICES, SURV1, notices
from jobloom.queries.sql_views import AS_OF, arr, with_enriched, with_listings

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS
STORED = ["id", "source", "external_id", "title", "company_name", "apply_url", "description_text", "workplace_type", "posted_at",
          "first_seen_at", "last_seen_at", "is_active", "missed_runs", "embedding_hash"]


def current(spark, sf):
    return fx.listings(spark, sf).withColumn("embedding_hash", F.concat(F.lit("h"), C("id").cast("string"))).select(*STORED)


def next_batch(spark, sf, rows=None):
    """A third retitled, a third repeated without a date, and some new rows; of ``rows``, where the listings are at hand."""
    cols = ["id", "source", "external_id", "title", "company_name", "apply_url", "description_text", "workplace_type", "posted_at"]
    df = (fx.listings(spark, sf) if rows is None else rows).select(*cols)
    seen = df.filter("id % 3 in (0, 1)").withColumns({
        "title": F.when(C("id") % 3 == 0, F.concat("title", F.lit(" II"))).otherwise(C("title")),
        "posted_at": F.when(C("id") % 3 == 0, C("posted_at")),
    })
    new = df.filter("id % 10 = 0").withColumns({"external_id": F.concat(F.lit("n"), "external_id"), "id": C("id") + 1_000_000})
    return seen.unionByName(new)


BATCH = """cur AS (SELECT *, 'h' || id AS embedding_hash FROM listings),
batch AS (SELECT id, source, external_id, CASE WHEN id % 3 = 0 THEN title || ' II' ELSE title END AS title, company_name, apply_url, description_text, workplace_type, CASE WHEN id % 3 = 0 THEN posted_at END AS posted_at FROM listings WHERE id % 3 IN (0, 1)
  UNION ALL SELECT id + 1000000, source, 'n' || external_id, title, company_name, apply_url, description_text, workplace_type, posted_at FROM listings WHERE id % 10 = 0)"""
UPSERT = f"""SELECT coalesce(c.id, n.id) AS id, coalesce(c.source, n.source) AS source, coalesce(c.external_id, n.external_id) AS external_id,
  CASE WHEN n.id IS NOT NULL THEN n.title ELSE c.title END AS title, coalesce(n.posted_at, c.posted_at) AS posted_at,
  coalesce(c.first_seen_at, {AS_OF}) AS first_seen_at, CASE WHEN n.id IS NOT NULL THEN {AS_OF} ELSE c.last_seen_at END AS last_seen_at,
  CASE WHEN n.id IS NOT NULL THEN true ELSE c.is_active END AS is_active, CASE WHEN n.id IS NOT NULL THEN 0 ELSE c.missed_runs END AS missed_runs,
  CASE WHEN n.id IS NOT NULL AND (c.id IS NULL OR c.title <> n.title) THEN NULL ELSE c.embedding_hash END AS embedding_hash
  FROM cur c FULL JOIN batch n ON c.source = n.source AND c.external_id = n.external_id"""
SHOWN = ["id", "source", "external_id", "title", "posted_at", "first_seen_at", "last_seen_at", "is_active", "missed_runs", "embedding_hash"]


@query("upsert", "D1", with_listings(UPSERT, BATCH))
def _(spark, sf):
    return lifecycle.upsert(current(spark, sf), next_batch(spark, sf), NOW).select(*SHOWN)


@query("upsert_again", "D1", with_listings(UPSERT, BATCH))
def _(spark, sf):
    batch = next_batch(spark, sf)
    return lifecycle.upsert(lifecycle.upsert(current(spark, sf), batch, NOW), batch, NOW).select(*SHOWN)


OK = lx.SOURCE_PREFERENCE[:10]
SEEN = "2024-01-21T00:00:00"
MISSED = f"(is_active AND list_contains({arr(OK)}, source) AND last_seen_at < TIMESTAMP '2024-01-21 00:00:00')"


@query("mark_missed", "D2", with_listings(f"SELECT id, missed_runs + CAST({MISSED} AS INT) AS missed_runs, is_active AND NOT ({MISSED} AND missed_runs + 1 >= 2) AS is_active FROM listings"))
def _(spark, sf):
    return lifecycle.mark_missed(fx.listings(spark, sf), OK, SEEN).select("id", "missed_runs", "is_active")


@query("suppress_duplicates", "D3 W1 W2 J12", with_enriched("SELECT id, is_active AND coalesce(rn1, 1) = 1 AND coalesce(rn2, 1) = 1 AS is_active FROM w2", SURV1))
def _(spark, sf):
    return dedupe.suppress_duplicates(fx.enriched(spark, sf)).select("id", "is_active")


@query("expire", "D4 F2", with_listings(f"SELECT id, is_active AND anchor >= {sv.CUTOFF} AS is_active FROM listings"))
def _(spark, sf):
    return lifecycle.expire(fx.listings(spark, sf), NOW, DAYS).select("id", "is_active")


@query("purge", "D5", with_listings(f"SELECT id FROM listings WHERE anchor >= {sv.CUTOFF}"))
def _(spark, sf):
    return lifecycle.purge(fx.listings(spark, sf), NOW, DAYS).select("id")


@query("detach_saved", "D5", with_listings(f"SELECT saved_id, (SELECT id FROM listings WHERE id = listing_id AND anchor >= {sv.CUTOFF}) AS listing_id FROM saved", sv.SAVED))
def _(spark, sf):
    left = lifecycle.purge(fx.listings(spark, sf), NOW, DAYS)
    return lifecycle.detach_saved(fx.saved(spark, sf), left).select("saved_id", "listing_id")


INCOMING = "incoming AS (SELECT ats_type, ats_slug, upper(name) AS name, false AS is_enabled FROM clean WHERE length(ats_slug) % 2 = 0 UNION ALL SELECT 'lever', 'new-' || s_suppkey, s_name, true FROM supplier)"


@query("upsert_registry", "D6", f"WITH {sv.REGISTRY}, {REG_CLEAN}, {INCOMING} SELECT ats_type, ats_slug, coalesce(i.name, c.name) AS name, coalesce(i.is_enabled, c.is_enabled) AS is_enabled, c.region_focus FROM clean c FULL JOIN incoming i USING (ats_type, ats_slug)")
def _(spark, sf):
    clean = lifecycle.load_registry(fx.registry(spark, sf))
    changed = clean.filter(F.length("ats_slug") % 2 == 0).select("ats_type", "ats_slug", F.upper("name").alias("name"), F.lit(False).alias("is_enabled"))
    new = fx.table(spark, sf, "supplier").select(F.lit("lever").alias("ats_type"), F.concat(F.lit("new-"), C("s_suppkey").cast("string")).alias("ats_slug"),
        C("s_name").alias("name"), F.lit(True).alias("is_enabled"))
    out = lifecycle.upsert_registry(clean, changed.unionByName(new))
    return out.select("ats_type", "ats_slug", "name", "is_enabled", "region_focus")


KNOWN = "known AS (SELECT 'lever' AS ats_type, 'CO' || s_suppkey AS ats_slug, 'Old ' || s_suppkey AS name, false AS is_enabled, 'global' AS region_focus FROM supplier WHERE s_suppkey % 20 IN (1, 2))"


@query("merge_discovered_boards", "D7 P31", f"""WITH {BOARD_CTE}, {KNOWN}, refs AS (SELECT *, {BOARD_TYPE} AS ats_type, {BOARD_SLUG} AS slug FROM found_urls),
  f AS (SELECT * FROM refs WHERE ats_type IS NOT NULL AND slug IS NOT NULL)
  SELECT coalesce(k.ats_type, f.ats_type) AS ats_type, coalesce(k.ats_slug, f.slug) AS ats_slug, coalesce(k.name, f.name) AS name, CASE WHEN f.slug IS NOT NULL THEN true ELSE k.is_enabled END AS is_enabled,
  CASE WHEN lower(f.slug) IN ('co1', 'co3') THEN 'both' ELSE 'global' END AS region_focus FROM known k FULL JOIN f ON k.ats_type = f.ats_type AND lower(k.ats_slug) = lower(f.slug)""")
def _(spark, sf):
    key = C("s_suppkey").cast("string")
    known = fx.table(spark, sf, "supplier").filter("s_suppkey % 20 in (1, 2)").select(
        F.lit("lever").alias("ats_type"), F.concat(F.lit("CO"), key).alias("ats_slug"), F.concat(F.lit("Old "), key).alias("name"),
        F.lit(None).cast("string").alias("website"), F.lit("global").alias("region_focus"), F.lit(False).alias("is_enabled"), F.lit(False).alias("hires_juniors"))
    out = lifecycle.merge_discovered_boards(known, board_urls(spark, sf), ["co1", "co3"])
    return out.select("ats_type", "ats_slug", "name", "is_enabled", "region_focus")


@query("apply_status", "D8", f"""WITH {sv.SAVED}, ch AS (SELECT saved_id, (['applied', 'offer', 'rejected'])[saved_id % 3 + 1] AS s FROM saved WHERE saved_id % 4 = 0)
  SELECT saved_id, coalesce(s, status) AS status, CASE WHEN s = 'applied' THEN coalesce(applied_at, {AS_OF}) ELSE applied_at END AS applied_at,
  CASE WHEN s IN ('applied', 'offer') THEN {AS_OF} ELSE last_touch_at END AS last_touch_at, CASE WHEN s = 'applied' THEN {AS_OF} + INTERVAL 7 DAY ELSE follow_up_on END AS follow_up_on
  FROM saved LEFT JOIN ch USING (saved_id)""")
def _(spark, sf):
    saved = fx.saved(spark, sf)
    last = saved.filter("saved_id % 4 = 0").select("saved_id", fx.pick(["applied", "offer", "rejected"], C("saved_id") % 3).alias("new_status"), F.lit(2).alias("seq"))
    first = last.select("saved_id", F.lit("saved").alias("new_status"), F.lit(1).alias("seq"))
    return lifecycle.apply_status(saved, first.unionByName(last), NOW).select("saved_id", "status", "applied_at", "last_touch_at", "follow_up_on")


FOLLOW = f"""sent AS (SELECT user_id, 'Follow up: ' || coalesce(saved_title, 'a role') AS notice FROM saved WHERE saved_id % 30 = 0),
f AS (SELECT *, coalesce(saved_title, 'a role') AS t, coalesce(saved_company, 'the company') AS co,
  status = 'applied' AND coalesce(coalesce(applied_at, last_touch_at) <= {AS_OF} - INTERVAL 14 DAY, false) AS ghost FROM saved),
g AS (SELECT *, status = 'applied' AND NOT ghost AND coalesce(follow_up_on <= {AS_OF}, false) AS due FROM f),
h AS (SELECT *, due AND row_number() OVER (PARTITION BY user_id, t, due ORDER BY saved_id) = 1 AND (user_id, 'Follow up: ' || t) NOT IN (SELECT (user_id, notice) FROM sent) AS remind FROM g)"""


def _followups(spark, sf):
    saved = fx.saved(spark, sf)
    sent = saved.filter("saved_id % 30 = 0").select("user_id", F.concat(F.lit("Follow up: "), F.coalesce("saved_title", F.lit("a role"))).alias("title"))
    return lifecycle.followups(saved, sent, NOW)


@query("followups", "D9", f"WITH {sv.SAVED}, {FOLLOW} SELECT saved_id, CASE WHEN ghost THEN 'ghosted' ELSE status END AS status, CASE WHEN ghost THEN {AS_OF} ELSE last_touch_at END AS last_touch_at, CASE WHEN remind THEN {AS_OF} + INTERVAL 7 DAY ELSE follow_up_on END AS follow_up_on FROM h")
def _(spark, sf):
    return _followups(spark, sf)[0].select("saved_id", "status", "last_touch_at", "follow_up_on")


@query("followup_notices", "D9 J5", f"WITH {sv.SAVED}, {FOLLOW} SELECT saved_id, user_id, CASE WHEN ghost THEN 'Marked ghosted: ' || t ELSE 'Follow up: ' || t END AS title, CASE WHEN ghost THEN '/saved' ELSE '/jobs/' || listing_id END AS link FROM h WHERE ghost OR remind")
def _(spark, sf):
    return _followups(spark, sf)[1].select("saved_id", "user_id", "title", "link")


@query("mark_read", "D10", f"WITH {NOTICES} SELECT notification_id, is_read OR user_id % 5 = 0 OR notification_id % 7 = 0 AS is_read FROM notices")
def _(spark, sf):
    n = notices(spark, sf)
    every = n.filter("user_id % 5 = 0").select("user_id", F.lit(None).cast("bigint").alias("notification_id"))
    single = n.filter("notification_id % 7 = 0").select("user_id", "notification_id")
    return lifecycle.mark_read(n, every.unionByName(single)).select("notification_id", "is_read")


TOK = r"'[\pL\p{Nd}]+[+#]*'"
WANTED = """typed AS (SELECT search_id, user_id, name, last_checked_at, q, workplace, greatest(1, least(30, coalesce(TRY_CAST(posted_within AS INT), 7))) AS days, career_stage_wanted, region_wanted, city, country, company, employment, wanted_source, junior_wanted,
  list_filter(list_transform(string_split(coalesce(skills_csv, ''), ','), lambda s: lower(trim(s))), lambda s: s <> '') AS wskills FROM searches WHERE search_on)"""
WORDS = f"""words AS (SELECT id, list_distinct(regexp_extract_all(lower(title || ' ' || company_name || ' ' || array_to_string(skills, ' ') || ' ' || description_text), {TOK})) AS ws FROM enriched)"""
MATCH = f"""m AS (SELECT t.search_id, t.user_id, t.name, t.last_checked_at, e.id, e.title, e.company_name, e.workplace_type, e.first_seen_at,
  row_number() OVER (PARTITION BY t.search_id ORDER BY e.posted_at DESC NULLS LAST, e.first_seen_at DESC, {sv.TRUST}, CASE WHEN e.posted_at IS NULL THEN 1 ELSE 0 END, e.id) AS position
  FROM typed t JOIN (enriched JOIN words USING (id)) e ON e.is_active AND e.anchor >= {AS_OF} - to_days(t.days)
  AND (t.q IS NULL OR list_has_all(e.ws, string_split(t.q, ' '))) AND (t.workplace IS NULL OR e.workplace_type = t.workplace)
  AND (len(t.wskills) = 0 OR list_has_any(e.skills, t.wskills) OR list_has_any(e.tech_tags, t.wskills))
  AND CASE CASE WHEN t.junior_wanted THEN 'junior' ELSE t.career_stage_wanted END WHEN 'junior' THEN e.junior_eligible AND NOT (e.career_stage IN ('junior', 'new_grad') AND coalesce(e.years_required_min >= 4, false)) WHEN 'senior' THEN e.career_stage = 'senior' ELSE true END AND (NOT t.region_wanted OR e.region_friendly)
  AND (t.city IS NULL OR e.location_raw ILIKE '%' || t.city || '%') AND (t.country IS NULL OR e.location_raw ILIKE '%' || t.country || '%')
  AND (t.company IS NULL OR e.company_name ILIKE '%' || t.company || '%') AND (t.employment IS NULL OR e.employment_type ILIKE '%' || t.employment || '%')
  AND (t.wanted_source IS NULL OR e.source = t.wanted_source)
  QUALIFY position <= 20)"""
SENT = "sent AS (SELECT event_id % 7 AS user_id, '/jobs/' || (event_id % 200) AS link FROM events WHERE event_id % 3 = 0)"
NOTES = """n5 AS (SELECT *, '/jobs/' || id AS link FROM m WHERE first_seen_at > last_checked_at QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY position) <= 5),
one AS (SELECT * FROM n5 WHERE (user_id, link) NOT IN (SELECT (user_id, link) FROM sent) QUALIFY row_number() OVER (PARTITION BY user_id, link ORDER BY search_id) = 1)"""
NEWEST_CTES = ", ".join([sv.SEARCHES, WANTED, WORDS, MATCH, SENT, NOTES])
ALERT_CTES = NEWEST_CTES.replace("QUALIFY position <= 20", "")


def _alerts(spark, sf):
    sent = fx.table(spark, sf, "events").filter("event_id % 3 = 0").select((C("event_id") % 7).alias("user_id"), F.concat(F.lit("/jobs/"), (C("event_id") % 200).cast("string")).alias("link"))
    return alerts.saved_search_alerts(fx.saved_searches(spark, sf), fx.stored(spark, sf), sent, NOW)


@query("search_matches", "J11", with_enriched("SELECT search_id, id, position FROM m", NEWEST_CTES))
def _(spark, sf):
    return alerts.search_matches(fx.saved_searches(spark, sf), fx.stored(spark, sf), NOW, look=20)


@query("saved_search_alerts", "D11 J5", with_enriched("SELECT user_id, search_id, 'Pulse: ' || title AS title, name || ': ' || company_name || ' · ' || workplace_type || ' · new catalogue match' AS body, link FROM one", ALERT_CTES))
def _(spark, sf):
    return _alerts(spark, sf)[0].select("user_id", "search_id", "title", "body", "link")


@query("saved_search_checkpoints", "D11", with_enriched(f"SELECT search_id, CASE WHEN search_on THEN {AS_OF} ELSE last_checked_at END AS last_checked_at, CASE WHEN search_id IN (SELECT search_id FROM one) THEN {AS_OF} END AS last_notified_at FROM searches", ALERT_CTES))
def _(spark, sf):
    return _alerts(spark, sf)[1].select("search_id", "last_checked_at", "last_notified_at")


MISSED_E = f"missed AS (SELECT * REPLACE (missed_runs + CAST({MISSED} AS INT) AS missed_runs, is_active AND NOT ({MISSED} AND missed_runs + 1 >= 2) AS is_active) FROM enriched)"
KEEP = f"is_active AND coalesce(rn1, 1) = 1 AND coalesce(rn2, 1) = 1 AND anchor >= {sv.CUTOFF}"


@query("housekeeping", "D12 D2 D3 D4 D5", with_enriched(f"SELECT id, {KEEP} AS is_active, missed_runs FROM w2 WHERE anchor >= {AS_OF} - INTERVAL 21 DAY", MISSED_E + ", " + SURV1.replace("FROM enriched", "FROM missed")))
def _(spark, sf):
    return lifecycle.housekeeping(fx.enriched(spark, sf), OK, SEEN, NOW, DAYS, 21)[0].select("id", "is_active", "missed_runs")


@query("refresh_enrichment", "D13 P9 P14", with_enriched("SELECT id, career_stage, years_required_min, region_friendly FROM enriched"))
def _(spark, sf):
    return lifecycle.refresh_enrichment(fx.listings(spark, sf)).select("id", "career_stage", "years_required_min", "region_friendly")


@query("write_catalogue", "S5", with_listings("SELECT is_active, count(*) AS n FROM listings GROUP BY is_active"))
def _(spark, sf):
    from jobloom.runtime import shared_folder
    from jobloom.sources.sinks import read_catalogue, write_catalogue

    where = shared_folder(spark, "catalogue")
    write_catalogue(current(spark, sf), where)
    return read_catalogue(spark, where).groupBy("is_active").agg(F.count(F.lit(1)).alias("n"))
