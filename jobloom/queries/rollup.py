"""Inventory, health, landing pages and the joins behind them."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.functions.enrich import clean_tags
from jobloom.operators import dedupe, lifecycle, relations, rollups
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.sql_views import AS_OF, FRESH, any_like, q, with_enriched, with_listings
from jobloom.queries.selections import SURV1, notices, NOTICES

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS


@query("fresh_sources", "G4 F1 D3 W1 W2", with_enriched(f"SELECT source, count(*) AS listings, count(DISTINCT company_name) AS companies FROM w2 WHERE coalesce(rn1, 1) = 1 AND coalesce(rn2, 1) = 1 AND {FRESH} GROUP BY source", SURV1))
def fresh_sources(spark, sf):
    """Fresh, deduplicated listings per source with their companies."""
    return rollups.fresh_by_source(dedupe.suppress_duplicates(fx.enriched(spark, sf)), NOW, DAYS)


@query("inventory", "G1", with_listings(f"""SELECT count(*) AS total_listings, count(*) FILTER (WHERE is_active) AS active_listings, count(*) FILTER (WHERE {FRESH}) AS fresh_listings,
  count(*) FILTER (WHERE is_active AND embedding_provider = 'a') AS embedded_listings, count(DISTINCT source) FILTER (WHERE is_active) AS active_sources,
  count(DISTINCT company_name) FILTER (WHERE is_active) AS indexed_companies FROM listings"""))
def _(spark, sf):
    return rollups.inventory(fx.listings(spark, sf), NOW, DAYS, "a")


@query("inventory_report", "G1", with_listings(f"""SELECT count(*) AS total_listings, count(*) FILTER (WHERE is_active) AS active_listings, count(*) FILTER (WHERE is_active AND anchor >= {AS_OF} - INTERVAL 20 DAY) AS fresh_wide,
  count(*) FILTER (WHERE {FRESH}) AS fresh_narrow, count(*) FILTER (WHERE is_active AND apply_url <> '') AS with_apply, count(*) FILTER (WHERE is_active AND embedding IS NOT NULL) AS embedded,
  count(DISTINCT company_name) FILTER (WHERE is_active) AS companies, count(DISTINCT source) FILTER (WHERE is_active) AS sources FROM listings"""))
def _(spark, sf):
    return rollups.inventory_report(fx.listings(spark, sf), NOW, 20, DAYS)


@query("registry_stats", "G2", f"WITH {sv.REGISTRY} SELECT count(*) FILTER (WHERE is_enabled) AS enabled_companies, count(*) FILTER (WHERE region_focus IN ('pakistan', 'both')) AS region_companies, count(DISTINCT ats_type) FILTER (WHERE is_enabled) AS ats_integrations FROM registry")
def _(spark, sf):
    return rollups.registry_stats(fx.registry(spark, sf))


@query("source_health", "G3 J8", f"WITH {sv.RUNS} SELECT source, max(started_at) AS last_run, arg_max(jobs_fetched, started_at) AS last_fetched, bool_or(errors IS NOT NULL AND errors <> '') FILTER (WHERE started_at > {AS_OF} - INTERVAL 1 DAY) AS had_errors_24h FROM runs GROUP BY source")
def _(spark, sf):
    return rollups.source_health(fx.run_log(spark, sf), NOW)


@query("count_by_source", "G4", with_listings("SELECT source, count(*) AS n FROM listings WHERE is_active GROUP BY source"))
def _(spark, sf):
    return rollups.count_by_source(fx.listings(spark, sf))


def prefixes(spark, sf):
    return fx.table(spark, sf, "part").select(
        C("p_partkey").alias("query_id"), F.when(C("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.left("p_name", F.lit(6))).alias("q"))


PREFIX = "asked AS (SELECT p_partkey AS query_id, lower(CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE left(p_name, 6) END) AS p FROM part)"
TKEY = r"trim(trim(regexp_replace(regexp_replace(title, '(?i)\s*[-|–—]\s*(remote|hybrid|wfh|work from home).*$', ''), '(?i)\s*\((remote|hybrid)\)\s*$', '')))"


@query("title_suggestions", "G5", with_listings(f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cnt DESC, mkey) AS rank, display AS title, cnt AS count
  FROM (SELECT *, {TKEY} AS display, lower({TKEY}) AS mkey FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, mkey ORDER BY cnt DESC, score DESC, low) = 1) QUALIFY rank <= 8""",
    PREFIX + f""", titles AS (SELECT lower(trim(title)) AS low, min(title) AS title, count(*) AS cnt FROM listings WHERE {FRESH} GROUP BY 1),
  hits AS (SELECT query_id, low, title, cnt, CASE WHEN starts_with(low, p) THEN 300 WHEN contains(low, ' ' || p) THEN 150 ELSE 50 END + least(cnt, 80) AS score FROM titles JOIN asked ON contains(low, p))"""))
def _(spark, sf):
    return rollups.title_suggestions(fx.listings(spark, sf), prefixes(spark, sf), NOW, DAYS)


TAG_SLUGS = {"the": "the-words", "and": "the-words", "with": "with-words", "der": "der-words", "python": "python", "react": "react", "java": "java", "cloud": "cloud"}
SLUG_CTE = "dim(tag, slug) AS (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in TAG_SLUGS.items()) + ")"
REMOTE = f"{FRESH} AND workplace_type = 'remote'"


@query("skill_landings", "G6 J14", with_enriched(f"SELECT slug, count(DISTINCT id) AS count, '/remote-' || slug || '-jobs' AS href FROM (SELECT id, unnest(list_concat(skills, tech_tags)) AS tag FROM enriched WHERE {REMOTE}) JOIN dim USING (tag) GROUP BY slug HAVING count(DISTINCT id) >= 4", SLUG_CTE))
def _(spark, sf):
    return rollups.skill_landings(fx.enriched(spark, sf), rollups.landing_dim(spark, TAG_SLUGS), NOW, DAYS, 4)


@query("skill_landing", "G7", with_enriched(f"SELECT 'the-words' AS slug, count(*) AS count FROM enriched WHERE {REMOTE} AND list_has_any(list_concat(skills, tech_tags), ['the', 'and'])"))
def _(spark, sf):
    return rollups.skill_landing(fx.enriched(spark, sf), "the-words", ["the", "and"], NOW, DAYS)


COUNTS = f"counts AS (SELECT company_name, count(*) AS count, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM listings WHERE {FRESH} AND length(company_name) > 1 GROUP BY company_name)"


@query("company_landings", "G8 W7", with_listings("SELECT slug, company_name AS label, count, '/companies/' || slug AS href FROM counts WHERE count >= 5 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY count DESC, company_name) = 1", COUNTS))
def _(spark, sf):
    return rollups.company_landings(fx.listings(spark, sf), NOW, DAYS)


@query("company_landing", "G9 W7", with_listings("SELECT slug, company_name AS label, count FROM counts WHERE slug = 'supplier-000000003' AND count >= 5", COUNTS))
def _(spark, sf):
    return rollups.company_landing(fx.listings(spark, sf), "supplier-000000003", NOW, DAYS)


PLACE = "lower(coalesce(location_raw, '-'))"


def landing_sql(places, base):
    parts = [
        f"SELECT {q(s)} AS slug, {q(l)} AS label, count(*) AS count, {q(base + s)} AS href FROM enriched WHERE {FRESH} AND ({any_like(PLACE, p)}{' OR region_friendly' if r else ''})"
        for s, l, p, r in places]
    return with_enriched("SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE count >= 8")


@query("country_landings", "G10", landing_sql(lx.COUNTRY_LANDINGS, "/remote-jobs/"))
def _(spark, sf):
    return rollups.location_landings(fx.enriched(spark, sf), lx.COUNTRY_LANDINGS, NOW, DAYS)


@query("city_landings", "G10", landing_sql(lx.CITY_LANDINGS, "/remote-jobs/city/"))
def _(spark, sf):
    return rollups.location_landings(fx.enriched(spark, sf), lx.CITY_LANDINGS, NOW, DAYS, city=True)


@query("location_pairs", "J7", with_listings("SELECT DISTINCT id, n_name AS slug FROM listings JOIN nation ON contains(lower(coalesce(location_raw, '')), lower(n_name)) UNION SELECT id, 'lahore' FROM listings WHERE contains(lower(location_raw), 'lahore')"))
def _(spark, sf):
    names = fx.table(spark, sf, "nation").select(C("n_name").alias("slug"), F.lower("n_name").alias("pattern"))
    lahore = fx.table(spark, sf, "nation").filter("n_nationkey = 0").select(F.lit("lahore").alias("slug"), F.lit("lahore").alias("pattern"))
    return rollups.location_pairs(fx.listings(spark, sf), names.unionByName(lahore))


@query("stage_inventory", "G11", with_enriched(f"""SELECT count(*) FILTER (WHERE is_active) AS active_listings, count(*) FILTER (WHERE {FRESH}) AS fresh_listings,
  count(*) FILTER (WHERE {FRESH} AND junior_eligible AND NOT (career_stage IN ('junior', 'new_grad') AND coalesce(years_required_min >= 4, false))) AS junior_eligible_listings,
  count(*) FILTER (WHERE {FRESH} AND career_stage = 'internship') AS internship_listings, count(*) FILTER (WHERE {FRESH} AND career_stage = 'new_grad') AS new_grad_listings FROM enriched"""))
def _(spark, sf):
    return rollups.stage_inventory(fx.enriched(spark, sf), NOW, DAYS)


@query("run_totals", "G12", f"WITH {sv.RUNS} SELECT count(*) AS sources_started, count(*) FILTER (WHERE ok) AS sources_ok, count(*) FILTER (WHERE NOT ok) AS sources_failed, CAST(sum(jobs_fetched) FILTER (WHERE ok) AS BIGINT) AS fetched, CAST(sum(jobs_upserted) FILTER (WHERE ok) AS BIGINT) AS upserted, 'SUCCESS' AS status FROM (SELECT *, coalesce(errors, '') = '' AS ok FROM runs)")
def _(spark, sf):
    return rollups.run_totals(fx.run_log(spark, sf))


@query("append_run_log", "S4", with_listings(f"SELECT source, {AS_OF} AS started_at, count(*) AS jobs_fetched, count(*) FILTER (WHERE id % 3 = 0) AS jobs_upserted, CASE WHEN source = 'lever' THEN repeat('e', 3000) END AS errors FROM listings GROUP BY source"))
def _(spark, sf):
    from jobloom.functions.times import at
    from jobloom.sources.sinks import run_log_rows

    df = fx.listings(spark, sf)
    errors = df.filter("source = 'lever'").select("source").distinct().withColumn("error", F.repeat(F.lit("e"), F.lit(3000)))
    return run_log_rows(df, df.filter("id % 3 = 0"), errors, at(NOW), at(NOW)).drop("finished_at")


@query("sitemap_entries", "S6", with_listings(f"SELECT id, coalesce(posted_at, last_seen_at) AS last_modified FROM listings WHERE {FRESH} AND length(description_text) >= 60 ORDER BY last_modified DESC, id DESC LIMIT 100 OFFSET 100"))
def _(spark, sf):
    from jobloom.sources.export import sitemap_entries

    return sitemap_entries(fx.listings(spark, sf), NOW, DAYS, 2, 100)


# ---- joins -----------------------------------------------------------------

@query("saved_view", "J1", with_listings("""SELECT saved_id, user_id, listing_id, status, coalesce(saved_title, title) AS title, coalesce(saved_company, company_name) AS company, apply_url, id IS NULL AS listing_gone
  FROM saved LEFT JOIN listings ON id = listing_id""", sv.SAVED))
def _(spark, sf):
    return relations.saved_view(fx.saved(spark, sf), fx.listings(spark, sf))


@query("with_company", "J2", with_listings("SELECT id, ats_type, name AS company_name, website AS company_url FROM (SELECT id, source AS ats_type, 'board-' || (id % 60) AS ats_slug FROM listings) JOIN registry USING (ats_type, ats_slug) WHERE is_enabled", sv.REGISTRY))
def _(spark, sf):
    feed = fx.listings(spark, sf).select("id", C("source").alias("ats_type"), F.concat(F.lit("board-"), (C("id") % 60).cast("string")).alias("ats_slug"))
    return relations.with_company(feed, fx.registry(spark, sf)).select("id", "ats_type", "company_name", "company_url")


REG_CLEAN = """clean AS (SELECT ats_type, ats_slug, coalesce(nullif(name, ''), ats_slug) AS name, website, coalesce(region_focus, 'global') AS region_focus, is_enabled, false AS hires_juniors
  FROM registry WHERE ats_type <> '' AND ats_slug <> '' QUALIFY row_number() OVER (PARTITION BY ats_type, ats_slug ORDER BY seq DESC) = 1)"""


@query("load_registry", "S3", f"WITH {sv.REGISTRY}, {REG_CLEAN} SELECT * FROM clean")
def _(spark, sf):
    return lifecycle.load_registry(fx.registry(spark, sf))


@query("flag_known_names", "J3", f"WITH {sv.REGISTRY}, {REG_CLEAN} SELECT ats_type, ats_slug, name, lower(name) IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 5 = 0) AS hires_juniors FROM clean")
def _(spark, sf):
    known = fx.table(spark, sf, "supplier").filter("s_suppkey % 5 = 0").select(F.upper("s_name").alias("name"))
    return lifecycle.load_registry(fx.registry(spark, sf), known).select("ats_type", "ats_slug", "name", "hires_juniors")


@query("drop_applied", "J4", f"WITH {sv.SAVED} SELECT o_custkey AS user_id, o_orderkey % 100 AS listing_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = o_custkey AND s.listing_id = o_orderkey % 100 AND s.status IN ('applied', 'interview', 'offer', 'ghosted'))")
def _(spark, sf):
    pairs = fx.table(spark, sf, "orders").select(C("o_custkey").alias("user_id"), (C("o_orderkey") % 100).alias("listing_id"))
    return relations.drop_applied(pairs, fx.saved(spark, sf))


@query("append_notifications", "J5 S8", f"WITH {NOTICES} SELECT DISTINCT user_id, link FROM notices WHERE notification_id % 3 = 0 AND (user_id, link) NOT IN (SELECT (user_id, link) FROM notices WHERE notification_id % 3 = 1)")
def _(spark, sf):
    n = notices(spark, sf)
    return relations.not_yet_sent(n.filter("notification_id % 3 = 0"), n.filter("notification_id % 3 = 1")).select("user_id", "link")


@query("with_tag", "J6", with_enriched("SELECT id, source FROM enriched WHERE list_has_any(list_concat(skills, tech_tags), ['python', 'le', 'el'])"))
def _(spark, sf):
    asked = fx.table(spark, sf, "nation").filter("n_nationkey < 3").select(fx.pick(["python", "le", "el"], C("n_nationkey")).alias("tag"))
    return relations.with_tag(fx.enriched(spark, sf), asked).select("id", "source")


@query("rehydrate", "J9", with_listings("SELECT id, title, vec_id % 7 + 0.0 AS score FROM embeddings JOIN listings ON id = vec_id"))
def _(spark, sf):
    ranked = fx.table(spark, sf, "embeddings").select(C("vec_id").alias("id"), (C("vec_id") % 7).cast("double").alias("score"))
    return relations.rehydrate(ranked, fx.listings(spark, sf), ["title"])


@query("gap_paths", "J13", with_enriched(f"""SELECT id, gap, coalesce(CASE {' '.join(f"WHEN contains(gap, {q(k)}) THEN {q(l)}" for k, l in lx.LEARNING_PATHS)} END, 'Core software skills') AS path FROM (SELECT id, unnest(list_concat(skills, tech_tags)) AS gap FROM enriched)"""))
def _(spark, sf):
    gaps = fx.enriched(spark, sf).select("id", F.explode(F.array_distinct(F.concat(clean_tags(C("skills")), clean_tags(C("tech_tags"))))).alias("gap"))
    return relations.gap_paths(gaps, relations.learning_paths(spark))


@query("with_profile", "J15", f"WITH {sv.PROFILES} SELECT c_custkey AS user_id, experience_level FROM customer LEFT JOIN (SELECT * FROM profiles WHERE user_id % 4 <> 0) ON user_id = c_custkey")
def _(spark, sf):
    users = fx.table(spark, sf, "customer").select(C("c_custkey").alias("user_id"))
    return relations.with_profile(users, fx.profiles(spark, sf).filter("user_id % 4 <> 0")).select("user_id", "experience_level")
