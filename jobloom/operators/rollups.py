"""Inventory, health and landing-page aggregates."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom import lexicons as lx
from jobloom.functions import times
from jobloom.functions.enrich import any_of, clean_tags
from jobloom.functions.text import slugify, squash, text, title_key
from jobloom.operators.containment import holding
from jobloom.operators.filters import fresh, has_any_tag, in_window
from jobloom.runtime import broadcast_if_small, earliest, top_per_key


def _distinct(column: str, when: Column, exact: bool) -> Column:
    value = F.when(when, F.col(column))
    return F.count_distinct(value) if exact else F.approx_count_distinct(value)


def inventory(df: DataFrame, as_of, days, provider: str, exact: bool = True) -> DataFrame:
    live, recent = F.col("is_active"), F.col("is_active") & in_window(as_of, days)
    embedded = live & F.col("embedding").isNotNull() & (F.col("embedding_provider") == provider)
    return df.agg(
        F.count(F.lit(1)).alias("total_listings"), F.count_if(live).alias("active_listings"),
        F.count_if(recent).alias("fresh_listings"), F.count_if(embedded).alias("embedded_listings"),
        _distinct("source", live, exact).alias("active_sources"),
        _distinct("company_name", live, exact).alias("indexed_companies"),
    )


def inventory_report(df: DataFrame, as_of, wide: int, narrow: int) -> DataFrame:
    live = F.col("is_active")
    return df.agg(
        F.count(F.lit(1)).alias("total_listings"), F.count_if(live).alias("active_listings"),
        F.count_if(live & in_window(as_of, wide)).alias("fresh_wide"),
        F.count_if(live & in_window(as_of, narrow)).alias("fresh_narrow"),
        F.count_if(live & (F.length("apply_url") > 0)).alias("with_apply"),
        F.count_if(live & F.col("embedding").isNotNull()).alias("embedded"),
        _distinct("company_name", live, True).alias("companies"), _distinct("source", live, True).alias("sources"),
    )


def registry_stats(registry: DataFrame, regions=("pakistan", "both")) -> DataFrame:
    on = F.col("is_enabled")
    return registry.agg(
        F.count_if(on).alias("enabled_companies"), F.count_if(F.col("region_focus").isin(list(regions))).alias("region_companies"),
        F.count_distinct(F.when(on, F.col("ats_type"))).alias("ats_integrations"),
    )


def source_health(runs: DataFrame, as_of) -> DataFrame:
    """Newest run per source in one pass, and any error in the last day."""
    recent = F.col("started_at") > times.minus_days(as_of, 1)
    failed = F.length(F.coalesce("errors", F.lit(""))) > 0
    newest = F.max(F.struct("started_at", "jobs_fetched"))
    return runs.groupBy("source").agg(
        newest.alias("_newest"), F.bool_or(F.when(recent, failed)).alias("had_errors_24h")
    ).select("source", F.col("_newest.started_at").alias("last_run"), F.col("_newest.jobs_fetched").alias("last_fetched"), "had_errors_24h")


def count_by_source(df: DataFrame) -> DataFrame:
    return df.filter("is_active").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def fresh_by_source(df: DataFrame, as_of, days) -> DataFrame:
    return fresh(df, as_of, days).groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), F.count_distinct("company_name").alias("companies")
    )


def stage_inventory(df: DataFrame, as_of, days) -> DataFrame:
    recent = F.col("is_active") & in_window(as_of, days)
    return df.agg(
        F.count_if("is_active").alias("active_listings"), F.count_if(recent).alias("fresh_listings"),
        F.count_if(recent & F.col("junior_eligible")).alias("junior_eligible_listings"),
        F.count_if(recent & (F.col("career_stage") == "internship")).alias("internship_listings"),
        F.count_if(recent & (F.col("career_stage") == "new_grad")).alias("new_grad_listings"),
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Totals of a run; it failed only if sources started and none came through."""
    ok = F.length(F.coalesce("errors", F.lit(""))) == 0
    totals = runs.agg(
        F.count(F.lit(1)).alias("sources_started"), F.count_if(ok).alias("sources_ok"), F.count_if(~ok).alias("sources_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("jobs_fetched"))), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum(F.when(ok, F.col("jobs_upserted"))), F.lit(0)).alias("upserted"),
    )
    failed = (F.col("sources_started") > 0) & (F.col("sources_ok") == 0)
    return totals.withColumn("status", F.when(failed, "FAILED").otherwise("SUCCESS"))


def embed_pass_stats(result: DataFrame) -> DataFrame:
    """Outcome of an embedding pass from its row outcomes (``outcome`` column)."""
    n = lambda v: F.count_if(F.col("outcome") == v)
    stats = result.agg(
        F.count(F.lit(1)).alias("candidates"), n("processed").alias("processed"), n("skipped").alias("skipped"),
        n("failed").alias("failed"), F.count_if(F.col("outcome").isin("failed", "deferred")).alias("remaining"),
    )
    status = F.when(F.col("failed") == 0, "SUCCESS").when(F.col("processed") > 0, "PARTIAL").otherwise("FAILED")
    return stats.withColumn("status", status)


def title_suggestions(df: DataFrame, prefixes: DataFrame, as_of, days, limit: int = 8) -> DataFrame:
    """Title completions for many prefixes at once.

    Distinct titles meet the distinct prefixes on the rarest three characters
    of each; titles that are shown alike are merged over all hits, the best
    stay, and whoever asks for a prefix gets its list.
    """
    shown = F.when(F.length(title_key(F.col("title"))) > 0, title_key(F.col("title"))).otherwise(F.trim("title"))
    titles = fresh(df, as_of, days).groupBy(F.lower(F.trim("title")).alias("value")).agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("cnt"))
    titles = titles.withColumn("display", shown).withColumn("mkey", F.lower("display")).filter(F.length("mkey") >= 3)
    asked = prefixes.select("query_id", F.lower(squash(F.col("q"))).alias("word")).filter(F.length("word") >= 2)
    met = holding(titles.select("value"), asked.select("word").distinct()).join(titles, "value")
    grade = F.when(F.col("value").startswith(F.col("word")), 300).when(F.col("value").contains(F.concat(F.lit(" "), "word")), 150).otherwise(50)
    scored = met.withColumn("score", grade + F.least("cnt", F.lit(80)))
    merged = earliest(scored.withColumns({"ncnt": -F.col("cnt"), "nscore": -F.col("score")}), ["word", "mkey"], [F.col("ncnt"), F.col("nscore"), F.col("value")], ["display", "cnt", "score"])
    best = top_per_key(merged, ["word"], [F.desc("score"), F.desc("cnt"), F.asc("mkey")], limit, "rank")
    return asked.join(best, "word").select("query_id", "rank", F.col("display").alias("title"), F.col("cnt").alias("count"))


def landing_dim(spark, table: dict | None = None) -> DataFrame:
    """tag -> landing slug: a fixed table of a few dozen rows."""
    rows = sorted((table or lx.SKILL_LANDING_SLUGS).items())
    return spark.createDataFrame(rows, "tag string, slug string")


def _remote(df: DataFrame) -> DataFrame:
    return df.filter(F.lower(F.coalesce("workplace_type", F.lit(""))) == "remote")


def tag_to_landing(df: DataFrame, dim: DataFrame) -> DataFrame:
    """(id, slug) for every tag of a listing that has a landing page."""
    tags = F.explode(F.array_distinct(F.concat(clean_tags(F.col("skills")), clean_tags(F.col("tech_tags")))))
    return df.select("id", tags.alias("tag")).join(broadcast_if_small(dim), "tag").select("id", "slug").distinct()


def skill_landings(df: DataFrame, dim: DataFrame, as_of, days, minimum: int = lx.MIN_SKILL_LISTINGS) -> DataFrame:
    """Remote listings per landing, counted once each however many tags match."""
    pages = tag_to_landing(_remote(fresh(df, as_of, days)), dim)
    counts = pages.groupBy("slug").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") >= minimum).withColumn("href", F.concat(F.lit("/remote-"), "slug", F.lit("-jobs")))


def skill_landing(df: DataFrame, slug: str, tags, as_of, days) -> DataFrame:
    """One landing; a filter decides membership, so nothing is exploded."""
    live = _remote(fresh(df, as_of, days)).filter(has_any_tag(tags))
    return live.agg(F.count(F.lit(1)).alias("count")).select(F.lit(slug).alias("slug"), "count")


def company_counts(df: DataFrame, as_of, days) -> DataFrame:
    live = fresh(df, as_of, days).filter(F.length("company_name") > 1)
    return live.groupBy("company_name").agg(F.count(F.lit(1)).alias("count")).withColumn("slug", slugify(F.col("company_name")))


def first_per_slug(counts: DataFrame) -> DataFrame:
    """The largest company of each slug, name order on a tie."""
    ranked = counts.withColumn("_less", -F.col("count"))
    best = earliest(ranked, ["slug"], [F.col("_less"), F.col("company_name")], ["company_name", "count"])
    return best.select("slug", F.col("company_name").alias("label"), "count")


def company_landings(df: DataFrame, as_of, days, minimum: int = lx.MIN_COMPANY_LISTINGS) -> DataFrame:
    big = company_counts(df, as_of, days).filter(F.col("count") >= minimum)
    return first_per_slug(big).withColumn("href", F.concat(F.lit("/companies/"), "slug"))


def company_landing(df: DataFrame, slug: str, as_of, days, minimum: int = lx.MIN_COMPANY_LISTINGS) -> DataFrame:
    named = first_per_slug(company_counts(df, as_of, days).filter(F.col("slug") == slug))
    return named.filter(F.col("count") >= minimum)


def place_matches(df: DataFrame, places) -> Column:
    """Slugs of all places a row belongs to, tested in one pass over the row."""
    low = F.lower(F.coalesce("location_raw", F.lit("")))
    tests = []
    for slug, _, patterns, region in places:
        hit = any_of([low.contains(p) for p in patterns])
        tests.append(F.when(hit | F.col("region_friendly") if region else hit, F.lit(slug)))
    return F.array_compact(F.array(*tests))


def location_landings(df: DataFrame, places, as_of, days, city: bool = False, minimum: int = lx.MIN_LOCATION_LISTINGS) -> DataFrame:
    """All places from one scan; a row adds at most one to each place."""
    rows = fresh(df, as_of, days)
    slugs = rows.select(F.explode(place_matches(rows, places)).alias("slug"))
    counts = slugs.groupBy("slug").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= minimum)
    label = F.lit(None).cast("string")
    for slug, shown, *_ in places:
        label = F.when(F.col("slug") == slug, F.lit(shown)).otherwise(label)
    base = "/remote-jobs/city/" if city else "/remote-jobs/"
    return counts.select("slug", label.alias("label"), "count", F.concat(F.lit(base), "slug").alias("href"))


def location_pairs(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """listing x place pattern by containment; distinct places meet the patterns once."""
    rows = df.select("id", F.lower(text(F.col("location_raw"))).alias("value"))
    held = holding(rows.select("value").distinct(), patterns.select(F.col("pattern").alias("word")).distinct())
    named = held.join(patterns.select(F.col("pattern").alias("word"), "slug"), "word").select("value", "slug").distinct()
    return rows.join(broadcast_if_small(named), "value").select("id", "slug").distinct()


def description_audit(df: DataFrame, encoded: Column, junk: Column, leaked: Column, changed: Column) -> DataFrame:
    return df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(encoded).alias("encoded_before"),
        F.count_if(junk).alias("junk_before"), F.count_if(leaked).alias("leaked_before"),
        F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged"),
    )
