"""Saved searches run against the catalogue, many at once."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import seniority, times
from jobloom.functions.enrich import NO_TAGS, clean_tags
from jobloom.functions.text import blank_to_null
from jobloom.operators.ranking import newest_order
from jobloom.operators.percolator import LOOSE, percolate
from jobloom.operators.relations import not_yet_sent
from jobloom.runtime import top_per_key

SEND = 5    # alerts a search may send per run
SLIM = [
    "id", "source", "posted_at", "first_seen_at", "workplace_type", "skills", "tech_tags", "career_stage",
    "junior_eligible", "region_friendly", "location_raw", "company_name", "employment_type",
]
FILTERS = ["w_workplace", "w_skills", "w_days", "w_stage", "w_region", "w_junior", "w_source", *[f"w_{c}" for c in LOOSE]]


def typed_searches(searches: DataFrame) -> DataFrame:
    """Parameters of the searches that are on, as typed columns; a parameter the table lacks asks for nothing."""
    skills = F.split(F.coalesce("skills_csv", F.lit("")), ",")
    said = lambda c: blank_to_null(F.lower(F.trim(c))) if c in searches.columns else F.lit(None).cast("string")
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in searches.columns else F.lit(default)
    return searches.filter(flag("is_active", True)).select(
        "search_id", "user_id", "name", blank_to_null(F.trim("q")).alias("q"), F.lower("workplace").alias("w_workplace"),
        clean_tags(skills).alias("w_skills"), times.clamp_window(F.col("posted_within")).alias("w_days"),
        seniority.asked_stage(F.col("career_stage")).alias("w_stage"), F.col("region_friendly").alias("w_region"), "last_checked_at",
        flag("junior_eligible", False).alias("w_junior"), said("source").alias("w_source"), *[said(c).alias(f"w_{c}") for c in LOOSE],
    )


def fits(as_of) -> Column:
    cutoff = times.minus_days(as_of, F.col("w_days"))
    skills = F.coalesce("w_skills", F.array().cast(NO_TAGS))
    return (
        (times.age_anchor(F.col("posted_at"), F.col("first_seen_at")) >= cutoff)
        & (F.col("w_workplace").isNull() | (F.col("workplace_type") == F.col("w_workplace")))
        & ((F.size(skills) == 0) | F.arrays_overlap("skills", skills) | F.arrays_overlap("tech_tags", skills))
        & seniority.asked_stage_matches(F.col("w_stage"), F.col("w_junior"), F.col("career_stage"), F.col("junior_eligible"))
        & (~F.coalesce("w_region", F.lit(False)) | F.col("region_friendly"))
        & (F.col("w_source").isNull() | (F.col("source") == F.col("w_source")))
        & reduce(and_, [F.col(f"w_{c}").isNull() | F.coalesce(F.lower(F.col(own)).contains(F.col(f"w_{c}")), F.lit(False)) for c, own in LOOSE.items()])
    )


def found_by(asked: DataFrame, listings: DataFrame, as_of, new_only: bool = False) -> DataFrame:
    """search_id, id and ordering columns of the active listings that typed searches match.

    With ``new_only`` a search sees only what came after its last check; the
    test is part of the match, so nothing older is carried along.
    """
    since = F.col("last_checked_at") if new_only else F.lit(None).cast("timestamp")
    keyed = asked.withColumn("since", since).withColumn("kind", F.sha2(F.to_json(F.struct("q", "since", *FILTERS)), 256))
    kinds = keyed.select("kind", "q", "since", *FILTERS).dropDuplicates(["kind"])
    newer = F.col("since").isNull() | (F.coalesce("first_seen_at", "posted_at") > F.col("since"))
    live = listings.filter("is_active")
    found = percolate(kinds, live, SLIM, fits(as_of) & newer).select("kind", "id")
    return found.join(live.select("id", "source", "posted_at", "first_seen_at"), "id").join(keyed.select("search_id", "kind"), "kind")


def search_matches(searches: DataFrame, listings: DataFrame, as_of, look: int | None = None) -> DataFrame:
    """(search_id, id, position) of the newest matches of every search.

    Every match is kept, with position 0, unless ``look`` asks for that many of
    the newest.
    """
    found = found_by(typed_searches(searches), listings, as_of)
    if look:
        return top_per_key(found, ["search_id"], newest_order(), look).select("search_id", "id", "position")
    return found.select("search_id", "id", F.lit(0).alias("position"))


def saved_search_alerts(searches: DataFrame, listings: DataFrame, sent: DataFrame, as_of, send=SEND):
    """(notices, next searches): the newest ``send`` matches of each search that came since its last check."""
    now = times.at(as_of)
    few = top_per_key(found_by(typed_searches(searches), listings, as_of, True), ["search_id"], newest_order(), send, "place").select("search_id", "id")
    few = few.join(searches.select("search_id", "user_id", "name"), "search_id").join(listings.select("id", "title", "company_name", "workplace_type"), "id")
    body = F.concat("name", F.lit(": "), "company_name", F.lit(" · "), "workplace_type", F.lit(" · new catalogue match"))
    notices = few.select(
        "user_id", "search_id", F.concat(F.lit("Pulse: "), "title").alias("title"), body.alias("body"),
        F.concat(F.lit("/jobs/"), F.col("id").cast("string")).alias("link"), F.lit(False).alias("is_read"), now.alias("created_at"),
    )
    # Two searches of one user may find the same listing; the lower one tells.
    one = notices.groupBy("user_id", "link").agg(F.min_by(F.struct("search_id", "title", "body", "is_read", "created_at"), "search_id").alias("n"))
    fresh_ones = not_yet_sent(one.select("user_id", "link", "n.*"), sent)
    told = fresh_ones.select("search_id").distinct().withColumn("_told", F.lit(True))
    on = F.coalesce("is_active", F.lit(True)) if "is_active" in searches.columns else F.lit(True)
    after = searches.join(told, "search_id", "left").withColumns({
        "last_checked_at": F.when(on, now).otherwise(F.col("last_checked_at")), "last_notified_at": F.when(F.col("_told"), now),
    }).drop("_told")
    return fresh_ones, after
