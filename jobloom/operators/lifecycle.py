"""Catalogue changes: each takes a snapshot and returns the next one."""

from pyspark.sql import DataFrame, Observation, functions as F

from jobloom import lexicons as lx
from jobloom.functions import enrich, seniority, times, urls
from jobloom.functions.text import blank_to_null, text
from jobloom.operators.dedupe import suppress_duplicates
from jobloom.operators.filters import age_anchor, is_stale
from jobloom.runtime import broadcast_if_small

# Columns whose change makes a row count as rewritten.
CONTENT = ["title", "company_name", "description_text", "skills", "career_stage", "workplace_type"]
# Columns always taken from the incoming row.
REPLACED = [
    "title", "company_name", "company_url", "career_page_url", "apply_url", "location_raw",
    "workplace_type", "region_friendly", "employment_type", "career_stage", "years_required_min",
    "junior_eligible", "seniority_signals", "skills", "tech_tags",
]


def clip_row(df: DataFrame) -> DataFrame:
    """Length limits of a store that has them; nothing in this library calls it by itself."""
    sizes = {
        "title": 500, "company_name": 240, "location_raw": 480, "employment_type": 60, "external_id": 240,
        "apply_url": 2000, "company_url": 1000, "career_page_url": 1000, "workplace_type": 32,
    }
    clipped = {c: F.left(F.col(c), F.lit(n)) for c, n in sizes.items() if c in df.columns}
    clipped |= {c: F.slice(c, 1, 40) for c in ("skills", "tech_tags") if c in df.columns}
    return df.withColumns(clipped)


def upsert(current: DataFrame, batch: DataFrame, as_of, stamp: str | None = None) -> DataFrame:
    """Next snapshot after inserting or updating by (source, external_id).

    One full outer join on the unique key; the key is a listing's own, so it
    cannot be hot.  Old text and vector hash survive unless content changed;
    columns that the batch lacks keep their stored value.  With ``stamp``, a
    column of the batch, each row carries its own time, and a row older than
    the stored one changes nothing.
    """
    now = F.col(f"n.{stamp}") if stamp else times.at(as_of)
    c, n = current.alias("c"), batch.alias("n")
    both = c.join(n, [F.col("c.source") == F.col("n.source"), F.col("c.external_id") == F.col("n.external_id")], "full_outer")
    seen, old = F.col("n.external_id").isNotNull(), F.col("c.external_id").isNotNull()
    if stamp:
        seen = seen & ~F.coalesce(F.col("c.last_seen_at") > now, F.lit(False))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"n.{x}")) for x in CONTENT if x in batch.columns]
    changed = ~same[0]
    for s in same[1:]:
        changed = changed | ~s

    def value(x):
        stored = F.col(f"c.{x}")
        if x not in batch.columns:
            made_id = F.xxhash64(F.col("n.source"), F.col("n.external_id"))
            fresh_value = {"id": made_id, "is_active": F.lit(True), "missed_runs": F.lit(0)}.get(x)
            fresh_value = F.lit(None).cast(current.schema[x].dataType) if fresh_value is None else fresh_value
        else:
            fresh_value = F.col(f"n.{x}")
        if x == "first_seen_at":
            return F.when(old, stored).otherwise(now)
        if x in ("source", "external_id", "id"):
            return F.when(old, stored).otherwise(fresh_value)
        if x in ("last_seen_at", "updated_at"):
            return F.when(seen, now).otherwise(stored)
        if x == "is_active":
            return F.when(seen, F.lit(True)).otherwise(stored)
        if x == "missed_runs":
            return F.when(seen, F.lit(0)).otherwise(stored)
        if x == "posted_at":
            return F.coalesce(F.when(seen, fresh_value), stored)
        if x in ("description_text", "description_html"):
            return F.when(seen & (~old | changed), fresh_value).otherwise(stored) if x in batch.columns else stored
        if x == "embedding_hash":
            return F.when(seen & (~old | changed), F.lit(None).cast("string")).otherwise(stored)
        if x in REPLACED and x in batch.columns:
            return F.when(seen, fresh_value).otherwise(stored)
        if x in REPLACED:
            return F.when(old, stored).otherwise(fresh_value)
        return stored

    return both.select(*[value(x).alias(x) for x in current.columns])


def mark_missed(df: DataFrame, ok_sources, seen_after, limit: int = 2) -> DataFrame:
    """Count a miss for rows a successful source no longer lists."""
    missed = F.col("is_active") & F.col("source").isin(list(ok_sources)) & (F.col("last_seen_at") < times.at(seen_after))
    misses = F.when(missed, F.col("missed_runs") + 1).otherwise(F.col("missed_runs"))
    return df.withColumns({"missed_runs": misses, "is_active": F.col("is_active") & ~(missed & (misses >= limit))})


def expire(df: DataFrame, as_of, days) -> DataFrame:
    return df.withColumn("is_active", F.col("is_active") & ~is_stale(as_of, days))


def purge(df: DataFrame, as_of, days) -> DataFrame:
    return df.filter(~is_stale(as_of, days))


def detach_saved(saved: DataFrame, remaining: DataFrame) -> DataFrame:
    """Saved rows keep their snapshot; a vanished listing becomes NULL."""
    alive = remaining.select(F.col("id").alias("listing_id"), F.lit(True).alias("_alive"))
    joined = saved.join(alive, "listing_id", "left")
    return joined.withColumn("listing_id", F.when(F.col("_alive"), F.col("listing_id"))).drop("_alive")


def housekeeping(df: DataFrame, ok_sources, seen_after, as_of, expire_days, purge_days):
    """Misses, duplicates, expiry and purge in order; counts are observed.

    Returns the snapshot and an ``Observation`` that fills when it is written.
    """
    was = F.col("_was")
    step = mark_missed(df.withColumn("_was", F.col("is_active")), ok_sources, seen_after)
    step = step.withColumn("_unseen", was & ~F.col("is_active"))
    step = suppress_duplicates(step)
    step = step.withColumn("_expired", F.col("is_active") & is_stale(as_of, expire_days))
    step = step.withColumn("is_active", F.col("is_active") & ~F.col("_expired"))
    step = step.withColumn("_purged", is_stale(as_of, purge_days))
    seen = Observation("housekeeping")
    step = step.observe(
        seen, F.count_if("_unseen").alias("unseen"), F.count_if(F.col("dup_link") | F.col("dup_title")).alias("duplicates"),
        F.count_if("_expired").alias("expired"), F.count_if("_purged").alias("purged"),
    )
    kept = step.filter("not _purged").drop("_was", "_unseen", "_expired", "_purged", "dup_link", "dup_title")
    return kept, seen


def refresh_enrichment(df: DataFrame) -> DataFrame:
    """Recompute the derived columns of stored rows."""
    df = seniority.classify(df)
    return df.withColumn(
        "region_friendly",
        enrich.region_friendly(F.col("workplace_type"), F.col("location_raw"), F.col("description_text")),
    )


# ---- registry --------------------------------------------------------------

def load_registry(df: DataFrame, known_names: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Clean registry rows: typed, last per board, with defaults."""
    kind, slug = F.trim(text(F.col("ats_type"))), F.trim(text(F.col("ats_slug")))
    rows = df.withColumns({"_kind": kind, "_slug": slug}).filter("_kind <> '' and _slug <> ''")
    row = F.struct(*[F.col(c) for c in df.columns])
    last = rows.groupBy("_kind", "_slug").agg(F.max_by(row, F.col(seq)).alias("r"))
    name = F.coalesce(blank_to_null(F.col("r.name")), F.col("_slug"))
    optional = lambda c: F.col(f"r.{c}") if c in df.columns else F.lit(None)
    out = last.select(
        F.col("_kind").alias("ats_type"), F.col("_slug").alias("ats_slug"),
        name.alias("name"), blank_to_null(F.col("r.website")).alias("website"),
        F.coalesce(blank_to_null(F.col("r.region_focus")), F.lit("global")).alias("region_focus"),
        F.coalesce(F.col("r.is_enabled"), F.lit(True)).alias("is_enabled"),
        F.coalesce(optional("hires_juniors").cast("boolean"), F.lit(False)).alias("hires_juniors"),
    )
    return flag_known_names(out, known_names) if known_names is not None else out


def flag_known_names(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Registry rows whose name is on the list hire juniors."""
    known = names.select(F.lower(F.trim("name")).alias("_n")).distinct().withColumn("_known", F.lit(True))
    joined = registry.join(broadcast_if_small(known), F.lower(F.trim(registry["name"])) == F.col("_n"), "left")
    return joined.withColumn("hires_juniors", F.col("hires_juniors") | F.coalesce("_known", F.lit(False))).drop("_n", "_known")


def upsert_registry(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming boards replace stored ones field by field; others stay."""
    keys = ["ats_type", "ats_slug"]
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("n"))
    both = current.join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)) if c in incoming.columns else F.col(c)
    return both.select(*keys, *[pick(c).alias(c) for c in current.columns if c not in keys])


def merge_discovered_boards(registry: DataFrame, links: DataFrame, region_slugs=()) -> DataFrame:
    """Boards found in links: unknown ones join, known ones are re-enabled.

    ``links`` has name, website and url.  The region only ever widens.
    """
    found = links.withColumn("_ref", urls.board_ref(F.col("url"))).filter("_ref is not null").select(
        F.col("_ref.ats_type").alias("ats_type"), F.lower("_ref.ats_slug").alias("_key"),
        F.struct("url", F.col("_ref.ats_slug").alias("slug"), "name", "website").alias("r"),
    )
    found = found.groupBy("ats_type", "_key").agg(F.min("r").alias("r"))
    stored = registry.withColumn("_key", F.lower("ats_slug")).withColumn("_stored", F.lit(True))
    both = stored.join(found, ["ats_type", "_key"], "full_outer")
    known, hit = F.col("_stored").isNotNull(), F.col("r").isNotNull()
    local = hit & F.col("_key").isin(list(region_slugs)) if region_slugs else F.lit(False)
    return both.select(
        "ats_type", F.coalesce("ats_slug", "r.slug").alias("ats_slug"),
        F.when(known, F.col("name")).otherwise(F.coalesce(blank_to_null(F.col("r.name")), F.col("r.slug"))).alias("name"),
        F.when(known, F.col("website")).otherwise(F.col("r.website")).alias("website"),
        F.when(local, "both").otherwise(F.coalesce("region_focus", F.lit("global"))).alias("region_focus"),
        F.when(hit, F.lit(True)).otherwise(F.col("is_enabled")).alias("is_enabled"),
        F.coalesce("hires_juniors", F.lit(False)).alias("hires_juniors"),
    )


# ---- applications ----------------------------------------------------------

def apply_status(saved: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Apply the latest requested status per saved row."""
    now = times.at(as_of)
    asked = changes.groupBy("saved_id").agg(F.max_by("new_status", "seq").alias("new_status"))
    df = saved.join(asked, "saved_id", "left")
    new = F.coalesce("new_status", F.lit(""))
    return df.withColumns({
        "status": F.coalesce("new_status", "status"),
        "applied_at": F.when(new == "applied", F.coalesce("applied_at", now)).otherwise(F.col("applied_at")),
        "last_touch_at": F.when(new.isin("applied", "interview", "offer"), now).otherwise(F.col("last_touch_at")),
        "follow_up_on": F.when(new == "applied", times.plus_days(now, lx.FOLLOW_UP_DAYS)).otherwise(F.col("follow_up_on")),
    }).drop("new_status")


def _application_name():
    return (
        F.coalesce(blank_to_null(F.col("saved_title")), F.lit("a role")),
        F.coalesce(blank_to_null(F.col("saved_company")), F.lit("the company")),
    )


def followups(saved: DataFrame, notifications: DataFrame, as_of):
    """(next saved rows, new notifications) for applications without an answer.

    A reminder is sent once per (user, title); within one run the first saved
    row sends it and the others are left as they were.
    """
    now = times.at(as_of)
    title, company = _application_name()
    applied = F.coalesce("applied_at", "last_touch_at")
    open_row = F.col("status") == "applied"
    ghost = open_row & F.coalesce(applied <= times.minus_days(as_of, lx.GHOSTED_DAYS), F.lit(False))
    due = open_row & ~ghost & F.coalesce(F.col("follow_up_on") <= now, F.lit(False))
    base = saved.withColumns({
        "_ghost": ghost, "_due": due, "_notice": F.concat(F.lit("Follow up: "), title),
        "_title": title, "_company": company,
    })
    sent = notifications.select("user_id", F.col("title").alias("_notice")).distinct()
    first = base.filter("_due").groupBy("user_id", "_notice").agg(F.min("saved_id").alias("saved_id"))
    remind = first.join(sent, ["user_id", "_notice"], "left_anti").select("saved_id", F.lit(True).alias("_remind"))
    base = base.join(remind, "saved_id", "left").withColumn("_remind", F.coalesce("_remind", F.lit(False)))
    after = base.withColumns({
        "status": F.when(F.col("_ghost"), "ghosted").otherwise(F.col("status")),
        "last_touch_at": F.when(F.col("_ghost"), now).otherwise(F.col("last_touch_at")),
        "follow_up_on": F.when(F.col("_remind"), times.plus_days(now, lx.FOLLOW_UP_DAYS)).otherwise(F.col("follow_up_on")),
    }).select(*saved.columns)
    ghost_body = F.concat("_company", F.lit(": no answer in two weeks. Change the status if there was one."))
    due_body = F.concat("_company", F.lit(": a week since you applied. Write them a few lines yourself if you like."))
    link = F.when(F.col("_remind") & F.col("listing_id").isNotNull(), F.concat(F.lit("/jobs/"), F.col("listing_id").cast("string"))).otherwise("/saved")
    notices = base.filter("_ghost or _remind").select(
        "user_id", "saved_id",
        F.when(F.col("_ghost"), F.concat(F.lit("Marked ghosted: "), "_title")).otherwise(F.col("_notice")).alias("title"),
        F.when(F.col("_ghost"), ghost_body).otherwise(due_body).alias("body"), link.alias("link"),
        F.lit(False).alias("is_read"), now.alias("created_at"),
    )
    return after, notices


def mark_read(notifications: DataFrame, requests: DataFrame) -> DataFrame:
    """Mark read by (user, notification); a NULL id means all of the user's."""
    everything = requests.filter("notification_id is null").select("user_id").distinct().withColumn("_all", F.lit(True))
    single = requests.filter("notification_id is not null").select("user_id", "notification_id").distinct().withColumn("_one", F.lit(True))
    df = notifications.join(everything, "user_id", "left").join(single, ["user_id", "notification_id"], "left")
    return df.withColumn("is_read", F.col("is_read") | F.coalesce("_all", F.lit(False)) | F.coalesce("_one", F.lit(False))).drop("_all", "_one")
