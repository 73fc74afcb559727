"""Joins between the catalogue, its readers and its small dimensions."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom import lexicons as lx
from jobloom.functions.enrich import NO_TAGS, clean_tags
from jobloom.functions.text import blank_to_null
from jobloom.operators.containment import holding
from jobloom.runtime import broadcast_if_small, union_all


def saved_view(saved: DataFrame, listings: DataFrame) -> DataFrame:
    """Saved rows with their listing; the snapshot wins over the live row."""
    live = listings.select(F.col("id").alias("listing_id"), "title", "company_name", "apply_url", F.lit(True).alias("_live"))
    j = saved.join(live, "listing_id", "left")
    some = lambda c: blank_to_null(F.col(c))
    return j.select(
        "saved_id", "user_id", "listing_id", "status", F.coalesce(some("saved_title"), "title").alias("title"),
        F.coalesce(some("saved_company"), "company_name").alias("company"),
        F.coalesce(some("saved_url"), "apply_url").alias("apply_url"), F.col("_live").isNull().alias("listing_gone"),
    )


def with_company(feed: DataFrame, registry: DataFrame) -> DataFrame:
    """Feed rows of enabled boards, with the company's name and site."""
    boards = registry.filter("is_enabled and ats_slug is not null").select(
        "ats_type", "ats_slug", F.col("name").alias("company_name"), F.col("website").alias("company_url")
    )
    return feed.join(broadcast_if_small(boards), ["ats_type", "ats_slug"])


def drop_applied(listings: DataFrame, saved: DataFrame) -> DataFrame:
    """Anti join: (user, listing) pairs the user has already acted on."""
    done = saved.filter(F.col("status").isin(lx.APPLIED_STATUSES) & F.col("listing_id").isNotNull())
    return listings.join(done.select("user_id", "listing_id"), ["user_id", "listing_id"], "left_anti")


def not_yet_sent(notices: DataFrame, sent: DataFrame) -> DataFrame:
    """New notices per (user, link), once each within the batch as well."""
    return notices.join(sent.select("user_id", "link"), ["user_id", "link"], "left_anti").dropDuplicates(["user_id", "link"])


def with_tag(df: DataFrame, tags: DataFrame) -> DataFrame:
    """Semi join: listings holding any tag of a table of tags."""
    exploded = df.select("id", F.explode(F.concat(clean_tags(F.col("skills")), clean_tags(F.col("tech_tags")))).alias("tag"))
    hit = exploded.join(broadcast_if_small(tags.select("tag").distinct()), "tag", "left_semi").select("id").distinct()
    return df.join(hit, "id", "left_semi")


def rehydrate(ranked: DataFrame, listings: DataFrame, columns) -> DataFrame:
    """Ranked ids back to rows; ids with no row are dropped."""
    return listings.select("id", *columns).join(broadcast_if_small(ranked), "id")


def with_profile(users: DataFrame, profiles: DataFrame) -> DataFrame:
    return users.join(profiles, "user_id", "left")


def learning_paths(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, k, label) for i, (k, label) in enumerate(lx.LEARNING_PATHS)], "path_order int, path_key string, path_label string"
    )


def skill_gaps(listing_tags: Column, have: Column) -> Column:
    return F.array_sort(F.array_except(listing_tags, clean_tags(have)))


def all_tags(skills: Column, tech_tags: Column) -> Column:
    return F.array_distinct(F.concat(clean_tags(skills), clean_tags(tech_tags)))


def learning_path(gaps: Column, paths=tuple(lx.LEARNING_PATHS)) -> Column:
    """(skill, path) of the first gap that has a path, else the default.

    The catalogue is a handful of fixed rows, so it is matched inside the row
    and no gap list has to be exploded and regrouped.
    """
    empty = F.lit(None).cast("string")

    def path_of(gap):
        squeezed = F.regexp_replace(gap, r"[^a-z0-9]+", "")
        label = empty
        for key, shown in reversed(paths):
            label = F.when(gap.contains(key) | (squeezed == key), F.lit(shown)).otherwise(label)
        return label

    pairs = F.filter(
        F.transform(gaps, lambda g: F.struct(g.alias("skill"), path_of(F.lower(g)).alias("path"))),
        lambda p: p["path"].isNotNull(),
    )
    default = F.struct(
        F.coalesce(F.try_element_at(gaps, F.lit(1)), F.lit("core")).alias("skill"), F.lit(lx.LEARNING_PATH_DEFAULT).alias("path")
    )
    return F.coalesce(F.try_element_at(pairs, F.lit(1)), default)


def gap_paths(gaps: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per gap joined to the first path whose key it contains, default where none fits."""
    held = holding(gaps.select(F.col("gap").alias("value")).distinct(), paths.select(F.col("path_key").alias("word")).distinct())
    best = held.join(paths, F.col("word") == F.col("path_key")).groupBy("value").agg(F.min(F.struct("path_order", "path_label")).alias("p"))
    j = gaps.select("id", "gap").distinct().join(best, F.col("gap") == F.col("value"), "left")
    return j.select("id", "gap", F.coalesce("p.path_label", F.lit(lx.LEARNING_PATH_DEFAULT)).alias("path"))


def tag_difference(a: Column, b: Column) -> Column:
    empty = F.array().cast(NO_TAGS)
    return F.array_sort(F.array_except(F.coalesce(a, empty), F.coalesce(b, empty)))


def tag_intersection(a: Column, b: Column) -> Column:
    empty = F.array().cast(NO_TAGS)
    return F.array_sort(F.array_intersect(F.coalesce(a, empty), F.coalesce(b, empty)))


def union_batches(*batches: DataFrame) -> DataFrame:
    """All source batches as one frame; missing columns become NULL."""
    return union_all(batches, missing=True)


def union_candidates(*lists: DataFrame) -> DataFrame:
    """(user, listing) candidates, each with its best score."""
    return union_batches(*lists).groupBy("user_id", "listing_id").agg(F.max("score").alias("score"))


def unique_labels(lists: DataFrame, keys, column: str) -> DataFrame:
    """Labels of a row in order, first spelling kept, case ignored."""
    items = lists.select(*keys, F.transform(column, lambda s: F.trim(s)).alias("_items"))
    pos = items.select(*keys, F.posexplode("_items").alias("pos", "label")).filter(F.length("label") > 0)
    first = pos.groupBy(*keys, F.lower("label").alias("_low")).agg(F.min(F.struct("pos", "label")).alias("f"))
    again = first.groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("f"))
    return again.select(*keys, F.transform("f", lambda x: x["label"]).alias(column))


def unique_label_array(column: Column) -> Column:
    """The same rule inside one row, without any shuffle."""
    trimmed = F.filter(F.transform(column, lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    low = F.transform(trimmed, lambda s: F.lower(s))
    return F.filter(trimmed, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def latest_document(docs: DataFrame) -> DataFrame:
    """Primary first, then newest, then highest id, one per user."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.col("is_primary"), F.col("created_at"), F.col("doc_id"))
    return docs.groupBy(F.col("user_id").alias("_user")).agg(F.max_by(row, order).alias("_row")).select("_row.*")
