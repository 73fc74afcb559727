"""Duplicate removal within a batch and across the catalogue.

Every step picks one survivor per key with a map-side combined aggregate and
flags the rest by row id, so no window ever gathers a hot key in one task.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import origin, urls
from jobloom.functions.text import strip, text
from jobloom.runtime import earliest, settle, union_all


def usable(df: DataFrame) -> DataFrame:
    return df.filter(urls.apply_url_is_usable(F.col("apply_url")))


def _chosen(df: DataFrame, keys: list[Column], pick, order: Column, *more: Column) -> DataFrame:
    """The row of each key that ``pick`` finds by ``order``, column by column.

    Every column sees the same rows in the same order, so ties fall alike;
    columns that nothing reads later are pruned and do not move.
    """
    placed = df.withColumn("_order", order)
    best = placed.groupBy(*keys).agg(*[pick(F.col(c), F.col("_order")).alias(c) for c in df.columns], *more)
    return best.drop("_key0", "_key1")


def last_per_listing(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Last arrival per (source, external_id).

    Adds ``first_seq``, the arrival of the key's first row, which settles
    later ties.
    """
    keys = [F.col("source").alias("_key0"), F.col("external_id").alias("_key1")]
    return _chosen(df, keys, F.max_by, F.col(seq), F.min("_order").alias("first_seq"))


def sized(df: DataFrame) -> DataFrame:
    """``_size``, the length of a row's texts, which then need not move to be weighed."""
    return df.withColumn("_size", F.length(text(F.col("description_text"))) + F.length(text(F.col("description_html"))))


def linked(df: DataFrame) -> DataFrame:
    """``_link``, the canonical link of a row."""
    return df.withColumn("_link", urls.batch_apply_key(F.col("apply_url")))


def best_per_link(df: DataFrame, seq: str = "first_seq") -> DataFrame:
    """Best row per (source, canonical link): trust, longer text, first seen; ``sized`` and ``linked`` may have read texts and links before."""
    rows = df if "_size" in df.columns else sized(df)
    keyed = (rows if "_link" in df.columns else linked(rows)).filter("_link is not null")
    order = F.struct(origin.source_rank(F.col("source")).alias("a"), (-F.col("_size")).alias("b"), F.col(seq).alias("c"))
    return _chosen(keyed, [F.col("source").alias("_key0"), F.col("_link").alias("_key1")], F.min_by, order).drop("_link", "_size")


def batch_dedupe(df: DataFrame, seq: str = "seq") -> DataFrame:
    return best_per_link(last_per_listing(sized(usable(df)), seq))


def _losers(candidates: DataFrame, keys, order) -> DataFrame:
    """Ids of the candidate rows that are not first in their key."""
    winners = earliest(candidates.select(*keys, *order), keys, [F.col(c) for c in order], ["id"])
    return candidates.select("id").join(winners.select("id"), "id", "left_anti")


def _flagged(df: DataFrame, losers: DataFrame, flag: str) -> DataFrame:
    return df.join(losers.withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


LINK_ORDER = ["_pref", "first_seen_at", "id"]
TITLE_ORDER = ["_pref", "_dated", "first_seen_at", "id"]
TITLE_KEY = ["_title", "_company", "_stage"]


def _linked(df: DataFrame) -> DataFrame:
    """Rows with a link; the others would all meet under one empty key."""
    return df.withColumn("_key", urls.catalogue_apply_key(F.col("apply_url"))).filter("_key <> ''")


def _titled(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_title": F.lower(F.trim("title")), "_company": F.lower(F.trim("company_name")),
        "_stage": F.coalesce("career_stage", F.lit("unknown")), "_dated": F.when(F.col("posted_at").isNotNull(), 0).otherwise(1),
    })


def _live(df: DataFrame) -> DataFrame:
    return df.filter("is_active").withColumn("_pref", origin.source_preference(F.col("source")))


def flag_link_duplicates(df: DataFrame) -> DataFrame:
    """``dup_link`` on active rows whose coarse link has a better row."""
    return _flagged(df, _losers(_linked(_live(df)), ["_key"], LINK_ORDER), "dup_link")


def flag_title_duplicates(df: DataFrame, among: Column | None = None) -> DataFrame:
    """``dup_title`` on active rows whose title, company and stage has a better row."""
    rows = _live(df) if among is None else _live(df).filter(among)
    return _flagged(df, _losers(_titled(rows), TITLE_KEY, TITLE_ORDER), "dup_title")


def suppress_duplicates(df: DataFrame) -> DataFrame:
    """Deactivate link duplicates, then title duplicates among the survivors.

    Both rules work on one slim table of keys, written once; the catalogue is
    read for it and for the final join, whatever stands below it.  Adds
    ``dup_link`` and ``dup_title``.
    """
    slim = _titled(_live(df).withColumn("_key", urls.catalogue_apply_key(F.col("apply_url"))))
    slim = settle(slim.select("id", "_key", *TITLE_KEY, "_pref", "_dated", "first_seen_at"), "keys")
    by_link = settle(_losers(slim.filter("_key <> ''"), ["_key"], LINK_ORDER), "losers")
    by_title = _losers(slim.join(by_link, "id", "left_anti"), TITLE_KEY, TITLE_ORDER)
    losers = union_all([by_link.withColumn("_why", F.lit("link")), by_title.withColumn("_why", F.lit("title"))])
    why = df.join(losers, "id", "left").withColumns({c: F.coalesce(F.col("_why") == w, F.lit(False)) for c, w in (("dup_link", "link"), ("dup_title", "title"))})
    return why.withColumn("is_active", F.col("is_active") & F.col("_why").isNull()).drop("_why")
