"""Composed search: words, facets, sort, total and page of many requests at once.

A request may have words, filters, both or neither.  Words go through a term
index; requests without words meet listings as saved searches do.  Whatever
the sort, a match is placed by one ordered key, so all requests are ranked in
one pass and a page is what comes after the last key of the page before: page
10,000 costs what page 1 does, and no page is reached by counting rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import origin, seniority, times
from jobloom.functions.enrich import NO_TAGS, clean_tags
from jobloom.functions.text import blank_to_null, strip, text
from jobloom.operators.alerts import FILTERS, SLIM, fits
from jobloom.operators.filters import fresh
from jobloom.operators.percolator import LOOSE, percolate
from jobloom.operators.ranking import certainty
from jobloom.runtime import broadcast_if_small, settle, top_per_key, union_all
from jobloom.search.textindex import build_index, for_all, match_texts, one_per_text, search_atoms, search_words

SORTS = ("relevance", "newest", "company")

def typed_requests(requests: DataFrame, days: int) -> DataFrame:
    """query_id, q, sort, after and filters of every request; a column the table lacks asks for nothing."""
    given = lambda c, t="string": F.col(c).cast(t) if c in requests.columns else F.lit(None).cast(t)
    said = lambda c: blank_to_null(F.lower(strip(text(given(c)))))
    sort = F.lower(strip(text(given("sort"))))
    q = blank_to_null(strip(text(given("q"))))
    sort = F.when(sort.isin(*SORTS), sort).otherwise("relevance")
    return requests.select(
        "query_id", q.alias("q"), F.when(q.isNull() & (sort == "relevance"), "newest").otherwise(sort).alias("sort"),
        (F.col("after") if "after" in requests.columns else F.lit(None).cast(KEY)).alias("after"),
        said("workplace").alias("w_workplace"), clean_tags(F.coalesce(given("skills", NO_TAGS), F.array().cast(NO_TAGS))).alias("w_skills"),
        F.least(F.coalesce(given("posted_within", "int"), F.lit(days)), F.lit(days)).alias("w_days"), seniority.asked_stage(given("career_stage")).alias("w_stage"),
        F.coalesce(given("region_friendly", "boolean"), F.lit(False)).alias("w_region"), F.coalesce(given("junior_eligible", "boolean"), F.lit(False)).alias("w_junior"),
        said("source").alias("w_source"), *[said(c).alias(f"w_{c}") for c in LOOSE],
    )


KEY = "struct<name: string, a: double, b: double, c: double, d: double, id: bigint>"


def sort_key() -> Column:
    """Where a match stands in the order its request asks for; lesser comes first."""
    micros = lambda c: F.unix_micros(F.col(c)).cast("double")
    posted, trust, sure = F.coalesce(-micros("posted_at"), F.lit(float("inf"))), origin.source_rank(F.col("source")), certainty()
    key = lambda name, *parts: F.struct(name.alias("name"), *[p.cast("double").alias(n) for p, n in zip(parts, "abcd")], F.col("id").cast("bigint").alias("id"))
    none, zero = F.lit(""), F.lit(0)
    return (
        F.when(F.col("sort") == "relevance", key(none, -F.round("rank", 12), trust, sure, posted))
        .when(F.col("sort") == "company", key(F.lower(text(F.col("company_name"))), posted, zero, zero, zero))
        .otherwise(key(none, posted, -micros("first_seen_at"), trust, sure))
    )


def _word_queries(typed: DataFrame) -> DataFrame:
    """(query_id, q): every text that typed requests search for, under an id of its own."""
    return typed.filter("q is not null").select(F.xxhash64("q").alias("query_id"), "q").dropDuplicates(["query_id"])


def found_once(requests: DataFrame, days: int, hits):
    """``hits`` for all pages of the same requests: what their words find is looked up here, once, and kept."""
    kept = settle(hits(_word_queries(typed_requests(requests, days))), "found")
    return lambda queries: kept.join(broadcast_if_small(queries.select("query_id")), "query_id", "left_semi")


def matches(listings: DataFrame, asked: DataFrame, as_of, days: int, hits=None) -> DataFrame:
    """(query_id, key, after) of every listing that a typed request asks for.

    ``hits`` finds (query_id, id, text_rank) for the words of searches, for
    instance in a stored index; without it an index of their words is built.
    """
    live = fresh(listings, as_of, days)
    facts = live.select(*SLIM)
    worded = asked.filter("q is not null")
    queries = _word_queries(worded)
    found = hits(queries) if hits else match_texts(build_index(live, search_words(search_atoms(queries))), queries)
    found = settle(found, "hits")  # read for the page and for the totals
    age = times.age_days(times.age_anchor(F.col("posted_at"), F.col("first_seen_at")), as_of)
    ranked = found.withColumnRenamed("query_id", "word_id").join(facts, "id").withColumn("rank", F.col("text_rank") * F.exp(-age / 7.0))
    by_word = ranked.join(broadcast_if_small(worded.withColumn("word_id", F.xxhash64("q"))), "word_id").filter(fits(as_of))
    plain = asked.filter("q is null").withColumn("kind", F.sha2(F.to_json(F.struct(*FILTERS)), 256))
    met = percolate(plain.select("kind", "q", *FILTERS).dropDuplicates(["kind"]), live, SLIM, fits(as_of)).select("kind", "id").join(facts, "id")
    by_filter = met.join(plain.select("query_id", "sort", "after", "kind"), "kind").withColumn("rank", F.lit(0.0))
    columns = ["query_id", "after", "id", "rank", "sort", "source", "posted_at", "first_seen_at", "company_name"]
    return union_all([by_word.select(*columns), by_filter.select(*columns)]).select("query_id", "after", sort_key().alias("key"))


def search_jobs(listings: DataFrame, requests: DataFrame, as_of, days: int, size: int = 20, hits=None) -> DataFrame:
    """query_id, id, position, score, total and key: a page of every request.

    A request whose ``after`` is the key of a row gets what follows that row.
    ``total`` counts all matches, whichever page is asked for.  Requests that
    ask alike are answered once.
    """
    typed = typed_requests(requests, days)
    asked, speakers = one_per_text(typed, *[c for c in typed.columns if c != "query_id"])
    found = matches(listings, settle(speakers, "requests"), as_of, days, hits)
    totals = found.groupBy("query_id").agg(F.count("*").alias("total"))
    ahead = found.filter(F.col("after").isNull() | (F.col("key") > F.col("after"))).select("query_id", "key")
    page = top_per_key(ahead, ["query_id"], [F.asc("key")], size).join(totals, "query_id")
    return for_all(page, asked).select("query_id", F.col("key.id").alias("id"), "position", (F.lit(size) + 1 - F.col("position")).cast("double").alias("score"), "total", "key")


def next_page(requests: DataFrame, page: DataFrame) -> DataFrame:
    """The requests with ``after`` set to the last key of their page; those whose page is empty are done."""
    last = page.groupBy("query_id").agg(F.max("key").alias("after"))
    return requests.drop("after").join(last, "query_id")
