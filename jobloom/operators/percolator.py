"""Searches indexed by what they ask for most rarely; listings stream against them.

Every condition of a search that names values is a clause: one of the tokens
of a clause must stand on a listing.  Facets give a token each, wanted tags one
clause of several, a place or company to be contained gives the values at hand
that contain it, and words give the rarest word of every alternative.  A search
is posted under the tokens of the clause that fewest listings meet, so a
listing is brought together with the searches it may match and no others, and
a common word is worked on by many tasks.  What meets is then tested in full;
words are looked up for the pairs that are left, by (listing, term).

Only a search that asks for nothing but an age meets every listing, and each
of these is a match of it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import seniority
from jobloom.functions.text import text
from jobloom.operators.containment import holding
from jobloom.runtime import broadcast_if_small, hot_join, settle, union_all
from jobloom.search.textindex import build_index, match_texts, search_atoms, search_words

LOOSE = {"city": "location_raw", "country": "location_raw", "company": "company_name", "employment_type": "employment_type"}
NONE = "array<struct<clause: string, token: string>>"


def _facets() -> Column:
    """(clause, token) of the filters of a search that name a value exactly."""
    one = lambda clause, value, when: F.when(when, F.array(F.struct(F.lit(clause).alias("clause"), F.concat(F.lit(clause + ":"), value).alias("token")))).otherwise(F.array().cast(NONE))
    stage = F.col("w_stage")
    intern, grad = stage.isin("internship", "intern"), stage.isin("new_grad", "new-grad", "newgrad")
    able = ~intern & (F.coalesce("w_junior", F.lit(False)) | F.coalesce(seniority.asked_stage_matches(F.col("w_stage"), F.col("w_junior"), F.lit("\0"), F.lit(True)) & (stage != ""), F.lit(False)))
    exact = F.when(intern, "internship").when(grad, "new_grad").otherwise(stage)
    tags = F.transform(F.coalesce("w_skills", F.array().cast("array<string>")), lambda s: F.struct(F.lit("tag").alias("clause"), F.concat(F.lit("tag:"), s).alias("token")))
    return F.concat(
        one("place", F.col("w_workplace"), F.col("w_workplace").isNotNull()), one("source", F.col("w_source"), F.col("w_source").isNotNull()),
        one("able", F.lit(""), able), one("stage", exact, ~able & (exact != "")), one("region", F.lit(""), F.coalesce("w_region", F.lit(False))), tags,
    )


def _own_tokens() -> Column:
    """Tokens of a listing, but for its words."""
    named = lambda c: F.concat(F.lit(c + ":"), F.lower(text(F.col(c))))
    tags = F.array_distinct(F.concat(F.coalesce("skills", F.array().cast("array<string>")), F.coalesce("tech_tags", F.array().cast("array<string>"))))
    return F.concat(
        F.array(F.lit("every:"), F.concat(F.lit("place:"), text(F.col("workplace_type"))), F.concat(F.lit("source:"), "source"), F.concat(F.lit("stage:"), text(F.col("career_stage"))),
                *[named(c) for c in sorted(set(LOOSE.values()))]),
        F.array_compact(F.array(F.when(F.col("junior_eligible"), "able:"), F.when(F.col("region_friendly"), "region:"))),
        F.transform(tags, lambda s: F.concat(F.lit("tag:"), s)),
    )


def percolate(kinds: DataFrame, listings: DataFrame, slim: list[str], fits: Column) -> DataFrame:
    """(kind, id, text_rank) of every listing that a distinct search matches; the rank is null without words.

    ``kinds`` has kind, q and the typed filters, ``fits`` tests them against
    the ``slim`` columns of a listing.  Without any word no text is read.
    """
    kinds = settle(kinds, "kinds")
    facts = settle(listings.select(*slim), "facts")
    queries = kinds.filter("q is not null").select(F.col("kind").alias("query_id"), "q")
    atoms = search_atoms(queries)
    words = settle(search_words(atoms), "words")
    index = settle(build_index(listings.limit(0) if words.isEmpty() else listings, words.select("term")), "terms")
    # Values that contain what a search wants to be contained.
    loose = union_all([kinds.select("kind", F.lit(c).alias("clause"), F.lit(own).alias("own"), F.col(f"w_{c}").alias("word")) for c, own in LOOSE.items()]).filter("word is not null")
    values = union_all([facts.select(F.lit(own).alias("own"), F.lower(text(F.col(own))).alias("value")) for own in sorted(set(LOOSE.values()))]).distinct()
    held = holding(values.select("value").distinct(), loose.select("word").distinct())
    contained = loose.join(held, "word", "left").select("kind", "clause", F.concat("own", F.lit(":"), F.coalesce("value", F.lit("\0"))).alias("token"))
    named = kinds.select("kind", F.explode(_facets()).alias("c")).select("kind", "c.clause", "c.token")
    spoken = words.filter("not negative").select(F.col("query_id").alias("kind"), "alternative", F.concat(F.lit("word:"), "term").alias("token")).distinct()
    asked = union_all([named.select("token"), contained.select("token"), spoken.select("token"), facts.sparkSession.range(1).select(F.lit("every:").alias("token"))]).distinct()
    posts = union_all([facts.select("id", F.explode(_own_tokens()).alias("token")), index.select("id", F.concat(F.lit("word:"), "term").alias("token"))])
    posts = settle(posts.join(broadcast_if_small(asked), "token", "left_semi"), "posts")
    counts = posts.groupBy("token").agg(F.count("*").alias("n"))
    weigh = lambda rows: rows.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = weigh(spoken).groupBy("kind", "alternative").agg(F.min_by(F.struct("token", "n"), F.struct("n", "token")).alias("t"))
    clauses = union_all([weigh(union_all([named, contained])).select("kind", "clause", "token", "n"), rarest.select("kind", F.lit("word").alias("clause"), "t.token", "t.n")])
    chosen = clauses.groupBy("kind", "clause").agg(F.sum("n").alias("n"), F.collect_set("token").alias("tokens")).groupBy("kind").agg(F.min_by("tokens", F.struct("n", "clause")).alias("tokens"))
    # Words without any that must stand match nothing; without words and clauses everything may match.
    bare = kinds.filter("q is null").select("kind").join(chosen, "kind", "left_anti").select("kind", F.lit("every:").alias("token"))
    entries = union_all([chosen.select("kind", F.explode("tokens").alias("token")), bare])
    met = hot_join(posts, entries, "token", F.col("id")).select("kind", "id").distinct()
    tested = settle(met.join(facts, "id").join(broadcast_if_small(kinds), "kind").filter(fits).select("kind", "id", "q"), "tested")
    wanted = tested.filter("q is not null").select(F.col("kind").alias("query_id"), "id")
    pairs = lambda postings, asked_words: wanted.join(broadcast_if_small(asked_words), "query_id").join(postings, ["id", "term"])
    worded = match_texts(index, queries, pairs).select(F.col("query_id").alias("kind"), "id", "text_rank")
    return union_all([worded, tested.filter("q is null").select("kind", "id", F.lit(None).cast("double").alias("text_rank"))])
