"""Rank fusion and the combined text and vector search."""

from pyspark.sql import DataFrame, functions as F

from jobloom.functions import seniority
from jobloom.functions.enrich import NO_TAGS
from jobloom.operators.filters import fresh
from jobloom.operators.ranking import relevance_order
from jobloom.runtime import broadcast_if_small, top_per_key, union_all
from jobloom.search.intent import parse_intent
from jobloom.search.textindex import for_all, one_per_text, search_texts
from jobloom.search.vectors import cell_topk, vector_topk

K = 60


def rank_positions(scored: DataFrame, order, n: int) -> DataFrame:
    """(query_id, id, position) of the first n rows of every query."""
    return top_per_key(scored, ["query_id"], order, n).select("query_id", "id", "position")


def reciprocal_rank_fusion(*lists: DataFrame, k: int = K) -> DataFrame:
    """Sum of 1 / (k + position) over the lists an id appears in."""
    return union_all(lists).groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("position"))).alias("fused"))


def obeys_hints(hint=F.col):
    """Whether a listing row meets the hints that ``hint`` looks up by name."""
    skills = F.coalesce(hint("hint_skills"), F.array().cast(NO_TAGS))
    return (
        (hint("hint_workplace").isNull() | (F.col("workplace_type") == F.lower(hint("hint_workplace"))))
        & seniority.stage_matches(hint("hint_stage"), F.lit(False), F.col("career_stage"), F.col("junior_eligible"))
        & (~hint("hint_region") | F.col("region_friendly"))
        & ((F.size(skills) == 0) | F.arrays_overlap("skills", skills) | F.arrays_overlap("tech_tags", skills))
    )


def hybrid_search(
    listings: DataFrame, queries: DataFrame, query_vectors: DataFrame, as_of, days, provider: str | None = None,
    depth: int = 50, page: int = 1, size: int = 20, use_hints: bool = True,
) -> DataFrame:
    """Text and vector lists of every query, fused, one page each.

    ``queries`` has query_id and q; ``query_vectors`` query_id and
    query_vector.  Hints narrow both legs.  A page that lies past the fused
    list of a query is that page of its text ranking.
    """
    live = fresh(listings, as_of, days)
    asked = parse_intent(queries)
    alike, speakers = one_per_text(asked, "q", *HINTS)
    text_hits = search_texts(live, speakers.select("query_id", "q"), as_of)
    if use_hints:
        text_hits = text_hits.join(broadcast_if_small(speakers.select("query_id", *HINTS)), "query_id").filter(obeys_hints())
    start, end = (page - 1) * size, page * size
    text_top = top_per_key(text_hits, ["query_id"], relevance_order(), max(depth, end)).select("query_id", "id", "position")
    text_top = for_all(text_top, alike)
    text_list = text_top.filter(F.col("position") <= depth)
    totals = for_all(text_hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("text_total")), alike)
    vectors = live.filter("embedding is not null")
    if provider:
        vectors = vectors.filter(F.col("embedding_provider") == provider)
    vec_list = vector_leg(vectors, asked, query_vectors, depth, use_hints)
    fused = reciprocal_rank_fusion(text_list, vec_list)
    paged = top_per_key(fused, ["query_id"], [F.desc(F.round("fused", 12)), F.asc("id")], end)
    counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused_total"))
    rows = paged.filter(F.col("position") > start).select("query_id", "id", "position", F.col("fused").alias("score"))
    if start:
        beyond = text_top.filter(F.col("position") > start).join(counts.filter(F.col("fused_total") > start), "query_id", "left_anti")
        rows = rows.unionByName(beyond.withColumn("score", (end + 1 - F.col("position")).cast("double")))
    out = rows.join(counts, "query_id").join(totals, "query_id", "left")
    return out.withColumn("total", F.greatest(F.coalesce("text_total", F.lit(0)), "fused_total")).select("query_id", "id", "position", "score", "total")


HINTS = ["hint_workplace", "hint_stage", "hint_region", "hint_skills"]


def vector_leg(vectors: DataFrame, asked: DataFrame, query_vectors: DataFrame, depth: int, use_hints: bool) -> DataFrame:
    """Vector list per query, filtered by its hints before the cut.

    Queries that hint alike form a cell; a listing stands in the cells whose
    hints it meets.  Hint sets come from the words that hint, so they are few.
    """
    if not use_hints:
        return vector_topk(vectors, query_vectors, depth).select("query_id", "id", "position")
    key = F.sha2(F.to_json(F.struct(*HINTS)), 256).alias("cell")
    keyed = query_vectors.join(asked.select("query_id", key, *HINTS), "query_id")
    sets = broadcast_if_small(keyed.select("cell", *HINTS).dropDuplicates(["cell"]))
    facts = ["workplace_type", "career_stage", "junior_eligible", "region_friendly", "skills", "tech_tags"]
    rows = vectors.select("id", "embedding", *facts).join(sets, obeys_hints()).select("cell", "id", "embedding")
    return cell_topk(rows, keyed.select("cell", "query_id", "query_vector"), depth).select("query_id", "id", "position")
