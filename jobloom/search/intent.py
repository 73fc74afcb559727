"""Hints read from a search text, and the search text of a profile."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom import lexicons as lx
from jobloom.functions.enrich import NO_TAGS
from jobloom.functions.text import blank_to_null, has_any, let, strip, text


def parse_intent(queries: DataFrame) -> DataFrame:
    """Add workplace, stage, region and skill hints; explicit values win.

    Optional columns ``workplace``, ``career_stage``, ``region_friendly`` and
    ``skills`` hold what the reader chose.
    """
    given = lambda c, t: F.col(c) if c in queries.columns else F.lit(None).cast(t)
    q = strip(text(F.col("q")))
    low = F.concat(F.lit(" "), F.lower(q), F.lit(" "))
    stage = F.lit(None).cast("string")
    for needles, name in reversed(lx.INTENT_STAGES):
        stage = F.when(has_any(low, needles), F.lit(name)).otherwise(stage)
    chosen = F.transform(F.coalesce(given("skills", NO_TAGS), F.array().cast(NO_TAGS)), lambda s: F.lower(s))
    named = F.array_compact(F.array(*[F.when(low.contains(n), F.lit(s)) for n, s in lx.INTENT_SKILLS]))
    remote = F.when(has_any(low, lx.INTENT_REMOTE_WORDS), F.lit("remote"))
    return queries.withColumns({
        "cleaned_q": q,
        "hint_workplace": F.coalesce(blank_to_null(given("workplace", "string")), remote),
        "hint_stage": F.coalesce(blank_to_null(given("career_stage", "string")), stage),
        "hint_region": F.coalesce(given("region_friendly", "boolean"), F.lit(False)) | has_any(low, lx.INTENT_REGION_WORDS),
        "hint_skills": F.array_sort(F.array_distinct(F.concat(chosen, named))),
    })


def search_query(roles: Column, skills: Column, fallback: str = lx.QUERY_FALLBACK) -> Column:
    """First desired role, else up to four telling skills, else a broad search."""
    role = blank_to_null(strip(text(F.try_element_at(F.coalesce(roles, F.array().cast(NO_TAGS)), F.lit(1)))))
    have = F.array_distinct(F.filter(F.transform(skills, lambda s: F.lower(strip(s))), lambda s: F.length(s) > 0))

    def telling(tags):
        ranked = F.filter(F.array(*[F.lit(p) for p in lx.QUERY_PRIORITY_SKILLS]), lambda p: F.array_contains(tags, p))
        by_length = F.transform(F.array_sort(F.transform(tags, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), lambda x: x["s"])
        return let(ranked, lambda r: F.slice(F.when(F.size(r) > 0, r).otherwise(F.slice(by_length, 1, 5)), 1, 4))

    listed = let(have, lambda tags: F.array_join(telling(tags), " OR "))
    return F.coalesce(role, blank_to_null(listed), F.lit(fallback))
