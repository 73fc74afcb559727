"""What large tables need: work dealt to all cores, steps computed once, and the same results in the cheaper forms."""

import re

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.functions import enrich, seniority, tags
from jobloom.operators import grounding, matching
from jobloom.plans import recommend
from jobloom.sources import feeds

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_are_dealt_to_all_cores(spark):
    assert fx.profiles(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_tag_is_judged_once(spark):
    df = spark.createDataFrame([(["docker", "java"],)], "t array<string>").select(tags.partition_tags(F.col("t")).alias("p"))
    assert plan(df.select("p.skills", "p.technologies")).count("(?:api|sdk|cli)") <= 4
    assert df.first().p.asDict() == {"skills": ["backend development", "devops"], "technologies": ["docker", "java"]}


def test_sections_are_cleaned_once(spark):
    """A filter on the cleaned text was pushed down, and had all steps computed again."""
    df = spark.createDataFrame([(1, 0, "Awards", "- Best  in show")], "doc_id long, pos long, heading string, item string")
    merged = grounding.merge_sections(df)
    assert plan(merged).count("regexp_replace") <= 40
    assert [tuple(r) for r in merged.collect()] == [(1, "awards", "Awards", ["Best in show"])]


def test_items_and_entries_keep_their_letters(spark):
    texts = ["", "  - Straße, 12%\u00a0x ", "a\u2003\u2028b\t_c", "• ÀB—ç/ñ  ", "\U0001f600ok\U00010400 + &", "D\u0660 e\u00b2 | f", "–*\n", "X,  y.z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    space = r"[\s\p{Z}]+"
    squash = lambda c: F.regexp_replace(F.regexp_replace(c, space, " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    t = F.col("t")
    item = squash(F.regexp_replace(F.regexp_replace(F.lower(squash(t)), r"^[•\-*–—]+\s*", ""), r"[^\p{L}\p{Nd}_\s]", " "))
    entry = F.regexp_replace(F.regexp_replace(squash(F.lower(t)), "[^a-z0-9 ]", " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    for r in rows.select(t, grounding.norm_item(t).alias("a"), item.alias("b"), grounding.entity_key(t).alias("c"), entry.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t


def test_entries_of_one_document_move_once(spark):
    rows = [(1, i, f"entry number{i} of many{i}") for i in range(40)]
    base = spark.createDataFrame(rows, "doc_id long, pos long, label string")
    found = grounding.aligned_entries(base, base.withColumn("pos", F.col("pos") + 100).withColumn("label", F.concat("label", F.lit(" lead"))))
    assert " Join" not in plan(found)
    assert {(r.base_pos, r.derived_pos) for r in found.collect()} == {(i, i + 100) for i in range(40)}


def test_profiles_that_are_alike_are_scored_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(recommend, "score_pairs", lambda pairs, as_of: seen.append(pairs.count()) or matching.score_pairs(pairs, as_of))
    one, rows = fx.profiles(spark, SF).filter("user_id = 1"), fx.enriched(spark, SF)
    three = one.withColumn("user_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")))
    alone = recommend.recommend(one, rows, fx.AS_OF, fx.DAYS, 5).select("position", "listing_id", "total").collect()
    found = recommend.recommend(three, rows, fx.AS_OF, fx.DAYS, 5).select("user_id", "position", "listing_id", "total").collect()
    assert seen[0] == seen[1] and len(alone) == 5
    assert sorted(found) == sorted((u, *r) for u in (1, 2, 3) for r in alone)


def test_a_text_is_read_once_for_all_words_of_a_lexicon(spark):
    """Every pattern searched the whole text for its letters."""
    df = spark.createDataFrame([("Java, go!",)], "t string").select(enrich.extract_skills(F.col("t")).alias("s"))
    assert not re.search(r"(?<!array_)contains\(lambda", plan(df).lower()) and df.first().s == ["go", "java"]
    listings = fx.enriched(spark, SF).select("skills", "tech_tags")
    assert plan(listings).count("array_intersect") == 1


def test_words_of_a_lexicon_lose_no_match(spark):
    texts = ["", "Node.JS", "nodejs", "node js", "x.NET", ".net", "C++a C#b", "c++", "CI/CD", "cicd", "ci-cd", "Postgres", "POSTGRESQL", "go_", "\u00e1go", "go\u0301", "go\u212a", "\u0130os",
             "ios\u0130", "machine learning", "machine\nlearning", "react native", "React.js", "reactjs", "vue", "vue.js", "golang", "mango db", "MongoDB", "k8s", "1k8s", "spring boots", "spring boot", "a.ai"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    lexicon = {**lx.SKILL_LEXICON, "odd": [r"\bwor(?:k|d)s?\b", r"\bno[dt]e\b"]}
    plainly = [F.when(enrich.any_of([F.col("t").rlike("(?i)" + p) for p in ps]), F.lit(name)) for name, ps in lexicon.items()]
    for r in rows.select("t", enrich.extract_skills(F.col("t"), lexicon=lexicon).alias("a"), F.array_sort(F.array_compact(F.array(*plainly))).alias("b")).collect():
        assert r.a == r.b, r.t


def test_years_are_found_as_stated(spark):
    texts = ["minimum 5 years", "min. 3+ yrs", "at least 2-4 years", "over  7 plus years", "x5 years", "5years", "a_5 years", "10 to 12 yrs", "more than\n6 years and 2 years", "5 yearsx", "min3 years", "\u00e15 years",
             "0-2", "10-2", "0 to 2x", "No prior experience", "kno experience", "little to no experience"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(1))
    pairs = [(found(seniority.YEARS_STATED), found(lx.YEARS_PATTERN)), (F.col("t").rlike(seniority.ZERO_STATED), F.col("t").rlike(lx.ZERO_YEARS))]
    for a, b in pairs:
        assert rows.filter(~a.eqNullSafe(b)).count() == 0


def test_bodies_of_a_feed_are_cleaned_once(spark, monkeypatch):
    """Each use of the readable text had all its steps computed again."""
    kept = {}
    monkeypatch.setattr(feeds, "settle", lambda df, name: kept.setdefault(name, df))
    raw = spark.createDataFrame([("weworkremotely", '{"guid": "a", "link": "https://x.example.com/a", "title": "Firm: Web engineer", "description": "<p>a &amp; b</p>"}')], "source string, payload string")
    assert feeds.normalize_feed(raw, fx.AS_OF, fx.DAYS, ["weworkremotely"]).first().description_text == "a & b"
    assert plan(kept["normalized"]).count("<script") <= 2
