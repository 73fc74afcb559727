"""Operators against plain-Python results, and their invariants."""

import datetime
import json
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from jobloom import fixtures as fx
from jobloom.functions import times
from jobloom.operators import dedupe, filters, grounding, lifecycle, matching, relations, throttle
from jobloom.plans import recommend
from jobloom.search import intent, textindex, vectors
from jobloom.sources import feeds

SF = "/root/testdata/sf0.001"
NOW, DAYS = fx.AS_OF, fx.DAYS


def test_freshness(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, true, timestamp'2024-01-24', timestamp'2024-01-30'), (2, true, timestamp'2023-12-22', timestamp'2024-01-30'),
      (3, true, null, timestamp'2024-01-29'), (4, true, null, timestamp'2023-12-22'), (5, false, timestamp'2024-01-30', timestamp'2024-01-30'), (6, true, null, null)
      AS t(id, is_active, posted_at, first_seen_at)""")
    assert {r.id for r in filters.fresh(df, NOW, 14).collect()} == {1, 3}
    assert {r.id for r in filters.stale(df, NOW, 14).collect()} == {2, 4}


def test_one_active_row_per_key(spark):
    after = dedupe.suppress_duplicates(fx.enriched(spark, SF)).filter("is_active")
    from jobloom.functions.urls import catalogue_apply_key

    links = after.groupBy(catalogue_apply_key(F.col("apply_url"))).count().filter("count > 1").count()
    titles = after.groupBy(F.lower("title"), F.lower("company_name"), "career_stage").count().filter("count > 1").count()
    assert links == 0 and titles == 0


def test_hot_key_keeps_the_right_row(spark):
    """Half of all rows share one link; one survivor, the preferred source."""
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") == 7777, "greenhouse").otherwise("themuse").alias("source"), F.lit(True).alias("is_active"),
        F.when(F.col("id") % 2 == 1, "https://x.example/hot").otherwise(F.concat(F.lit("https://x.example/"), "id")).alias("apply_url"),
        F.timestamp_seconds(F.col("id")).alias("first_seen_at"))
    out = dedupe.flag_link_duplicates(df)
    kept = out.filter("not dup_link and id % 2 = 1").collect()
    assert [r.id for r in kept] == [7777] and out.filter("not dup_link").count() == 10_001


def test_batch_prefers_boards_over_aggregators_only_within_a_source(spark):
    rows = [(1, "greenhouse", "a", "https://b.example/1", "long text here", None), (2, "themuse", "b", "https://b.example/1?utm_source=x", "short", None),
            (3, "greenhouse", "c", "https://www.b.example/1/", "text", None), (4, "greenhouse", "a", "https://b.example/1", "newest", None), (5, "lever", "z", "", "x", None)]
    df = spark.createDataFrame(rows, "seq long, source string, external_id string, apply_url string, description_text string, description_html string")
    got = {(r.source, r.external_id, r.description_text) for r in dedupe.batch_dedupe(df).collect()}
    assert got == {("greenhouse", "a", "newest"), ("themuse", "b", "short")}


def test_application_status(spark):
    saved = spark.sql("SELECT 1L saved_id, 'saved' status, timestamp(null) applied_at, timestamp(null) last_touch_at, timestamp(null) follow_up_on")
    changes = spark.sql("SELECT 1L saved_id, 'applied' new_status, 1 seq")
    r = lifecycle.apply_status(saved, changes, "2031-02-25T09:30:00").select("status", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("applied_at", "follow_up_on")]).first()
    assert tuple(r) == ("applied", "2031-02-25", "2031-03-04")


def test_learning_path(spark):
    path = relations.learning_path(F.array(F.lit("kubernetes"), F.lit("kafka")))
    assert tuple(spark.range(1).select(path.alias("p")).first().p) == ("kubernetes", "Kubernetes")
    none = spark.range(1).select(relations.learning_path(F.array().cast("array<string>")).alias("p")).first().p
    assert tuple(none) == ("core", "Core software skills")


def test_intent(spark):
    df = spark.createDataFrame([(1, "assistant curator remote"), (2, "winter intern golang"), (3, "golang karachi")], "query_id long, q string")
    r = {x.query_id: x for x in intent.parse_intent(df).collect()}
    assert r[1].hint_stage is None and r[1].hint_workplace == "remote"
    assert r[2].hint_stage == "internship" and r[2].hint_skills == ["go"] and r[3].hint_region and r[3].hint_skills == ["go"]


def test_search_forms(spark):
    df = spark.createDataFrame([(1, "Senior Python Engineer", "Acme", ["python"], "small red bolt"), (2, "Go Engineer", "Bolt", ["go"], "red small bolts bolt small"), (3, "C++ dev", "X", [], "")],
                               "id long, title string, company_name string, skills array<string>, description_text string")
    qs = spark.createDataFrame([(1, "engineer -senior"), (2, '"red bolt"'), (3, "python OR go"), (4, "bolt engineer"), (5, "c++"), (6, '-"small red" bolt')], "query_id long, q string")
    got = defaultdict(set)
    for r in textindex.match_queries(textindex.build_index(df), qs).collect():
        got[r.query_id].add(r.id)
    assert dict(got) == {1: {2}, 2: {1}, 3: {1, 2}, 4: {1, 2}, 5: {3}, 6: {2}}


def test_salted_search_equals_broadcast_search(spark, monkeypatch):
    e, qs = fx.enriched(spark, SF), fx.query_set(spark, SF)
    index = textindex.build_index(e)
    a = {tuple(r) for r in textindex.match_queries(index, qs).select("query_id", "id").collect()}
    monkeypatch.setattr(textindex, "broadcast_if_small", lambda df, rows=0: df)
    b = {tuple(r) for r in textindex.match_queries(index, qs).select("query_id", "id").collect()}
    assert a == b and a


def test_vector_blocks_and_recall(spark, monkeypatch):
    """On vectors without clusters nearly all lists are probed; with clusters a few do."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 24))
    groups = spark.createDataFrame([(i, (middles[i % 40] + 0.25 * rng.normal(size=24)).tolist()) for i in range(2000)], "id long, embedding array<double>")
    plain = fx.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    for rows, probes in ((plain, 26), (groups, 6)):
        queries = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
        pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
        exact = pairs(vectors.vector_topk(rows, queries, 10))
        unit = {r.id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in rows.collect()}
        assert exact == {(q, i) for q in unit if q % 50 == 0 for i in sorted(unit, key=lambda i: (-unit[i] @ unit[q], i))[:10]}
        near = pairs(vectors.ann_topk(rows, queries, vectors.fit_lists(rows, 32), probes, 10))
        assert len(near & exact) / len(exact) >= 0.9
    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    assert pairs(vectors.vector_topk(rows, queries, 10)) == exact


def test_vector_ties_and_empty_sides(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(50, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, query_vector array<double>")
    got = {(r.query_id, r.id, r.position) for r in vectors.vector_topk(rows, queries, 4).collect()}
    assert got == {(q, i, i + 1) for q in (1, 2) for i in range(4)}
    assert vectors.vector_topk(rows.limit(0), queries, 4).count() == vectors.vector_topk(rows, queries.limit(0), 4).count() == 0


def test_throttle_against_a_deque(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(0, 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, key long, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    allowed, window = set(), defaultdict(list)
    for i, k, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        window[k] = [x for x in window[k] if x > s - 30]
        if len(window[k]) < 4:
            window[k].append(s)
            allowed.add(i)
    assert {r.event_id for r in throttle.throttle(df, 4, 30).collect() if r.allowed} == allowed


def test_sections_merge(spark):
    rows = [(1, 0, "References", "References: available upon request"), (1, 1, "professional references", "References available upon request"), (1, 2, "Awards", "Best in show"),
            (1, 3, "Awards", "- best in show 2020"), (1, 4, "Awards", "AWARDS"), (1, 5, "Awards", "Second")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, heading string, item string")
    got = {r.section: r["items"] for r in grounding.merge_sections(df).collect()}
    assert got == {"references": ["References available upon request"], "awards": ["best in show 2020", "Second"]}


def test_entries_align_once_in_order(spark):
    base = spark.createDataFrame([(1, 1, "Developer at Acme"), (1, 2, "Acme developer"), (1, 3, "Baker")], "doc_id long, pos long, label string")
    new = spark.createDataFrame([(1, 10, "Lead developer at Acme Corp"), (1, 11, "Developer, Acme")], "doc_id long, pos long, label string")
    assert {(r.base_pos, r.derived_pos) for r in grounding.aligned_entries(base, new).collect()} == {(1, 10), (2, 11), (3, None)}


def test_skill_groups(spark):
    df = spark.createDataFrame([(1, ["Python", "Docker (compose)", "docker", "Kafka", "teamwork"], "python docker (compose) teamwork", ["python"], "we use python")],
                               "doc_id long, candidates array<string>, original string, keywords array<string>, job_text string")
    got = {r.category: r["items"] for r in grounding.skill_groups(df).collect()}
    assert got == {"Languages": ["python"], "DevOps & Cloud": ["docker (compose)"], "Additional Skills": ["teamwork"]}


def test_skill_names(spark):
    """Shown names: acronym table, the text's own letters, the first candidate with upper case, the longer variant."""
    text = "Built a REST API in Go and javascript (es6+) on aws; PostgreSQL, c++ and node.js"
    asked = ["rest api", "go", "javascript", "JavaScript (ES6+)", "AWS", "postgresql", "C++", "Node.js", "sql"]
    df = spark.createDataFrame([(1, asked, text, ["go"], "we use go"), (2, ["go"], "going", [], ""), (3, None, None, None, None)], "doc_id long, candidates array<string>, original string, keywords array<string>, job_text string")
    rows = grounding.skill_groups(df).collect()
    named = {i: n for r in rows if r.doc_id == 1 for i, n in zip(r["items"], r.names)}
    assert named == {"rest api": "REST API", "go": "Go", "javascript (es6+)": "JavaScript (ES6+)", "aws": "AWS", "postgresql": "PostgreSQL", "c++": "C++", "node.js": "Node.js", "sql": "SQL"}
    assert [r.names for r in rows if r.doc_id != 1] == [["go"]]


def test_new_entries_are_appended(spark):
    base = spark.createDataFrame([(1, 1, "Developer at Acme"), (3, 1, "Cook")], "doc_id long, pos long, label string")
    new = spark.createDataFrame([(1, 10, "Painter"), (1, 11, "Acme developer"), (1, 12, " "), (2, 10, "Gardener"), (2, 11, None)], "doc_id long, pos long, label string")
    got = {tuple(r) for r in grounding.aligned_entries(base, new).collect()}
    assert got == {(1, 1, 11), (1, None, 10), (2, None, 10), (3, 1, None)}


def test_headings_shown(spark):
    df = spark.createDataFrame([(1, 0, "awards", "Best in show"), (1, 1, "side QUESTS", "Sailing"), (1, 2, "Side quests", "Chess")], "doc_id long, pos long, heading string, item string")
    assert {r.section: (r.heading, r["items"]) for r in grounding.merge_sections(df).collect()} == {"awards": ("Awards", ["Best in show"]), "side quests": ("Side Quests", ["Sailing", "Chess"])}


def test_invented_figures(spark):
    df = spark.createDataFrame([("Cut the queue at the desk.", "Cut the queue at the desk by 31%.")], "original string, derived string")
    assert df.select(grounding.unsupported_metrics(F.col("original"), F.col("derived")).alias("v")).first().v == ["31%"]


def test_feed_level_becomes_a_stage(spark):
    items = json.dumps({"jobs": [
        {"id": "n7", "jobTitle": "Platform Intern", "companyName": "Saltmarsh", "jobDescription": "Tend our build farm in Rust.", "jobGeo": "Remote", "jobIndustry": ["Tools"], "jobType": "Internship", "jobLevel": "Internship", "url": "https://jobicy.com/jobs/n7", "pubDate": "2024-01-29T06:00:00Z"},
        {"id": "n8", "jobTitle": "Data Engineer", "companyName": "Saltmarsh", "jobDescription": "Pipelines in Rust.", "jobGeo": ["Remote", "Nordics"], "jobIndustry": "Tools", "jobType": ["Contract"], "jobLevel": "Entry-Level", "url": "https://jobicy.com/jobs/n8", "pubDate": "2024-01-29T06:00:00Z"},
    ]})
    raw = spark.createDataFrame([("jobicy", items), ("jobicy", "{broken")], "source string, payload string")
    got = {r.external_id: r for r in feeds.normalize_feed(raw, NOW, DAYS, ["jobicy"]).collect()}
    assert set(got) == {"n7", "n8"} and (got["n7"].source_level, got["n7"].career_stage) == ("Internship", "internship")
    assert (got["n8"].source_level, got["n8"].career_stage, got["n8"].workplace_type, got["n8"].employment_type) == ("Entry-Level", "junior", "remote", "Contract")
    assert "tools" in got["n7"].tech_tags


def test_feed_shapes(spark):
    rows = [
        ("greenhouse", '{"jobs":[{"id":5,"title":"QA Engineer","location":{"name":"Berlin"},"content":"<p>Hybrid work</p>","updated_at":"2024-01-30","absolute_url":"https://boards.greenhouse.io/acme/jobs/5#app"},{"id":6,"title":"Old","updated_at":"2020-01-01","absolute_url":"https://x.example/6"}]}'),
        ("smartrecruiters", '{"content":[{"id":"77","name":"Software Éng","location":{"city":"Paris","country":"fr","remote":true},"applyUrl":"https://api.smartrecruiters.com/v1/x","jobAd":{"sections":{"a":{"text":"<b>Code</b>"},"b":{"text":"review"}}},"releasedDate":"2020-01-01"}]}'),
        ("lever", '[{"id":"L1","text":"Data Engineer","categories":{"location":"Remote","commitment":"Full-time"},"lists":[{"text":"Do","content":"<li>things</li>"}],"descriptionPlain":"Plain.","createdAt":1706572800000,"hostedUrl":"https://jobs.lever.co/acme/L1"}]'),
        ("remoteok", '[{"legal":"notice"},{"id":"9","position":"Chef","company":"Food","tags":["cooking"],"url":"https://r.example/9","date":"2024-01-30"},{"id":"8","position":"Cook","company":"Food","tags":["python"],"url":"https://r.example/8","epoch":1706572800}]'),
        ("himalayas", '{"jobs":[{"guid":"g1","title":"Platform Lead","companyName":"H","applicationLink":"https://h.example/1","expiryDate":"2024-01-01","pubDate":"2024-01-30"},{"guid":"g2","title":"Platform Lead","companyName":"H","applicationLink":"https://h.example/2","locationRestrictions":[{"name":"India"},"Nepal"],"pubDate":"2024-01-30"}]}'),
    ]
    raw = spark.createDataFrame([(s, p, "acme", "Acme") for s, p in rows], "source string, payload string, ats_slug string, company_name string")
    got = {r.external_id: r for r in feeds.normalize_feed(raw, NOW, DAYS, [s for s, _ in rows]).collect()}
    assert set(got) == {"acme:5", "acme:77", "acme:L1", "8", "g2"}
    assert got["acme:5"].apply_url == "https://boards.greenhouse.io/acme/jobs/5" and got["acme:5"].workplace_type == "hybrid"
    assert got["acme:77"].apply_url == "https://jobs.smartrecruiters.com/acme/77-software-eng?oga=true" and got["acme:77"].location_raw == "Paris, fr · Remote"
    assert got["acme:77"].description_text == "Code review" and got["acme:L1"].description_text.startswith("Plain. Do")
    assert got["g2"].location_raw == "India, Nepal" and got["8"].company_name == "Food"


def _brute_recommend(spark, profiles, e, per_user):
    """The ladder climbed one profile at a time on the driver."""
    live = filters.fresh(e, NOW, DAYS).cache()
    cache, out = {}, {}

    def run(q, place, junior):
        if (q, place, junior) not in cache:
            rows = live if place is None else live.filter(F.col("workplace_type") == place)
            rows = rows.filter("junior_eligible") if junior else rows
            from jobloom.operators.ranking import newest_order, relevance_order

            if q.strip():
                asked = spark.createDataFrame([(1, q)], "query_id long, q string")
                ids = [r.id for r in textindex.search(rows, asked, NOW).orderBy(*relevance_order()).limit(50).collect()]
                cache[q, place, junior] = {i: 50.0 - n for n, i in enumerate(ids)}
            else:
                ids = [r.id for r in rows.orderBy(*newest_order()).limit(100).collect()]
                cache[q, place, junior] = {i: 100.0 - n for n, i in enumerate(ids)}
        return cache[q, place, junior]

    sides = matching.listing_side(live)
    for p in recommend.ladders(profiles).collect():
        found, done = {}, set()
        for q in p.rungs:
            if q.strip().lower() in done:
                continue
            done.add(q.strip().lower())
            for i, s in run(q, p.want_place, p.want_junior).items():
                found[i] = max(s, found.get(i, 0.0))
            if len(found) >= 40:
                break
        offered = spark.createDataFrame(sorted(found.items()), "listing_id long, search_score double")
        me = matching.profile_side(profiles.filter(F.col("user_id") == p.user_id)).select("user_id", "universe", "level", "remote_pref", "desired_roles", "cities", "location_preference", "wants_region")
        rows = matching.score_pairs(offered.join(sides, "listing_id").join(me, F.lit(True)), NOW).collect()
        level = p.level.lower()
        ok = [r for r in rows if not (level in ("internship", "intern", "new_grad", "junior", "entry", "entry-level") and (
            r.career_stage in ("mid", "senior") or (r.years_required_min or 0) >= 3 or (not r.junior_eligible and r.career_stage not in ("internship", "new_grad", "junior"))))]
        out[p.user_id] = [(r.listing_id, r.total) for r in sorted(ok, key=lambda r: (-r.total, -r.skill, r.listing_id))[:per_user]]
    return out


def test_recommend_equals_one_profile_at_a_time(spark):
    profiles = fx.profiles(spark, SF).filter("user_id < 4")
    e = fx.enriched(spark, SF)
    got = defaultdict(list)
    for r in recommend.recommend(profiles, e, NOW, DAYS, 10).orderBy("user_id", "position").collect():
        got[r.user_id].append((r.listing_id, r.total))
    assert dict(got) == {k: v for k, v in _brute_recommend(spark, profiles, e, 10).items() if v}


def test_matching_prefers_overlap(spark):
    job = spark.sql("""SELECT 9L id, 'Junior Rust Engineer' title, 'Saltmarsh' company_name, array('rust','docker') skills, array('kafka') tech_tags, 'junior' career_stage,
      'onsite' workplace_type, 'Hamburg, Germany' location_raw, false region_friendly, timestamp'2024-01-30' posted_at, timestamp'2024-01-30' first_seen_at, 'Move freight data with Rust and Kafka' description_text,
      'lever' source, 'https://saltmarsh.example/9' apply_url, cast(null as int) years_required_min, true junior_eligible""")
    people = spark.sql("""SELECT 4L user_id, array('rust','kafka') skills, array() technologies, 'junior' experience_level, 'onsite' remote_preference, cast(null as array<string>) desired_roles, cast(null as array<string>) cities, cast(null as string) location_preference, false region_friendly
      UNION ALL SELECT 5L, array('pottery'), array(), 'senior', 'remote', null, null, null, false""")
    pairs = matching.profile_side(people).withColumn("listing_id", F.lit(9).cast("long")).join(matching.listing_side(job), "listing_id").withColumn("search_score", F.lit(0.0))
    r = {x.user_id: x for x in matching.score_pairs(pairs, NOW).collect()}
    assert r[4].total > r[5].total and "rust" in r[4].matched and r[5].skill == 0 < r[4].skill


def test_windows(spark):
    df = spark.createDataFrame([("90",), ("x",), (None,), ("0",), ("5",)], "v string")
    assert [r[0] for r in df.select(times.clamp_window(F.col("v"))).collect()] == [30, 7, 7, 1, 5]


def test_ingest_run(spark):
    from jobloom.plans.ingest import ingest_run
    from jobloom.runtime import shared_folder
    from jobloom.sources.sinks import read_catalogue

    raw = spark.createDataFrame([("lever", '[{"id":"L1","text":"Data Engineer","categories":{"location":"Remote"},"descriptionPlain":"Plain.","createdAt":1706572800000,"hostedUrl":"https://jobs.lever.co/acme/L1"}]', "acme", "Acme", 1)],
                                "source string, payload string, ats_slug string, company_name string, seq long")
    current = fx.enriched(spark, SF).withColumn("updated_at", F.col("last_seen_at")).drop("source_level")
    out = shared_folder(spark, "run")
    counts = ingest_run(raw, current, out, NOW, DAYS, 21, ["lever"])
    after = read_catalogue(spark, out)
    new = after.filter("external_id = 'acme:L1'").collect()
    assert len(new) == 1 and new[0].is_active and new[0].career_stage == "unknown" and new[0].id is not None
    assert counts["purged"] > 0 and after.count() == current.count() + 1 - counts["purged"]


def test_upsert_newest_wins_in_any_order(spark):
    """A late row changes nothing, an absent column keeps its value, and each row has its own stamp."""
    schema = "id long, source string, external_id string, title string, company_url string, description_text string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean, missed_runs int"
    row = lambda i, key, title, day: spark.sql(f"SELECT {i}L id, 'lever' source, '{key}' external_id, '{title}' title, 'https://c.example' company_url, 'x' description_text, timestamp'2030-05-01' first_seen_at, timestamp'2030-05-{day:02d}' last_seen_at, true is_active, 0 missed_runs")
    store = spark.createDataFrame(row(1, "k1", "old", 3).collect(), schema)
    newer = row(1, "k1", "new", 20).unionByName(row(2, "k2", "other", 8)).drop("company_url")
    late = row(1, "k1", "late", 5).unionByName(row(2, "k2", "same", 8)).drop("company_url")
    one_way = lifecycle.upsert(lifecycle.upsert(store, newer, None, "last_seen_at"), late, None, "last_seen_at")
    other_way = lifecycle.upsert(lifecycle.upsert(store, late, None, "last_seen_at"), newer, None, "last_seen_at")
    facts = lambda df: {(r.external_id, r.company_url, r.last_seen_at.day) for r in df.collect()}
    assert facts(one_way) == facts(other_way) == {("k1", "https://c.example", 20), ("k2", None, 8)}
    assert {r.title for r in one_way.collect()} == {"new", "same"} and {r.title for r in other_way.collect()} == {"new", "other"}


def test_unread_texts_do_not_move_in_deduplication(spark):
    texts = {c: F.repeat(F.lit("x"), 9) for c in ("description_text", "description_html")}
    rows = spark.range(12).select("id", F.col("id").alias("seq"), F.lit("lever").alias("source"), (F.col("id") % 4).cast("string").alias("external_id"),
                                  F.concat(F.lit("https://a.b/"), (F.col("id") % 2).cast("string")).alias("apply_url")).withColumns(texts)
    aggregates = lambda df: [x for x in df.select("id")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x]
    for df in (dedupe.last_per_listing(rows), dedupe.batch_dedupe(rows)):
        assert aggregates(df) and not any("description" in x for x in aggregates(df))
    same = rows.withColumns({"seq": F.lit(1), "title": F.col("id").cast("string")})
    assert all(int(r.title) == r.id and r.first_seq == 1 for r in dedupe.last_per_listing(same).collect())


def test_a_late_batch_rewrites_no_bucket(spark, tmp_path):
    import os

    from jobloom.streaming import catalogue

    row = lambda i, title, day, posted=None: (i, "lever", f"x{i}", title, posted, day, day, True, 0)
    table = lambda rows: spark.createDataFrame(rows, "id long, source string, external_id string, title string, posted_at string, first_seen_at string, last_seen_at string, is_active boolean, missed_runs int") \
        .withColumns({c: F.col(c).cast("timestamp") for c in ("posted_at", "first_seen_at", "last_seen_at")})
    path = str(tmp_path / "store")
    files = lambda: sorted(f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    titles = lambda: {r.id: (r.title, r.posted_at and r.posted_at.day) for r in spark.read.parquet(path).collect()}
    catalogue.create_bucketed(table([row(i, "old", "2024-02-01", "2024-01-05") for i in range(8)]), path, 4)
    was = files()
    catalogue.apply_batch(table([row(i, "late", "2024-01-01", "2023-12-09") for i in range(8)]), path, "last_seen_at", 4)
    assert files() == was and set(titles().values()) == {("old", 5)}
    catalogue.apply_batch(table([row(0, "new", "2024-02-03"), row(1, "late", "2024-01-01", "2023-12-09"), row(9, "first", "2024-01-01")]), path, "last_seen_at", 4)
    assert titles() == {**{i: ("old", 5) for i in range(1, 8)}, 0: ("new", 5), 9: ("first", None)}
    assert 0 < len(set(was) & set(files())) < len(was)


def test_texts_of_a_streamed_batch_move_only_where_they_change_the_catalogue(spark, tmp_path, monkeypatch):
    """A batch was deduplicated with all its texts, and a late one was written down though it changes nothing."""
    from jobloom.streaming import catalogue

    schema = "id long, source string, external_id string, apply_url string, title string, description_text string, description_html string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean, missed_runs int, seq long"
    row = lambda i, key, link, title, text, day, seq=0: (i, "lever", key, f"https://a.example/{link}", title, text, None, None, datetime.datetime(2030, 5, day), True, 0, seq)
    path, landed = str(tmp_path / "store"), str(tmp_path / "landed")
    catalogue.create_bucketed(spark.createDataFrame([row(i, f"k{i}", i, "old", "x", 9) for i in range(4)], schema).drop("seq"), path, 4)
    first = [row(0, "k0", 0, "new", "x", 20), row(0, "k0", 0, "newer", "x", 20, 1), row(1, "k1", 1, "older", "xxx", 5), row(7, "k7", 7, "short", "x", 20), row(8, "k8", 7, "long", "xx", 20)]
    late = [row(r[0], *r[2:3], r[3][18:], "late", r[5], 2) for r in first]
    written, aggregates, plain = [], [], catalogue.settle
    def noted(df, name):
        written.append(name)
        aggregates.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x)
        return plain(df, name)
    monkeypatch.setattr(catalogue, "settle", noted)
    for batch in (first, late):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).parquet(landed)
        catalogue.stream_upsert(stream, path, str(tmp_path / "offsets"), buckets=4).awaitTermination()
        assert {r.external_id: r.title for r in spark.read.parquet(path).collect()} == {"k0": "newer", "k1": "old", "k2": "old", "k3": "old", "k8": "long"}
    assert written == ["batch", "news"]  # of the first
    assert aggregates and not any("description" in x or "title" in x for x in aggregates)
