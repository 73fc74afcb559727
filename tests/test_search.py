"""Stored index, paging and percolator against plain re-computation."""

import datetime
import random

from pyspark.sql import functions as F

from jobloom.operators import alerts, containment, percolator
from jobloom.search import jobs, storedindex, textindex

NOW = "2024-01-31T00:00:00"
LISTING = ("id long, title string, company_name string, skills array<string>, tech_tags array<string>, description_text string, source string, posted_at timestamp, first_seen_at timestamp, "
           "workplace_type string, career_stage string, junior_eligible boolean, region_friendly boolean, location_raw string, employment_type string, is_active boolean, years_required_min int")


def listings(spark, n=150, seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["red", "bolt", "anvil", "the", "gear", "go", "small"])
    day = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rnd.randrange(10, 30), seconds=rnd.randrange(3))
    rows = [(i, f"{word()} {word()}", rnd.choice(["Acme", "ab", "Firm of Q"]), [rnd.choice(["java", "go"])], [word()], " ".join(word() for _ in range(6)), rnd.choice(["lever", "remotive"]),
             day() if i % 4 else None, day(), rnd.choice(["remote", "hybrid", "remote"]), rnd.choice(["junior", "senior", "internship", "unknown"]), i % 3 > 0, i % 5 == 0,
             rnd.choice(["Berlin, Germany", "Q", "Lahore", None]), rnd.choice(["Full-time", None]), i % 10 > 0, None) for i in range(n)]
    return spark.createDataFrame(rows, LISTING)


SEARCH = ("search_id long, user_id long, name string, q string, workplace string, skills_csv string, posted_within string, career_stage string, region_friendly boolean, "
          "last_checked_at timestamp, junior_eligible boolean, source string, city string, country string, company string, employment_type string, is_active boolean")


def searches(spark):
    old = datetime.datetime(2024, 1, 20)
    rows = []
    forms = [None, "red bolt", "anvil OR gear", "the -red", '"red bolt"', "-red", "absent", "the OR absent"]
    for i in range(96):
        rows.append((i, i % 5, f"s{i}", forms[i % 8], [None, "remote", None][i % 3], [None, "java, go", None, "gear"][i % 4], [None, "5", "30"][i % 3], [None, "junior", "intern", "senior", None][i % 5],
                     i % 11 == 3, old if i % 2 else None, i % 13 == 5, "lever" if i % 7 == 6 else None, [None, "q", "Berlin", "zz"][i // 8 % 4] if i % 2 else None, "germany" if i % 17 == 4 else None, "b" if i % 9 == 1 else None, "full" if i % 10 == 7 else None, i % 19 != 2))
    rows.append((500, 1, "all", None, None, None, "30", None, False, None, False, None, None, None, None, None, True))
    return spark.createDataFrame(rows, SEARCH)


def test_percolator_finds_what_every_pair_shows(spark):
    live, asked = listings(spark).cache(), alerts.typed_searches(searches(spark)).cache()
    active = live.filter("is_active")
    words = textindex.match_queries(textindex.build_index(active), asked.filter("q is not null").select(F.col("search_id").alias("query_id"), "q")).select(F.col("query_id").alias("search_id"), "id", F.lit(True).alias("hit"))
    pairs = asked.crossJoin(active.select(*alerts.SLIM)).join(words, ["search_id", "id"], "left").filter(F.col("q").isNull() | F.col("hit")).filter(alerts.fits(NOW))
    newer = F.col("last_checked_at").isNull() | (F.coalesce("first_seen_at", "posted_at") > F.col("last_checked_at"))
    pairs_of = lambda df: sorted((r.search_id, r.id) for r in df.select("search_id", "id").collect())
    got = pairs_of(alerts.found_by(asked, live, NOW))
    assert got == pairs_of(pairs) and len({s for s, _ in got}) > 20
    assert pairs_of(alerts.found_by(asked, live, NOW, True)) == pairs_of(pairs.filter(newer))
    # The search without conditions matches all that is young enough, and nothing is lost when there is nothing to match.
    assert sum(s == 500 for s, _ in got) == active.filter(F.coalesce("posted_at", "first_seen_at") >= "2024-01-01").count()
    assert alerts.found_by(asked.limit(0), live, NOW).count() == alerts.found_by(asked, live.limit(0), NOW).count() == 0


def test_values_that_contain_a_word(spark):
    rnd = random.Random(1)
    some = lambda n: {"".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, n))) for _ in range(60)}
    values, words = some(9), some(5)
    frame = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = {tuple(r) for r in containment.holding(frame(values, "value"), frame(words, "word")).collect()}
    assert got == {(v, w) for v in values for w in words if w and w in v}


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    rows, path = listings(spark, 40), str(tmp_path / "index")
    queries = spark.createDataFrame([(1, "red bolt"), (2, "anvil OR gear -go"), (3, '"small red"'), (4, "new"), (5, "the")], "query_id long, q string")
    storedindex.create(rows.filter("id < 30"), path, 4)
    first = rows.filter("id between 10 and 34").withColumn("title", F.concat(F.lit("new "), "title"))
    storedindex.refresh(path, first, rows.filter("id < 5").select("id"), 4)
    second = rows.filter("id in (2, 12)")  # one comes back, one loses its new title
    storedindex.refresh(path, second, rows.filter("id = 20").select("id"), 4)
    now = second.union(first.filter("id not in (12, 20)")).union(rows.filter("id between 5 and 9"))
    answer = lambda df: sorted((r.query_id, r.id, round(r.text_rank, 9)) for r in df.collect())
    want = answer(textindex.match_queries(textindex.build_index(now), queries))
    assert answer(storedindex.match_stored(spark, path, queries)) == want and want
    storedindex.compact(spark, path, 4)
    assert len(storedindex.segments(spark, path)) == 1
    assert answer(storedindex.match_stored(spark, path, queries)) == want


def test_postings_of_a_stored_index_do_not_move(spark, tmp_path):
    path = str(tmp_path / "index")
    storedindex.create(listings(spark, 40), path, 4)
    (segment, buckets), = storedindex.segments(spark, path)
    words = spark.createDataFrame([("red",), ("the",)], "term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = storedindex._met(storedindex._table(spark, path, segment, buckets), words)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # of the words


def test_pages_by_key_follow_one_another(spark):
    rows = listings(spark, 36).withColumn("posted_at", F.when(F.col("id") % 3 > 0, F.lit("2024-01-25 00:00:00").cast("timestamp")))
    asked = spark.createDataFrame([(1, "red", "relevance"), (2, None, "newest"), (3, None, "company"), (4, "the", "no such sort"), (5, "absent", None)], "query_id long, q string, sort string")
    order = lambda df: [(r.query_id, r.id, r.total) for r in df.orderBy("query_id", "position").collect()]
    whole = order(jobs.search_jobs(rows, asked, NOW, 30, 1000))
    first = jobs.search_jobs(rows, asked, NOW, 30, 5).cache()
    second = order(jobs.search_jobs(rows, jobs.next_page(asked, first), NOW, 30, 5))
    assert {q for q, *_ in whole} == {1, 2, 3, 4}
    for query in (1, 2, 3, 4):
        listed = [r for r in whole if r[0] == query]
        assert [r for r in order(first) + second if r[0] == query] == listed[:10] and listed[0][2] == len(listed) > 5


def test_searches_of_one_text_are_matched_once(spark, monkeypatch):
    rows = listings(spark, 60)
    texts = ["red bolt", "anvil OR gear", "the -red"]
    many = spark.createDataFrame([(i, texts[i % 3] if i % 10 else None) for i in range(90)], "query_id long, q string")
    matched, plain = [], textindex.match_texts
    monkeypatch.setattr(textindex, "match_texts", lambda index, queries, join=None: matched.append(queries.filter("q is not null").count()) or plain(index, queries, join))
    answer = lambda df: sorted((r.query_id, r.id, round(r.text_rank, 9)) for r in df.collect())
    index = textindex.build_index(rows)
    got = answer(textindex.match_queries(index, many))
    assert matched == [3]
    assert got == answer(plain(index, many)) and len({q for q, *_ in got}) == 81
    assert "REPARTITION_BY_NUM" in textindex.match_queries(index, many)._jdf.queryExecution().executedPlan().toString()
    # Beyond the bound of a broadcast the result is the same.
    monkeypatch.setattr(textindex, "broadcast_if_small", lambda df, rows=0: df)
    assert answer(textindex.match_queries(index, many)) == got


def test_a_kept_index_is_built_without_moving_tokens(spark):
    rows = spark.createDataFrame([(1, "b a", "a", ["x"], "a b"), (2, "", "", None, None), (3, "c", None, [], "d c")], "id long, title string, company_name string, skills array<string>, description_text string")
    index = textindex.build_index(rows)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.term): (round(r.weighted, 9), r.positions, r.doc_length) for r in index.collect()}
    assert got == {(1, "a"): (2.2, [1, 2, 4], 6), (1, "b"): (1.2, [0, 5], 6), (1, "x"): (0.4, [3], 6), (3, "c"): (1.2, [0, 2], 3), (3, "d"): (0.2, [1], 3)}


def test_requests_that_ask_alike_are_answered_once(spark, monkeypatch):
    rows = listings(spark, 60)
    asked = spark.createDataFrame([(i, ["red", None, "the"][i % 3], ["relevance", "newest", "company"][i % 3], "Remote" if i % 2 else None) for i in range(30)], "query_id long, q string, sort string, workplace string")
    answered, plain = [], jobs.matches
    monkeypatch.setattr(jobs, "matches", lambda listings, asked, *rest: answered.append(asked.count()) or plain(listings, asked, *rest))
    page = jobs.search_jobs(rows, asked, NOW, 30, 5).collect()
    assert answered == [6] and {r.query_id for r in page} == set(range(30))
    by_query = lambda q: sorted((r.position, r.id, r.total) for r in page if r.query_id == q)
    assert all(by_query(q) == by_query(q + 6) for q in range(24)) and by_query(0) != by_query(3)


def test_merging_a_stored_index_moves_no_postings(spark, tmp_path):
    path, rows = str(tmp_path / "index"), listings(spark, 40)
    storedindex.create(rows, path, 4)
    storedindex.refresh(path, rows.filter("id < 9").withColumn("title", F.lit("new")), rows.filter("id = 20").select("id"), 4)
    now = rows.filter("id not in (20) and id >= 9").union(rows.filter("id < 9").withColumn("title", F.lit("new")))
    shown = lambda df: sorted((r.id, r.term, round(r.weighted, 9), tuple(r.positions), r.doc_length) for r in df.collect())
    want = shown(textindex.build_index(now))
    for _ in range(2):
        found = storedindex.postings(spark, path)
        assert shown(found) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftAnti" in plan and "strategy=broadcast" in plan and "Join Inner" not in plan
        storedindex.compact(spark, path, 4)
    kept, storedindex.DEAD_IDS = storedindex.DEAD_IDS, 1
    try:
        storedindex.refresh(path, rows.filter("id < 9"), None, 2)
        storedindex.compact(spark, path, 3)
    finally:
        storedindex.DEAD_IDS = kept
    assert shown(storedindex.postings(spark, path)) == shown(textindex.build_index(rows.filter("id <> 20")))


def test_words_of_requests_are_looked_up_once_for_all_pages(spark):
    rows = listings(spark, 60)
    asked = spark.createDataFrame([(i, ["red", None, "the", "absent"][i % 4], ["relevance", "newest", "company"][i % 3], [None, " New Grad", "Junior "][i % 3]) for i in range(24)], "query_id long, q string, sort string, career_stage string")
    index, looked = textindex.build_index(rows), []
    hits = jobs.found_once(asked, 30, lambda queries: looked.append(sorted(r.q for r in queries.collect())) or textindex.match_texts(index, queries))
    shown = lambda df: sorted((r.query_id, r.position, r.id, r.total) for r in df.collect())
    first = jobs.search_jobs(rows, asked, NOW, 30, 2, hits).cache()
    second = shown(jobs.search_jobs(rows, jobs.next_page(asked, first), NOW, 30, 2, hits))
    assert looked == [["absent", "red", "the"]] and second
    assert shown(first) == shown(jobs.search_jobs(rows, asked, NOW, 30, 2))
    assert second == shown(jobs.search_jobs(rows, jobs.next_page(asked, first), NOW, 30, 2))


def test_no_text_is_read_for_filters_without_words(spark, monkeypatch):
    """Every page of requests had all texts cut into words for those that have none."""
    read, plain = [], percolator.build_index
    monkeypatch.setattr(percolator, "build_index", lambda df, terms=None: read.append(df.count()) or plain(df, terms))
    kept = alerts.typed_searches(searches(spark)).cache()
    pairs = lambda asked: sorted((r.search_id, r.id) for r in alerts.found_by(asked, listings(spark, 40), NOW).select("search_id", "id").collect())
    every, bare = pairs(kept), pairs(kept.filter("q is null"))
    quiet = {r.search_id for r in kept.filter("q is null").collect()}
    assert read[0] > 0 and read[1] == 0 and bare == [p for p in every if p[0] in quiet] and bare


def test_postings_are_written_where_they_are_made(spark, tmp_path):
    """All postings were shuffled and sorted by as many tasks as there are buckets."""
    rows, path = listings(spark, 40).repartition(6), str(tmp_path / "index")
    storedindex.create(rows, path, 2)
    files = [f for f in (tmp_path / "index" / "postings-0").iterdir() if f.name.endswith(".parquet")]
    assert len(files) > 6  # of six tasks, not one for each of two buckets
    shown = lambda df: sorted((r.id, r.term, round(r.weighted, 9), tuple(r.positions), r.doc_length) for r in df.collect())
    assert shown(storedindex.postings(spark, path)) == shown(textindex.build_index(rows))


def test_a_part_of_a_result_has_few_texts(spark):
    """Parts held rows of all texts, so the queries of each stood in no order that a file could be made small by."""
    asked = spark.range(320).select((F.col("id") % 64).alias("speaker"), F.col("id").alias("query_id"))
    rows = spark.range(64 * 50).select((F.col("id") % 64).alias("query_id"), F.floor(F.col("id") / 64).alias("id"))
    out = textindex.for_all(rows, asked)
    assert out.count() == 64 * 50 * 5 == out.distinct().count()
    parts = out.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct(F.col("query_id") % 64).alias("n")).collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(r.n for r in parts) <= 16
