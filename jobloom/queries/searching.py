"""Text and vector search over many queries, and the embedding pass."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.functions import enrich
from jobloom.operators import filters, throttle
from jobloom.operators.matching import profile_side
from jobloom.operators.ranking import relevance_order
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.projections import DOC, GROW
from jobloom.queries.sql_views import AS_OF, FRESH, TRUST, any_like, arr, q, with_enriched
from jobloom.search import embedding, hybrid, intent, textindex, vectors

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS
TOK = r"'[\pL\p{Nd}]+[+#]*'"


def toks(c, w):
    return f"list_transform(regexp_extract_all(lower({c}), {TOK}), lambda t: {{'term': t, 'w': {w}}})"


DOCS = f"""docs AS (SELECT id, list_concat(list_concat({toks('title', 1.0)}, {toks('company_name', 1.0)}), list_concat({toks("array_to_string(skills, ' ')", 0.4)}, {toks('description_text', 0.2)})) AS fields FROM enriched),
idx AS (SELECT id, f.term AS term, sum(f.w) AS weighted, count(*) AS tf FROM (SELECT id, unnest(fields) AS f FROM docs) GROUP BY ALL)"""
# Searches read by the same rules: alternatives, atoms, their words.
ATOMS = f"""alternatives AS (SELECT query_id, unnest(range(len(p))) AS alt, unnest(p) AS said FROM (SELECT query_id, string_split(q, ' OR ') AS p FROM query_set)),
spoken AS (SELECT query_id, alt, unnest(range(len(p))) AS atom, unnest(p) AS raw FROM (SELECT *, regexp_extract_all(said, '-?"[^"]*"|\\S+') AS p FROM alternatives)),
atoms AS (SELECT query_id, alt, atom, starts_with(raw, '-') AS neg, regexp_extract_all(lower(raw), {TOK}) AS words FROM spoken)"""
HITS = """need AS (SELECT query_id, alt, count(*) AS needed FROM atoms WHERE NOT neg GROUP BY ALL), lines AS (SELECT id, ' ' || array_to_string(list_transform(fields, lambda f: f.term), ' ') || ' ' AS line, len(fields) AS n FROM docs),
ah AS (SELECT query_id, alt, atom, neg, id, sum(weighted) AS weighted FROM (SELECT *, unnest(words) AS term FROM atoms) JOIN idx USING (term) JOIN lines USING (id) GROUP BY query_id, alt, atom, neg, id, words
  HAVING count(*) = len(words) AND (len(words) = 1 OR contains(any_value(line), ' ' || array_to_string(words, ' ') || ' '))),
alts AS (SELECT query_id, alt, id, sum(weighted) AS weighted FROM ah JOIN need USING (query_id, alt) WHERE NOT neg GROUP BY query_id, alt, id, needed HAVING count(*) = needed),
hits AS (SELECT query_id, id, sum(weighted) / (1 + ln(any_value(n))) AS text_rank FROM alts JOIN lines USING (id) WHERE (query_id, alt, id) NOT IN (SELECT (query_id, alt, id) FROM ah WHERE neg) GROUP BY ALL)"""
TEXT = ", ".join([DOCS, sv.QUERY_SET, ATOMS, HITS])


@query("build_index", "T1", with_enriched("SELECT id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS postings, round(sum(weighted), 4) AS weighted FROM idx GROUP BY id", DOCS))
def _(spark, sf):
    index = textindex.build_index(fx.enriched(spark, sf))
    return index.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.size("positions")).alias("postings"), F.round(F.sum("weighted"), 4).alias("weighted"))


@query("match_queries", "T2", with_enriched("SELECT query_id, id, round(text_rank, 6) AS text_rank FROM hits", TEXT))
def _(spark, sf):
    e, qs = fx.enriched(spark, sf), fx.query_set(spark, sf)
    index = textindex.build_index(e, textindex.search_words(textindex.search_atoms(qs)))
    return textindex.match_queries(index, qs).select("query_id", "id", F.round("text_rank", 6).alias("text_rank"))


FADED = f"text_rank * exp(-greatest((epoch_us({AS_OF}) - epoch_us(anchor)) / 86400000000.0, 0) / 7.0)"
CHANGED = "id % 3 = 0"
# What the listings look like after the upkeep: some retitled, some gone.
KEPT_UP = f"""before AS (SELECT * FROM enriched), later AS (SELECT * REPLACE (CASE WHEN {CHANGED} THEN 'Anvil ' || title ELSE title END AS title) FROM before WHERE id % 7 <> 2)"""
LATER_DOCS = DOCS.replace("FROM enriched", "FROM later")


def upkept_index(spark, sf):
    """A stored index of the old listings, brought up to date by segments; where it is."""
    from jobloom.runtime import shared_folder
    from jobloom.search import storedindex

    old, where = fx.stored(spark, sf), shared_folder(spark, "kept-index")
    storedindex.create(old, where, 8)
    changed = old.filter(CHANGED).withColumn("title", F.concat(F.lit("Anvil "), "title"))
    storedindex.refresh(where, changed.filter("id % 2 = 0"), old.filter("id % 7 = 2"), 8)
    storedindex.refresh(where, changed.filter("id % 7 <> 2"), None, 8)
    return where


@query("upkept_index_search", "T1 T2 D1", with_enriched("SELECT query_id, id, round(text_rank, 6) AS text_rank FROM hits", ", ".join([KEPT_UP, LATER_DOCS, sv.QUERY_SET, ATOMS, HITS])))
def _(spark, sf):
    from jobloom.search import storedindex

    hits = storedindex.match_stored(spark, upkept_index(spark, sf), fx.query_set(spark, sf))
    return hits.select("query_id", "id", F.round("text_rank", 6).alias("text_rank"))


@query("compacted_index", "T1", with_enriched("SELECT id, term, tf, round(weighted, 6) AS weighted FROM idx", ", ".join([KEPT_UP, LATER_DOCS])))
def _(spark, sf):
    from jobloom.search import storedindex

    where = upkept_index(spark, sf)
    storedindex.compact(spark, where, 8)
    return storedindex.postings(spark, where).select("id", "term", F.size("positions").cast("long").alias("tf"), F.round("weighted", 6).alias("weighted"))


REQUESTS = """requests AS (SELECT query_id, k, CASE WHEN k % 4 <> 3 THEN q END AS q, CASE k % 4 WHEN 1 THEN 'newest' WHEN 2 THEN 'company' WHEN 3 THEN 'newest' ELSE 'relevance' END AS sort FROM (SELECT *, query_id // 50 AS k FROM query_set))"""
MATCHED = f"""matched AS (SELECT r.query_id, e.*, round(coalesce({FADED}, 0), 12) AS rank, r.sort FROM requests r JOIN enriched e ON true LEFT JOIN hits h ON h.query_id = r.query_id AND h.id = e.id
  WHERE {FRESH} AND (r.q IS NULL OR h.id IS NOT NULL) AND (k % 5 <> 1 OR workplace_type = 'remote') AND (k % 6 <> 2 OR junior_eligible) AND (k % 6 <> 4 OR career_stage = 'senior')
  AND (k % 7 <> 3 OR list_has_any(skills, ['the', 'le']) OR list_has_any(tech_tags, ['the', 'le'])) AND (k % 8 <> 2 OR coalesce(contains(lower(location_raw), 'berlin'), false)) AND (k % 9 <> 4 OR contains(lower(company_name), 'supplier'))
  AND (k % 10 <> 5 OR anchor >= {AS_OF} - INTERVAL 3 DAY) AND (k % 11 <> 6 OR region_friendly))"""
PLACED = f"""standing AS (SELECT query_id, id, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN sort = 'company' THEN lower(company_name) ELSE '' END, CASE WHEN sort = 'relevance' THEN -rank END,
  CASE WHEN sort = 'relevance' THEN {TRUST} END, CASE WHEN sort = 'relevance' THEN posted_at IS NULL END, posted_at DESC NULLS LAST, CASE WHEN sort = 'newest' THEN first_seen_at END DESC, CASE WHEN sort = 'newest' THEN {TRUST} END, id) AS place FROM matched)"""
JOBS_SQL = ", ".join([TEXT, REQUESTS, MATCHED, PLACED])


@query("search_jobs", "T6 O1 O2 O3 O4 F3 F4 F5 F6 G14", with_enriched("SELECT query_id, id, place AS position, 21.0 - place AS score, total FROM standing WHERE place <= 20", JOBS_SQL))
def _(spark, sf):
    from jobloom.search import jobs

    return jobs.search_jobs(fx.stored(spark, sf), fx.job_requests(spark, sf), NOW, DAYS).drop("key")


@query("search_jobs_next_page", "O4 S6", with_enriched("SELECT query_id, id, place - 5 AS position, 11.0 - place AS score, total FROM standing WHERE place > 5 AND place <= 10", JOBS_SQL))
def _(spark, sf):
    from jobloom.runtime import settle, shared_folder
    from jobloom.search import jobs, storedindex

    rows, asked, where = fx.stored(spark, sf), fx.job_requests(spark, sf), shared_folder(spark, "jobs-index")
    storedindex.create(rows, where, 8)
    hits = jobs.found_once(asked, DAYS, lambda queries: storedindex.match_stored(spark, where, queries))
    first = settle(jobs.search_jobs(rows, asked, NOW, DAYS, 5, hits), "page")
    return jobs.search_jobs(rows, jobs.next_page(asked, first), NOW, DAYS, 5, hits).drop("key")


@query("stored_index_search", "T1 T2", with_enriched("SELECT query_id, id, round(text_rank, 6) AS text_rank FROM hits", TEXT))
def _(spark, sf):
    from jobloom.runtime import shared_folder

    where = shared_folder(spark, "index")
    textindex.write_index(textindex.build_index(fx.enriched(spark, sf)), where)
    hits = textindex.match_queries(spark.read.parquet(where), fx.query_set(spark, sf))
    return hits.select("query_id", "id", F.round("text_rank", 6).alias("text_rank"))


@query("ranked_search", "T3 O1", with_enriched(f"SELECT query_id, id, round({FADED}, 6) AS rank FROM hits JOIN enriched USING (id) WHERE {FRESH}", TEXT))
def _(spark, sf):
    live = filters.fresh(fx.stored(spark, sf), NOW, DAYS)
    return textindex.search(live, fx.query_set(spark, sf), NOW).select("query_id", "id", F.round("rank", 6).alias("rank"))


PRIORITY = f"list_filter({arr(lx.QUERY_PRIORITY_SKILLS)}, lambda p: list_contains(uni, p))"


@query("search_query", "T4", f"""WITH {sv.PROFILES}, u AS (SELECT user_id, desired_roles, {GROW('list_concat(skills, technologies)')} AS uni FROM profiles)
  SELECT user_id, coalesce(desired_roles[1], CASE WHEN len({PRIORITY}) > 0 THEN array_to_string({PRIORITY}[1:4], ' OR ')
    WHEN len(uni) > 0 THEN array_to_string(list_transform(list_sort(list_transform(uni, lambda s: {{'n': length(s), 's': s}}))[1:4], lambda x: x.s), ' OR ') END, {q(lx.QUERY_FALLBACK)}) AS q FROM u""")
def _(spark, sf):
    return profile_side(fx.profiles(spark, sf)).select("user_id", intent.search_query(C("desired_roles"), C("universe")).alias("q"))


LOW = "(' ' || lower(q) || ' ')"
STAGE_SQL = "CASE " + " ".join(f"WHEN {any_like(LOW, ns)} THEN {q(s)}" for ns, s in lx.INTENT_STAGES) + " END"
HINT_SKILLS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains({LOW}, {q(n)}) THEN {q(s)} END" for n, s in lx.INTENT_SKILLS) + "], lambda x: x IS NOT NULL)))"
HINTS = f"hints AS (SELECT query_id, q, CASE WHEN {any_like(LOW, lx.INTENT_REMOTE_WORDS)} THEN 'remote' END AS hint_workplace, {STAGE_SQL} AS hint_stage, {any_like(LOW, lx.INTENT_REGION_WORDS)} AS hint_region, {HINT_SKILLS} AS hint_skills FROM query_set)"


@query("parse_intent", "T5", f"WITH {sv.QUERY_SET}, {HINTS} SELECT query_id, hint_workplace, hint_stage, hint_region, array_to_string(hint_skills, '|') AS hint_skills FROM hints")
def _(spark, sf):
    return intent.parse_intent(fx.query_set(spark, sf)).select("query_id", "hint_workplace", "hint_stage", "hint_region", "hint_skills")


POSITION = "SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS position FROM events"


@query("rank_positions", "W5", POSITION + " QUALIFY position <= 50")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(C("user_id").alias("query_id"), C("event_id").alias("id"), "value")
    return hybrid.rank_positions(e, [F.desc("value"), F.asc("id")], 50)


@query("rank_fusion", "U3", f"SELECT query_id, id, round(sum(1.0 / (60 + position)), 9) AS fused FROM ({POSITION} QUALIFY position <= 50 UNION ALL {POSITION.replace('value DESC', 'ts DESC')} QUALIFY position <= 50) GROUP BY ALL")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(C("user_id").alias("query_id"), C("event_id").alias("id"), "value", "ts")
    a = hybrid.rank_positions(e, [F.desc("value"), F.asc("id")], 50)
    b = hybrid.rank_positions(e, [F.desc("ts"), F.asc("id")], 50)
    return hybrid.reciprocal_rank_fusion(a, b).select("query_id", "id", F.round("fused", 9).alias("fused"))


QVEC = "qv AS (SELECT vec_id AS query_id, embedding AS query_vector FROM embeddings WHERE vec_id % 50 = 0)"
COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query_vector AS DOUBLE[]))"


@query("vector_topk", "O5", sv.with_listings(f"SELECT query_id, id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, id) AS position FROM qv, listings WHERE {FRESH} AND embedding IS NOT NULL QUALIFY position <= 50", QVEC))
def _(spark, sf):
    live = filters.fresh(fx.listings(spark, sf), NOW, DAYS)
    top = vectors.vector_topk(live, fx.query_vectors(spark, sf), 50)
    return top.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "position")


LISTS, PROBES = 32, 26
UNIT_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
IVF = f"""rowset AS (SELECT id, embedding FROM listings WHERE {FRESH} AND embedding IS NOT NULL), centres AS (SELECT id AS list, embedding AS centre FROM rowset ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT {LISTS}),
placed AS (SELECT id, embedding, list FROM rowset, centres QUALIFY row_number() OVER (PARTITION BY id ORDER BY {UNIT_COS.format('embedding', 'centre')} DESC, list) = 1),
probed AS (SELECT query_id, query_vector, list FROM qv, centres QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {UNIT_COS.format('query_vector', 'centre')} DESC, list) <= {PROBES})"""


@query("ann_topk", "T7", sv.with_listings(f"SELECT query_id, id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, id) AS position FROM probed JOIN placed USING (list) QUALIFY position <= 10", QVEC + ", " + IVF))
def _(spark, sf):
    from jobloom.runtime import shared_folder

    live = filters.fresh(fx.listings(spark, sf), NOW, DAYS).select("id", "embedding")
    centres, where = vectors.fit_lists(live, LISTS), shared_folder(spark, "lists")
    vectors.write_lists(live, where, centres)
    return vectors.ann_topk(spark.read.parquet(where), fx.query_vectors(spark, sf), centres, PROBES, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "position")


OBEYS = """(hint_workplace IS NULL OR workplace_type = hint_workplace) AND (NOT hint_region OR region_friendly) AND (len(hint_skills) = 0 OR list_has_any(skills, hint_skills) OR list_has_any(tech_tags, hint_skills))
  AND CASE hint_stage WHEN 'junior' THEN junior_eligible AND NOT (career_stage IN ('junior', 'new_grad') AND coalesce(years_required_min >= 4, false)) ELSE hint_stage IS NULL OR career_stage = hint_stage END"""
HYBRID = f"""th AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {FADED} DESC, {TRUST}, CASE WHEN posted_at IS NULL THEN 1 ELSE 0 END, posted_at DESC NULLS LAST, id) AS position FROM hits JOIN enriched USING (id) JOIN hints USING (query_id) WHERE {FRESH} AND {OBEYS}),
vh AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, id) AS position FROM qv JOIN hints USING (query_id), enriched WHERE {FRESH} AND embedding IS NOT NULL AND {OBEYS} QUALIFY position <= 50),
fused AS (SELECT query_id, id, sum(1.0 / (60 + position)) AS score FROM (SELECT * FROM th WHERE position <= 50 UNION ALL SELECT * FROM vh) GROUP BY ALL)"""


@query("hybrid_search", "T6 J9 U3 W5 O4", with_enriched("""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS position, round(score, 9) AS score,
  greatest(count(*) OVER (PARTITION BY query_id), coalesce((SELECT count(*) FROM th WHERE th.query_id = fused.query_id), 0)) AS total FROM fused QUALIFY position <= 20""", ", ".join([TEXT, HINTS, QVEC, HYBRID])))
def _(spark, sf):
    out = hybrid.hybrid_search(fx.stored(spark, sf), fx.query_set(spark, sf), fx.query_vectors(spark, sf), NOW, DAYS)
    return out.select("query_id", "id", "position", F.round("score", 9).alias("score"), "total")


@query("hybrid_search_page_six", "T6 O4", with_enriched("""SELECT query_id, id, position, 121.0 - position AS score, greatest((SELECT count(*) FROM fused f WHERE f.query_id = th.query_id), count(*) OVER (PARTITION BY query_id)) AS total
  FROM th WHERE query_id IN (SELECT query_id FROM fused) QUALIFY position > 100 AND position <= 120""", ", ".join([TEXT, HINTS, QVEC, HYBRID])))
def _(spark, sf):
    return hybrid.hybrid_search(fx.stored(spark, sf), fx.query_set(spark, sf), fx.query_vectors(spark, sf), NOW, DAYS, page=6)


PER_SEC = "sec AS (SELECT user_id AS key, epoch_us(ts) // 1000000 AS sec, count(*) AS n FROM events GROUP BY ALL)"


@query("throttle_bound", "T8", f"WITH {PER_SEC}, t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key ORDER BY sec RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_period FROM sec) SELECT key, sec, n, in_period, greatest(0, least(n, in_period - 3)) AS over FROM t")
def _(spark, sf):
    return throttle.trailing_counts(fx.request_log(spark, sf), 3, 21_600)


ACCEPT = """s AS (SELECT user_id AS key, event_id, ts, epoch_us(ts) // 1000000 AS sec FROM events),
acc AS (SELECT key, list_reduce(list_concat([CAST([] AS BIGINT[])], list_transform(list(sec ORDER BY sec), lambda x: [x])), lambda a, b: CASE WHEN len(list_filter(a, lambda y: y > b[1] - 21600)) < 3 THEN list_concat(a, b) ELSE a END) AS taken FROM s GROUP BY key)"""


@query("throttle", "T8", f"WITH {ACCEPT} SELECT event_id, key, row_number() OVER (PARTITION BY key, sec ORDER BY ts, event_id) <= len(list_filter(taken, lambda x: x = sec)) AS allowed FROM s JOIN acc USING (key)")
def _(spark, sf):
    return throttle.throttle(fx.request_log(spark, sf), 3, 21_600).select("event_id", "key", "allowed")


HASHED = f"hashed AS (SELECT *, left(sha256({DOC}), 40) AS new_hash FROM enriched)"
KEPT = "(embedding IS NOT NULL AND embedding_provider = 'a' AND id % 3 = 1)"
DUE = f"{FRESH} AND apply_url IS NOT NULL AND NOT {KEPT}"


def hashed(spark, sf):
    """Listings whose vector is of an old text, of the present one, or of none known."""
    df = fx.enriched(spark, sf)
    now = enrich.embedding_hash(*[C(c) for c in ("title", "company_name", "skills", "career_stage", "workplace_type", "description_text")])
    return df.withColumn("embedding_hash", F.when(C("id") % 3 == 0, "old").when(C("id") % 3 == 1, now))


@query("plan_embedding", "T9 F8 P21", with_enriched(f"SELECT id, new_hash, CASE WHEN row_number() OVER (ORDER BY last_seen_at DESC, id) <= 100 THEN 'selected' ELSE 'deferred' END AS outcome FROM hashed WHERE {DUE} UNION ALL SELECT id, new_hash, 'skipped' FROM hashed WHERE {FRESH} AND apply_url IS NOT NULL AND {KEPT}", HASHED))
def _(spark, sf):
    return embedding.plan_embedding(hashed(spark, sf), "a", NOW, DAYS, 100).select("id", "new_hash", "outcome")


@query("embed_pass_stats", "G13 T9", with_enriched(f"SELECT least(count(*), 100) AS candidates, least(count(*), 100) AS processed, 0 AS skipped, 0 AS failed, 0 AS remaining, 'SUCCESS' AS status FROM hashed WHERE {DUE}", HASHED))
def _(spark, sf):
    from jobloom.operators.rollups import embed_pass_stats

    return embed_pass_stats(embedding.incremental_embed(hashed(spark, sf), "a", NOW, DAYS, 100))


@query("search_pages", "O1 O4 T3", with_enriched(f"SELECT query_id, id, 11.0 - row_number() OVER (PARTITION BY query_id ORDER BY {FADED} DESC, {TRUST}, CASE WHEN posted_at IS NULL THEN 1 ELSE 0 END, posted_at DESC NULLS LAST, id) AS score FROM hits JOIN enriched USING (id) WHERE {FRESH} QUALIFY score > 0", TEXT))
def _(spark, sf):
    from jobloom.operators.ranking import page_per_query

    live = filters.fresh(fx.stored(spark, sf), NOW, DAYS)
    asked, speakers = textindex.one_per_text(fx.query_set(spark, sf))
    page = page_per_query(textindex.search_texts(live, speakers, NOW), relevance_order(), 10)
    return textindex.for_all(page.select("query_id", "id", "score"), asked).select("query_id", "id", "score")
