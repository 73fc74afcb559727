"""Scalar expressions over the whole catalogue."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.functions import enrich, markup, origin, places, seniority, tags, text as tx, times, urls
from jobloom.operators import lifecycle, rollups
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.sql_views import any_like, arr, q, rx, squash, strip, with_enriched, with_listings
from jobloom.runtime import union_all
from jobloom.sources import export

C = F.col
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(c, i):
    return f"regexp_extract({c}, {q(URI)}, {i})"


def host_sql(c):
    return f"lower(regexp_extract({part(c, 2)}, '^(?:.*@)?([^@:]*)(?::[0-9]*)?$', 1))"


@query("normalize_url", "P1", with_listings(
    "SELECT id, regexp_replace(regexp_replace(apply_url, '#.*$', ''), '\\?$', '') AS url FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", urls.normalize_url(C("apply_url")).alias("url"))


TRACK = ", ".join(q(k) for k in lx.TRACKING_KEYS)
PAIRS = f"""list_sort(list_filter(list_transform(string_split({part('apply_url', 4)}, '&'), lambda kv: [url_decode(split_part(kv, '=', 1)), url_decode(regexp_extract(kv, '^[^=]*=(.*)$', 1))]), lambda p: p[2] <> '' AND lower(p[1]) NOT IN ({TRACK})))"""
CANON = f"""'https://' || regexp_replace({host_sql('apply_url')}, '^www\\.', '') ||
  CASE WHEN {part('apply_url', 3)} = '/' THEN '/' ELSE regexp_replace({part('apply_url', 3)}, '/$', '') END ||
  CASE WHEN len({PAIRS}) > 0 THEN '?' || array_to_string(list_transform({PAIRS}, lambda p: url_encode(p[1]) || '=' || url_encode(p[2])), '&') ELSE '' END"""


@query("canonical_apply_url", "P2", with_listings(f"SELECT id, {CANON} AS url, lower({CANON}) AS batch_key FROM listings"))
def _(spark, sf):
    u = C("apply_url")
    return fx.listings(spark, sf).select("id", urls.canonical_apply_url(u).alias("url"), urls.batch_apply_key(u).alias("batch_key"))


KEY = "lower(regexp_replace(regexp_replace(split_part(regexp_replace(apply_url, '^https?://(www\\.)?', '', 'i'), '?', 1), '/$', ''), '#.*$', ''))"


@query("catalogue_apply_key", "P3", with_listings(f"SELECT id, {KEY} AS apply_key FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", urls.catalogue_apply_key(C("apply_url")).alias("apply_key"))


@query("apply_url_is_usable", "P4", with_listings(
    f"SELECT id, {host_sql('apply_url')} NOT IN ({', '.join(q(h) for h in lx.API_HOSTS)}) AND {host_sql('apply_url')} <> '' AND {part('apply_url', 1)} IN ('http', 'https') AS usable FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", urls.apply_url_is_usable(C("apply_url")).alias("usable"))


INSTANT_FORMS = """
  SELECT event_id, 'iso' AS form, ts AS at FROM events
  UNION ALL SELECT event_id, 'zulu', date_trunc('second', ts) FROM events
  UNION ALL SELECT event_id, 'offset', date_trunc('second', ts) FROM events
  UNION ALL SELECT event_id, 'epoch', date_trunc('second', ts) FROM events
  UNION ALL SELECT event_id, 'millis', date_trunc('millisecond', ts) FROM events
  UNION ALL SELECT event_id, 'mail', date_trunc('second', ts) FROM events
  UNION ALL SELECT event_id, 'day', date_trunc('day', ts) FROM events
  UNION ALL SELECT event_id, 'bad', NULL FROM events"""


@query("parse_instant", "P5", INSTANT_FORMS)
def _(spark, sf):
    ts = fx.instant("ts")
    shifted = F.timestamp_micros(F.unix_micros(ts) + 19_800_000_000)
    forms = {
        "iso": F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "zulu": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "offset": F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530")),
        "epoch": F.unix_seconds(ts).cast("string"), "millis": F.unix_millis(ts).cast("string"),
        "mail": F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'GMT'"), "day": F.date_format(ts, "yyyy-MM-dd"),
        "bad": F.concat(F.lit("soon "), F.date_format(ts, "yyyy")),
    }
    rows = fx.table(spark, sf, "events").select("event_id", F.explode(F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])).alias("form", "said"))
    return rows.select("event_id", "form", times.parse_instant(C("said")).alias("at"))


WP_BLOB = "lower(concat_ws(' ', nullif(location_raw, ''), nullif(description_text, '')))"


@query("workplace_type", "P6", with_listings(f"""SELECT id, CASE WHEN {rx(WP_BLOB, r'\bhybrid\b')} THEN 'hybrid'
  WHEN {rx(WP_BLOB, r'\b(on[\s-]?site|in[\s-]?office|office[\s-]?based)\b')} THEN 'onsite'
  WHEN {rx(WP_BLOB, r'\b(remote|work from home|wfh|distributed|anywhere)\b')} THEN 'remote' ELSE 'unknown' END AS workplace FROM listings"""))
def _(spark, sf):
    return fx.listings(spark, sf).select(
        "id", enrich.workplace_type(C("location_raw"), F.lit(None).cast("string"), C("description_text")).alias("workplace"))


@query("extract_skills", "P7", with_listings(
    f"SELECT id, array_to_string({sv.skill_list(sv.BLOB, sv.SQL_LEXICON)}, '|') AS skills, array_to_string(list_sort(list_distinct(list_concat(['zig'], {sv.skill_list(sv.BLOB, fx.CORPUS_LEXICON)}))), '|') AS tags FROM listings"))
def _(spark, sf):
    blob = enrich.listing_blob(C("title"), C("description_text"), C("location_raw"))
    return fx.listings(spark, sf).select(
        "id", enrich.extract_skills(blob).alias("skills"),
        enrich.extract_skills(blob, F.array(F.lit(" Zig "), F.lit("")), fx.CORPUS_LEXICON).alias("tags"))


@query("detect_city", "P8", with_listings(
    "SELECT id, CASE " + " ".join(f"WHEN contains(lower(location_raw), {q(k)}) THEN {q(v)}" for k, v in lx.CITY_LABELS) + " END AS city FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", enrich.detect_city(C("location_raw")).alias("city"))


@query("region_friendly", "P9", with_listings(f"SELECT id, {sv.REGION} AS friendly FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select(
        "id", enrich.region_friendly(C("workplace_type"), C("location_raw"), C("description_text")).alias("friendly"))


@query("career_stage", "P10", with_listings(f"SELECT id, {sv._STAGE} AS stage FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select(
        "id", seniority.career_stage(C("title"), C("description_text"), C("source_level"), C("employment_type")).alias("stage"))


@query("years_required_min", "P11", with_listings(f"SELECT id, {sv._YEARS} AS years FROM listings"))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", seniority.years_required_min(C("title"), C("description_text")).alias("years"))


def snippet(p):
    body = p.replace("(?i)\\b", "").removesuffix("\\b")
    return f"nullif(regexp_extract({sv.LINED}, {q('(?i)(?:^|[^A-Za-z0-9_])' + body + '(?:$|[^A-Za-z0-9_])')}, 1), '')"


@query("seniority_signals", "P12", with_listings(f"""SELECT id, {snippet(lx.NO_SPONSOR)} AS no_sponsorship_snippet, {snippet(lx.DEGREE)} AS degree_snippet,
  {snippet(lx.UNPAID)} AS unpaid_snippet, {snippet(lx.EQUIVALENT)} AS equivalent_snippet,
  CASE WHEN {snippet(lx.UNPAID)} IS NOT NULL THEN true END AS unpaid FROM listings"""))
def _(spark, sf):
    s = fx.listings(spark, sf).select("id", seniority.seniority_signals(C("title"), C("description_text"), C("source_level")).alias("s"))
    return s.select("id", "s.no_sponsorship_snippet", "s.degree_snippet", "s.unpaid_snippet", "s.equivalent_snippet", "s.unpaid")


@query("junior_eligible", "P13", with_enriched("SELECT id, junior_eligible FROM enriched"))
def _(spark, sf):
    staged = fx.listings(spark, sf).select("id", "title",
        seniority.career_stage(C("title"), C("description_text"), C("source_level"), C("employment_type")).alias("stage"),
        seniority.years_required_min(C("title"), C("description_text")).alias("years"))
    return staged.select("id", seniority.junior_eligible(C("stage"), C("years"), C("title")).alias("junior_eligible"))


CLASH = "(career_stage IN ('junior', 'new_grad') AND coalesce(years_required_min >= 4, false))"


@query("classify", "P14", with_enriched(f"""SELECT id, career_stage, years_required_min, junior_eligible AND NOT {CLASH} AS junior_eligible, employment_type,
  CASE WHEN {CLASH} THEN 'Title looks ' || career_stage || ' but JD asks ' || years_required_min || '+ years' END AS contradiction FROM enriched"""))
def _(spark, sf):
    return seniority.classify(fx.listings(spark, sf)).select(
        "id", "career_stage", "years_required_min", "junior_eligible", "employment_type", C("seniority_signals.contradiction").alias("contradiction"))


ROLE_TITLES = ["Software {}", "Sales {}", "{} architect", "Marketing {}", "QA {}", "{} recruiter", "{} plumber", "Data Engineer {}"]
ROLE_DEPTS = [["Engineering"], ["Sales"], [], None, ["IT Support", "Legal"]]


def role_rows(spark, sf):
    p = fx.table(spark, sf, "part").select(C("p_partkey").alias("id"), "p_name", "p_type")
    title = fx.pick(ROLE_TITLES, C("id") % 8)
    dept = F.element_at(F.array(*[(F.array(*[F.lit(x) for x in d]) if d is not None else F.lit(None)).cast("array<string>") for d in ROLE_DEPTS]), (C("id") % 5).cast("int") + 1)
    return p.select("id", F.replace(title, F.lit("{}"), C("p_name")).alias("title"), dept.alias("departments"), "p_type")


ROLE_CTE = f"""WITH r AS (SELECT p_partkey AS id, replace({sv.pick(ROLE_TITLES, 'p_partkey % 8')}, '{{}}', p_name) AS title,
  ([['Engineering'], ['Sales'], [], NULL, ['IT Support', 'Legal']])[p_partkey % 5 + 1] AS departments, p_type FROM part)"""


@query("looks_technical", "P15", ROLE_CTE + f""" SELECT id, NOT {any_like('lower(title)', lx.NON_TECH_TITLE_WORDS)} AND ({any_like('lower(title)', lx.TECH_TITLE_WORDS)}
  OR (len(list_filter(coalesce(departments, []), lambda d: {any_like('lower(d)', lx.TECH_DEPARTMENT_WORDS)})) > 0 AND {any_like('lower(title)', lx.TECH_DEPARTMENT_TITLES)})) AS technical FROM r""")
def _(spark, sf):
    return role_rows(spark, sf).select("id", tx.looks_technical(C("title"), C("departments")).alias("technical"))


@query("technical_category", "P16", ROLE_CTE + f" SELECT id, coalesce({any_like("lower(array_to_string(departments, ' '))", lx.TECH_CATEGORY_WORDS)}, false) AS technical FROM r")
def _(spark, sf):
    return role_rows(spark, sf).select("id", tx.technical_category(C("departments")).alias("technical"))


def hits_sql(c, words):
    return "(" + " + ".join(f"CAST(contains({c}, {q(w)}) AS INT)" for w in words) + ")"


WHOLE_BODY = r"lower(title || E'\n' || description_text)"


@query("software_role", "P17", with_listings(f"""SELECT id, {any_like('lower(title)', lx.SOFTWARE_TITLE_WORDS)}
  OR ({any_like('lower(title)', lx.TRAINING_TITLE_WORDS)} AND {any_like('lower(title)', lx.TRAINING_FIELD_WORDS)})
  OR ({hits_sql(WHOLE_BODY, lx.SOFTWARE_BODY_WORDS)} > 0 AND {hits_sql(WHOLE_BODY, lx.SOFTWARE_BODY_WORDS)} >= {hits_sql(WHOLE_BODY, lx.PHYSICAL_BODY_WORDS)}) AS software FROM listings"""))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", tx.software_role(C("title"), C("description_text")).alias("software"))


@query("source_trust", "P18", with_listings(f"""SELECT id, CASE {sv.TRUST} WHEN 0 THEN 'ats' WHEN 1 THEN 'curated_board' ELSE 'aggregator' END AS kind, {sv.TRUST} AS rank,
  CASE {sv.TRUST} WHEN 0 THEN 'Official ATS board' WHEN 1 THEN 'Curated job board' ELSE 'Job aggregator' END AS label, {sv.PREF} - 1 AS preference FROM listings"""))
def _(spark, sf):
    s = C("source")
    return fx.listings(spark, sf).select("id", origin.source_kind(s).alias("kind"), origin.source_rank(s).alias("rank"),
                                         origin.source_label(s).alias("label"), origin.source_preference(s).alias("preference"))


@query("clip_row", "P19", with_listings("""SELECT id, left(repeat(title, 40), 500) AS title, left(repeat(company_name, 20), 240) AS company_name,
  left(repeat(location_raw, 60), 480) AS location_raw, left(apply_url || repeat('x', 2000), 2000) AS apply_url, 40 AS n_skills FROM listings"""))
def _(spark, sf):
    wide = fx.listings(spark, sf).select("id", F.repeat("title", F.lit(40)).alias("title"), F.repeat("company_name", F.lit(20)).alias("company_name"),
        F.repeat("location_raw", F.lit(60)).alias("location_raw"), F.concat("apply_url", F.repeat(F.lit("x"), F.lit(2000))).alias("apply_url"),
        F.array_repeat(C("source"), 45).alias("skills"))
    return lifecycle.clip_row(wide).select("id", "title", "company_name", "location_raw", "apply_url", F.size("skills").alias("n_skills"))


@query("fingerprint", "P20", with_enriched(f"SELECT id, {squash('lower(title)')} || '|' || {squash('lower(company_name)')} || '|' || career_stage AS fingerprint FROM enriched"))
def _(spark, sf):
    e = fx.enriched(spark, sf)
    return e.select("id", tx.fingerprint(F.concat(F.lit("  "), C("title"), F.lit(" ")), C("company_name"), C("career_stage")).alias("fingerprint"))


DOC = r"concat_ws(E'\n', title, company_name, 'Skills: ' || array_to_string(skills, ', '), 'Stage: ' || career_stage, 'Workplace: ' || workplace_type, nullif(description_text, ''))"


@query("embedding_document", "P21", with_enriched(f"SELECT id, length({DOC}) AS document_length, left(sha256({DOC}), 40) AS hash FROM enriched"))
def _(spark, sf):
    parts = [C(c) for c in ("title", "company_name", "skills", "career_stage", "workplace_type", "description_text")]
    return fx.enriched(spark, sf).select("id", F.length(enrich.embedding_document(*parts)).alias("document_length"), enrich.embedding_hash(*parts).alias("hash"))


TITLE_SLUG = "trim(lower(regexp_replace(title, '[^a-zA-Z0-9]+', '-', 'g')), '-')"
PUBLIC = f"'https://jobs.smartrecruiters.com/' || split_part(external_id, ':', 1) || '/' || split_part(external_id, ':', 2) || CASE WHEN {TITLE_SLUG} = '' THEN '' ELSE '-' || {TITLE_SLUG} END || '?oga=true'"
BROKEN = "source = 'smartrecruiters' AND apply_url ILIKE '%api.smartrecruiters.com/%'"


@query("repair_source_url", "P22", with_listings(f"""SELECT id, CASE WHEN {BROKEN} THEN {PUBLIC} ELSE apply_url END AS repaired,
  CASE WHEN apply_url ILIKE '%api.smartrecruiters.com/%' THEN CASE WHEN source = 'smartrecruiters' THEN {PUBLIC} END ELSE apply_url END AS visible FROM listings"""))
def _(spark, sf):
    four = [C(c) for c in ("source", "external_id", "title", "apply_url")]
    return fx.listings(spark, sf).select("id", urls.repair_source_url(*four).alias("repaired"), urls.visible_apply_url(*four).alias("visible"))


@query("slugify", "P23", """SELECT doc_id AS id, CASE WHEN slug = '' THEN 'company' ELSE slug END AS slug FROM (
  SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents)""")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(C("doc_id").alias("id"), tx.slugify(C("text")).alias("slug"))


@query("title_key", "P24", with_listings(f"""SELECT id, {strip("regexp_replace(regexp_replace(title, '(?i)\\s*[-|–—]\\s*(remote|hybrid|wfh|work from home).*$', ''), '(?i)\\s*\\((remote|hybrid)\\)\\s*$', '')")} AS key FROM listings"""))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", tx.title_key(C("title")).alias("key"))


def map_sql(table, value):
    return "MAP {" + ", ".join(f"{q(k)}: {value(v)}" for k, v in table.items()) + "}"


NORM_TAG = lambda t: f"coalesce({map_sql(lx.TAG_CANONICAL, q)}[lower({t})], lower({t}))"
GROW = lambda tags_: f"""list_sort(list_distinct(flatten(list_transform(list_transform({tags_}, lambda t: {NORM_TAG('t')}), lambda t: list_concat([t], coalesce({map_sql(tags.alias_table(), arr)}[t], []))))))"""


@query("expand_aliases", "P25", f"WITH {sv.PROFILES} SELECT user_id, array_to_string(list_transform(list_concat(skills, technologies), lambda t: {NORM_TAG('t')}), '|') AS tags, array_to_string({GROW('list_concat(skills, technologies)')}, '|') AS universe FROM profiles")
def _(spark, sf):
    both = F.concat("skills", "technologies")
    return fx.profiles(spark, sf).select("user_id", F.transform(both, tags.normalize_tag).alias("tags"), tags.expand_aliases(both).alias("universe"))


TOOLS, CAPS = ", ".join(q(x) for x in lx.KNOWN_TOOLS), ", ".join(q(x) for x in lx.KNOWN_CAPABILITIES)


def is_tool_sql(t):
    tool = f"""(CASE WHEN length({t}) < 2 THEN false WHEN {t} IN ({TOOLS}) THEN true WHEN {t} IN ({CAPS}) THEN false
      WHEN {any_like(t, lx.TOOL_FRAGMENTS)} AND {any_like(t, lx.TOOL_VETO_FRAGMENTS)} THEN false
      WHEN regexp_matches({t}, '^[a-z][a-z0-9+.#-]{{0,32}}$') THEN {t} NOT IN ('agile', 'scrum', 'leadership', 'mentoring', 'collaboration')
      ELSE regexp_matches({t}, ' (?:api|sdk|cli)$') END)"""
    cap = f"(CASE WHEN {t} IN ({CAPS}) THEN true WHEN {t} IN ({TOOLS}) THEN false ELSE {any_like(t, lx.CAPABILITY_FRAGMENTS)} END)"
    return f"(CASE WHEN {tool} <> {cap} THEN {tool} ELSE NOT contains({t}, ' ') END)"


EXTRA_TAGS = ["agile collaboration", "full-stack development", "oauth", "internal sdk", "Prompt Engineering", "zig", "llm integration"]
ORDERED = f"list_concat(list_concat(skills, technologies), [{sv.pick(EXTRA_TAGS, 'user_id % 7')}])"
BUCKETS = lambda t, names: f"list_has_any({t}, {arr(names)})"


@query("partition_tags", "P26", f"""WITH {sv.PROFILES},
  n AS (SELECT user_id, list_transform(CASE WHEN user_id % 3 = 0 THEN list_concat(skills, technologies) ELSE {ORDERED} END, lambda t: {NORM_TAG('t')}) AS raw FROM profiles),
  u AS (SELECT user_id, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS tags FROM n),
  s AS (SELECT user_id, list_filter(tags, lambda t: {is_tool_sql('t')}) AS tools, list_filter(tags, lambda t: NOT {is_tool_sql('t')}) AS caps FROM u)
  SELECT user_id, array_to_string(tools, '|') AS technologies, array_to_string(CASE WHEN len(caps) = 0 AND len(tools) > 0 THEN
    (CASE WHEN len(found) > 0 THEN found ELSE ['software development'] END) ELSE caps END, '|') AS skills
  FROM (SELECT *, list_filter([CASE WHEN {BUCKETS('tools', lx.BUCKET_FRONTEND)} THEN 'frontend development' END, CASE WHEN {BUCKETS('tools', lx.BUCKET_BACKEND)} THEN 'backend development' END,
    CASE WHEN (list_contains(tools, 'react') AND list_contains(tools, 'python')) OR (list_contains(tools, 'next.js') AND list_contains(tools, 'fastapi')) OR (list_contains(tools, 'typescript') AND list_contains(tools, 'python')) THEN 'full-stack development' END,
    CASE WHEN {BUCKETS('tools', lx.BUCKET_DEVOPS)} THEN 'devops' END, CASE WHEN {BUCKETS('tools', lx.BUCKET_AI)} THEN 'ai application development' END,
    CASE WHEN {BUCKETS('tools', lx.BUCKET_DATA)} THEN 'data modeling' END], lambda x: x IS NOT NULL) AS found FROM s)""")
def _(spark, sf):
    extra = F.when(C("user_id") % 3 != 0, F.array(fx.pick(EXTRA_TAGS, C("user_id") % 7)))
    both = fx.profiles(spark, sf).select("user_id", tags.partition_tags(C("skills"), C("technologies"), extra).alias("p"))
    return both.select("user_id", "p.technologies", "p.skills")


def text_sql(c):
    steps = [("(?is)<!--.*?-->", " "), (r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), ("(?s)<[!/a-zA-Z][^>]*>", " ")]
    for p, r in steps:
        c = f"regexp_replace({c}, {q(p)}, {q(r)}, 'g')"
    for a, b in markup.BASIC_ENTITIES:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"nullif({squash(c)}, '')"


@query("markup_text", "P27", f"SELECT page_id, {text_sql('html')} AS body FROM pages")
def _(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", markup.markup_text(C("html")).alias("body"))


def _replaced(c, *steps):
    for pattern, into in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {into}, 'g')"
    return c


# The constants of the rewrite, written out anew for the check.
GONE = [r"(?is)<!--.*?-->"] + [rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>" for n in "script style iframe object embed form input button svg noscript meta link head title".split()]
SAFE = r"(?i)<a\b[^>]*?\bhref\s*=\s*{0}\s*((?:https?://|mailto:|/[^/{0}])[^{0}<>]*){0}[^>]*>"
SAFE_SQL = "chr(1) || 'a href=\"\\1\" rel=\"noopener noreferrer nofollow\" target=\"_blank\"' || chr(2)"
STAY = r"(?i)<(/?)(p|br|hr|h2|h3|h4|strong|b|em|i|u|ul|ol|li|blockquote|a|span|div|section|pre|code)\b[^>]*>"
SHOWN_SQL = _replaced(
    "m", *[(g, "''") for g in GONE], (r"(?i)<(/?)h1\b", r"'<\1h2'"), (r"(?i)<(/?)h[56]\b", r"'<\1h3'"),
    (SAFE.format('"'), SAFE_SQL), (SAFE.format("'"), SAFE_SQL), (r"(?is)<a\b[^>]*>(.*?)</a\s*>", r"'\1'"),
    (STAY, r"chr(1) || '\1\2' || chr(2)"), (r"(?s)<[!/a-zA-Z][^>]*>", "''"),
)
CANONICAL_SQL = f"""WITH src AS (
    SELECT 'page' AS kind, page_id AS item, html AS source FROM pages
    UNION ALL SELECT 'document', doc_id, text FROM documents),
  seen AS (SELECT *, regexp_matches(source, {q(r'<\s*/?\s*[a-zA-Z][a-zA-Z0-9]*')}) AS raw, regexp_matches(source, {q(lx.ENCODED_TAG)}) AS enc FROM src),
  marked AS (SELECT kind, item, string_split(translate({SHOWN_SQL}, chr(1) || chr(2), '<>'), '</p>') AS ps
    FROM (SELECT kind, item, CASE WHEN raw THEN source ELSE {"replace(" * 8}source{"".join(f", {q(x)}, {q(y)})" for x, y in markup.BASIC_ENTITIES)} END AS m FROM seen WHERE raw OR enc)),
  by_p AS (SELECT kind, item, string_split(array_to_string(list_filter(ps, lambda x, i: i = 1 OR x <> ps[i - 1] OR length(regexp_replace(x, '<[^>]*>', '', 'g')) <= 80), '</p>'), '</li>') AS ls FROM marked),
  cleaned AS (SELECT kind, item, array_to_string(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1] OR length(regexp_replace(x, '<[^>]*>', '', 'g')) <= 80), '</li>') AS c FROM by_p),
  blocks AS (SELECT kind, item, list_filter(list_transform(string_split_regex(t, {q(chr(10) + "[ " + chr(9) + "]*" + chr(10) + "[ " + chr(9) + chr(10) + chr(12) + chr(13) + "]*")}),
      lambda b: list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '')), lambda b: len(b) > 0) AS bs
    FROM (SELECT kind, item, {_replaced("replace(replace(replace(translate(" + _replaced("source", (chr(13) + chr(10) + "?", "chr(10)")) + ", chr(1) || chr(2), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
      (r'\[([^\]\n]+)\]\((https?://[^\s)"]+|mailto:[^\s)"]+)\)', "'<a href=" + '"' + r"\2" + '"' + ' rel="noopener noreferrer nofollow" target="_blank">' + r"\1</a>'"))} AS t
      FROM seen WHERE NOT raw AND NOT enc)),
  written AS (SELECT kind, item, nullif(array_to_string(list_transform(bs, lambda b: CASE WHEN len(b) > 1 AND len(list_filter(b, lambda x: regexp_matches(x, {q('^(?:[-*•]|[0-9]+[.])[ ' + chr(9) + ']+')}))) = len(b)
      THEN '<ul>' || array_to_string(list_transform(b, lambda x: '<li>' || regexp_replace(x, {q('^(?:[-*•]|[0-9]+[.])[ ' + chr(9) + ']+')}, '') || '</li>'), '') || '</ul>'
      ELSE '<p>' || array_to_string(b, '<br/>') || '</p>' END), ''), '') AS c FROM blocks),
  every AS (SELECT kind, item, CASE WHEN {text_sql('c')} IS NOT NULL THEN trim(c) END AS c FROM (FROM cleaned UNION ALL FROM written))
  SELECT kind, item, c AS description_html_clean, {text_sql('c')} AS description_text_clean FROM every"""


@query("canonical_description", "P27", CANONICAL_SQL)
def _(spark, sf):
    none = F.lit(None).cast("string")
    pages = fx.table(spark, sf, "pages").select(F.lit("page").alias("kind"), C("page_id").alias("item"), C("html").alias("description_html"), none.alias("description_text"))
    texts = fx.table(spark, sf, "documents").select(F.lit("document").alias("kind"), C("doc_id").alias("item"), none.alias("description_html"), C("text").alias("description_text"))
    both = union_all([markup.canonical_description(pages), markup.canonical_description(texts)])
    return both.select("kind", "item", "description_html_clean", "description_text_clean")


OPEN_TAG_SQL = r"<\s*/?\s*[a-zA-Z][a-zA-Z0-9]*"


@query("description_audit", "P28", with_listings(f"""SELECT source, count(*) AS scanned,
  count(*) FILTER (WHERE NOT regexp_matches(description_html, {q(OPEN_TAG_SQL)}) AND regexp_matches(description_html, {q(lx.ENCODED_TAG)})) AS encoded_before,
  count(*) FILTER (WHERE contains(description_html, 'data-')) AS junk_before,
  count(*) FILTER (WHERE contains(description_text, '<p>') OR contains(description_text, '<li>')) AS leaked_before,
  count(*) FILTER (WHERE {text_sql('description_html')} IS DISTINCT FROM description_text) AS changed,
  count(*) FILTER (WHERE {text_sql('description_html')} IS NOT DISTINCT FROM description_text) AS unchanged FROM listings GROUP BY source"""))
def _(spark, sf):
    html, body = C("description_html"), C("description_text")
    return rollups.description_audit(
        fx.listings(spark, sf), markup.looks_encoded(html), html.contains("data-"), body.contains("<p>") | body.contains("<li>"),
        ~markup.markup_text(html).eqNullSafe(body))


EFFORT_HAY = f"lower({part('apply_url', 2)} || ' ' || apply_url || ' ' || source)"
EFFORT_CASE = lambda i: "CASE " + " ".join(f"WHEN contains(hay, {q(e[0])}) THEN {q(e[i]) if isinstance(e[i], str) else e[i]}" for e in lx.APPLY_EFFORT) + f" ELSE {q(lx.APPLY_EFFORT_DEFAULT[i - 1]) if i == 3 else lx.APPLY_EFFORT_DEFAULT[i - 1]} END"


@query("apply_effort", "P29", with_listings(f"SELECT id, lower({part('apply_url', 2)}) AS host, {EFFORT_CASE(1)} AS minutes_low, {EFFORT_CASE(2)} AS minutes_high, {EFFORT_CASE(3)} AS note FROM (SELECT *, {EFFORT_HAY} AS hay FROM listings)"))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", urls.apply_effort(C("apply_url"), C("source")).alias("e")).select("id", "e.*")


@query("onboarding_state", "P30", f"""WITH {sv.PROFILES}, f AS (SELECT user_id, len(skills) > 0 OR len(technologies) > 0 AS hs, resume_uploaded_at IS NOT NULL AS hr, coalesce(len(desired_roles), 0) > 0 AS hd,
  onboarding_skipped_at IS NOT NULL AS sk, onboarding_completed_at IS NOT NULL AS cf, technologies, skills FROM profiles)
  SELECT user_id, hs AS has_skills, hr AS has_resume, hd AS has_desired_roles, cf OR sk OR (hs AND (hr OR hd)) AS onboarding_complete,
  array_to_string((CASE WHEN len(technologies) > 0 THEN technologies ELSE skills END)[1:2], '|') AS seed_skills,
  CAST(round(100.0 * (CAST(hs AS INT) + CAST(hr OR sk AS INT) + CAST(hd OR sk AS INT) + 1) / 4) AS INT) AS completion_percent FROM f""")
def _(spark, sf):
    p = fx.profiles(spark, sf)
    state = tags.onboarding_state(C("skills"), C("technologies"), C("desired_roles"), C("remote_preference"), C("resume_uploaded_at"),
                                  C("onboarding_skipped_at"), C("onboarding_completed_at"), F.lit(None).cast("array<string>"))
    return p.select("user_id", state.alias("s")).select("user_id", "s.*")


BOARD_URLS = [
    "https://boards.greenhouse.io/co{}/jobs/1", "https://jobs.lever.co/co{}/x", "https://jobs.ashbyhq.com/Co{}", "https://co{}.recruitee.com/o/x",
    "https://co{}.wd3.myworkdayjobs.com/en-US/Site/job/1", "https://example.com/co{}", "https://www.greenhouse.io/co{}", "https://co{}.jobs.personio.de/job/1",
    "https://apply.workable.com/co{}/j/1", "https://careers.smartrecruiters.com/co{}",
]


def board_urls(spark, sf):
    return fx.table(spark, sf, "supplier").select(C("s_suppkey").alias("seq"), C("s_name").alias("name"), F.lit(None).cast("string").alias("website"),
        F.replace(fx.pick(BOARD_URLS, C("s_suppkey") % 10), F.lit("{}"), C("s_suppkey").cast("string")).alias("url"))


BOARD_CTE = f"found_urls AS (SELECT s_suppkey AS seq, s_name AS name, replace({sv.pick(BOARD_URLS, 's_suppkey % 10')}, '{{}}', CAST(s_suppkey AS VARCHAR)) AS url FROM supplier)"
BOARD_TYPE = "CASE seq % 10 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in [(0, 'greenhouse'), (1, 'lever'), (2, 'ashby'), (3, 'recruitee'), (4, 'workday'), (7, 'personio'), (8, 'workable'), (9, 'smartrecruiters')]) + " END"
BOARD_SLUG = "CASE WHEN seq % 10 IN (5, 6) THEN NULL WHEN seq % 10 = 2 THEN 'Co' || seq WHEN seq % 10 = 4 THEN 'co' || seq || '.wd3.myworkdayjobs.com|co' || seq || '|Site' ELSE 'co' || seq END"


@query("board_ref", "P31", f"WITH {BOARD_CTE} SELECT seq, {BOARD_TYPE} AS ats_type, {BOARD_SLUG} AS ats_slug FROM found_urls")
def _(spark, sf):
    return board_urls(spark, sf).select("seq", urls.board_ref(C("url")).alias("r")).select("seq", "r.ats_type", "r.ats_slug")


# Every employer of the fixed list, and near misses, as part of a board's name or slug; written out anew for the check.
NAMED_BOARDS = ["", " Careem Pay", " Motive", "-i2cinc", " Afiniti", " CureMD", " Techlogix", " tkxel ", " Cubix", " S&P Global", " spglobal", " Systems Limited", " Contour Software", " VentureDive", " folio 3", " Folio3", " Confiz", " Devsinc", " Arbisoft", " 10Pearls", " NetSol", " Bazaar", " Educative", " Securiti", " systemsltd", " i 2 c"]
REGION_SQL = f"""WITH {sv.REGISTRY}, named AS (SELECT seq, lower(coalesce(name, '') || {sv.pick(NAMED_BOARDS, f'seq % {len(NAMED_BOARDS)}')} || ' ' || coalesce(ats_slug, '')) AS k FROM registry)
  SELECT seq, CASE WHEN regexp_matches(k, 'careem|motive|afiniti|securiti|educative|bazaar|systemsltd|systemslimited|systems limited|arbisoft|10pearls|netsol|contoursoftware|contour software|venturedive|folio3|confiz|devsinc|i2c|techlogix|curemd|tkxel|cubix|s&p global|spglobal')
    THEN 'both' ELSE 'global' END AS region FROM named"""


@query("region_for", "P32", REGION_SQL)
def _(spark, sf):
    boards = fx.registry(spark, sf)
    named = F.concat(tx.text(C("name")), fx.pick(NAMED_BOARDS, C("seq") % len(NAMED_BOARDS)))
    return boards.select("seq", enrich.region_for(named, C("ats_slug")).alias("region"))


ENUM_BY_RAW = "CASE lower(coalesce(employment_type, '')) WHEN 'full-time' THEN 'FULL_TIME' WHEN 'contract' THEN 'CONTRACTOR' WHEN 'part time' THEN 'PART_TIME' WHEN 'internship' THEN 'INTERN' END"


@query("employment_enum", "P33", with_enriched(f"""SELECT id, CASE WHEN career_stage = 'internship' THEN CASE WHEN {ENUM_BY_RAW} IS NULL OR {ENUM_BY_RAW} = 'INTERN' THEN 'INTERN' ELSE {ENUM_BY_RAW} || '|INTERN' END
  ELSE coalesce({ENUM_BY_RAW}, 'OTHER') END AS employment FROM enriched"""))
def _(spark, sf):
    return fx.enriched(spark, sf).select("id", enrich.employment_enum(C("employment_type"), C("career_stage")).alias("employment"))


PLACE_SQL = [
    ("Lahore, Pakistan", "PK", None, "Lahore", "PK"), ("Remote, United States", "US", None, None, "US"), ("Berlin, Germany", "DE", None, "Berlin", "DE"),
    ("London, UK", "GB", None, "London", "GB"), ("Toronto, ON, Canada", "CA", None, "Toronto, ON", "CA"), ("Austin, TX", "US", "TX", "Austin", "US"),
    ("Bengaluru, India", "IN", None, "Bengaluru", "IN"),
]
PLACE_ROWS = " ".join(f"UNION ALL SELECT {q(a)}, {q(b)}, {q(c)}, {q(d)}, {q(e)}" for a, b, c, d, e in PLACE_SQL)[len("UNION ALL "):]


@query("postal_address", "P34", with_listings(
    "SELECT id, country, region, locality, coalesce(countries, '') AS countries FROM listings LEFT JOIN known USING (location_raw)",
    f"known(location_raw, country, region, locality, countries) AS ({PLACE_ROWS})"))
def _(spark, sf):
    df = fx.listings(spark, sf).select("id", places.postal_address(C("location_raw")).alias("p"), places.applicant_countries(C("location_raw")).alias("countries"))
    return df.select("id", "p.country", "p.region", "p.locality", "countries")


AGE = f"greatest((epoch_us({sv.AS_OF}) - epoch_us(anchor)) / 86400000000.0, 0)"


@query("posting_window", "P35", with_listings(f"SELECT id, anchor + INTERVAL {fx.DAYS} DAY AS valid_through, is_active AND {AGE} <= {fx.DAYS} + 0.5 AS indexable, round({AGE}, 6) AS age_days FROM listings"))
def _(spark, sf):
    anchor = F.coalesce("posted_at", "first_seen_at", "last_seen_at")
    return fx.listings(spark, sf).select("id", times.valid_through(anchor, fx.DAYS).alias("valid_through"),
        times.is_indexable(C("is_active"), anchor, fx.AS_OF, fx.DAYS).alias("indexable"), F.round(times.age_days(anchor, fx.AS_OF), 6).alias("age_days"))


SHORT = "text"


@query("thin_description", "P36", f"SELECT doc_id AS id, length({squash(SHORT)}) < 60 OR lower({squash(SHORT)}) = 'x' AS thin FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(C("doc_id").alias("id"), tx.thin_description(F.lit("x"), C("text")).alias("thin"))


@query("result_view", "P37", with_listings("""SELECT id, CASE WHEN length(description_text) > 500 THEN left(description_text, 500) || '…' ELSE description_text END AS description_text,
  CAST(NULL AS VARCHAR) AS description_html, CASE """ + sv.TRUST + " WHEN 0 THEN 'Official ATS board' WHEN 1 THEN 'Curated job board' ELSE 'Job aggregator' END AS source_kind_label FROM listings"))
def _(spark, sf):
    return export.result_view(fx.listings(spark, sf)).select("id", "description_text", "description_html", "source_kind_label")


WWR_TITLES = ["{}: lead {}", "No colon {}", ": {}", "{}:", " {} : a: b"]


@query("split_company_role", "P38", f"""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 4 THEN p_brand ELSE 'Unknown' END AS company,
  CASE p_partkey % 5 WHEN 0 THEN 'lead ' || p_brand WHEN 1 THEN 'No colon ' || p_brand WHEN 2 THEN ': ' || p_brand WHEN 3 THEN p_brand || ':' ELSE 'a: b' END AS role FROM part""")
def _(spark, sf):
    said = F.replace(fx.pick(WWR_TITLES, C("p_partkey") % 5), F.lit("{}"), C("p_brand"))
    return fx.table(spark, sf, "part").select(C("p_partkey").alias("id"), tx.split_company_role(said).alias("s")).select("id", "s.company", "s.role")


BADGE = "CASE WHEN career_stage <> 'unknown' THEN upper(left(career_stage, 1)) || replace(substr(career_stage, 2), '_', ' ') WHEN junior_eligible THEN 'Seniority not stated' END"
DEST = "CASE " + " ".join(f"WHEN contains(host, {q(n)}) THEN {q(l)}" for n, l in lx.DESTINATION_LABELS) + " ELSE nullif(host, '') END"


@query("display_labels", "P39", with_enriched(f"SELECT id, {BADGE} AS badge, {DEST} AS destination FROM (SELECT *, regexp_replace({host_sql('apply_url')}, '^www\\.', '') AS host FROM enriched)"))
def _(spark, sf):
    return fx.enriched(spark, sf).select("id", tx.seniority_badge(C("career_stage"), C("junior_eligible")).alias("badge"), urls.destination_label(C("apply_url")).alias("destination"))


WP = "CASE WHEN workplace_type <> 'unknown' THEN upper(left(workplace_type, 1)) || substr(workplace_type, 2) END"
LEAD = f"concat_ws(' · ', title, company_name, {WP}, nullif(location_raw, ''))"
BODY140 = f"left({squash('description_text')}, 140)"


@query("listing_metadata", "P40", with_listings(f"""SELECT id, concat_ws(' — ', title || ' at ' || company_name, {WP}) AS meta_title,
  left(CASE WHEN {BODY140} <> '' AND lower({BODY140}) <> lower(title) THEN {LEAD} || '. ' || {BODY140} ELSE {LEAD} || '. Fresh listing — apply on the employer’s official career page.' END, 160) AS meta_text,
  concat_ws(E'\\n\\n', title || ' at ' || company_name || '.', 'Location: ' || nullif(location_raw, '') || '.', 'Employment: ' || employment_raw || '.', 'Workplace: ' || coalesce({WP}, 'not specified by the source') || '.',
    CASE WHEN workplace_type = 'remote' THEN 'This role is listed as fully remote by the source.' END, 'This listing is indexed from the employer’s official career system. Apply on the company page.') AS summary FROM listings"""))
def _(spark, sf):
    return fx.listings(spark, sf).select("id", export.meta_title().alias("meta_title"), export.meta_text().alias("meta_text"), export.listing_summary().alias("summary"))


CHIP_BY_LABEL = {shown.lower(): v for v, shown in lx.CHIP_LABELS.items()}
CHIP = lambda s: f"coalesce({map_sql(lx.CHIP_ALIASES, q)}[lower({s})], CASE WHEN lower({s}) IN ({', '.join(q(k) for k in lx.CHIP_LABELS)}) THEN lower({s}) END, {map_sql(CHIP_BY_LABEL, q)}[lower({s})], lower({s}))"
LABEL = lambda v: f"coalesce({map_sql(lx.CHIP_LABELS, q)}[{v}], CASE WHEN length({v}) <= 2 THEN upper({v}) ELSE upper(left({v}, 1)) || substr({v}, 2) END)"


@query("profile_tools", "P41", f"""WITH {sv.PROFILES}, v AS (SELECT user_id, list_transform(list_concat(technologies, skills), lambda s: {CHIP('s')}) AS raw FROM profiles),
  u AS (SELECT user_id, list_filter(raw, lambda t, i: list_position(raw, t) = i)[1:16] AS vals FROM v)
  SELECT user_id, array_to_string(vals, '|') AS chip_values, array_to_string(list_transform(vals, lambda x: {LABEL('x')}), '|') AS chip_labels FROM u""")
def _(spark, sf):
    p = fx.profiles(spark, sf).select("user_id", tags.profile_tools(C("skills"), C("technologies")).alias("t"))
    return p.select("user_id", F.transform("t", lambda x: x["value"]).alias("chip_values"), F.transform("t", lambda x: x["label"]).alias("chip_labels"))
