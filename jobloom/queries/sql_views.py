"""The fixture views, stated in SQL for the checks."""

from jobloom import fixtures as fx, lexicons as lx

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
CUTOFF = "TIMESTAMP '2024-01-17 00:00:00'"
STRIP = r"regexp_replace({0}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
SQUASH = r"regexp_replace(regexp_replace({0}, '[\s\pZ]+', ' ', 'g'), '^ +| +$', '', 'g')"


def q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({arr(values)})[({index}) + 1]"


def wordy(pattern: str) -> str:
    """A Java pattern with word edges, in a form without look-around."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern[len(flag):]
    edge_l, edge_r = r"(?:^|[^\pL\p{Nd}_])", r"(?:$|[^\pL\p{Nd}_])"
    left, right = body.startswith(r"\b"), body.endswith(r"\b")
    body = body[2:] if left else body
    body = body[:-2] if right else body
    return flag + (edge_l if left else "") + body + (edge_r if right else "")


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(wordy(pattern))})"


def any_like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def strip(c):
    return STRIP.format(c)


def squash(c):
    return SQUASH.format(c)


LISTINGS = f"""
listings AS (
  SELECT d.doc_id AS id, 'b' || (b.g % (SELECT count(*) FROM supplier)) || ':' || d.doc_id AS external_id,
    {pick(lx.SOURCE_PREFERENCE, "CAST(regexp_extract(d.source, '([0-9]+)', 1) AS INT) % 19")} AS source,
    {pick(fx.TITLE_PREFIX, "b.g % 8")} || pt.p_name || CASE WHEN b.g % 3 = 0 THEN ' - Remote' ELSE '' END AS title,
    s.s_name AS company_name,
    CASE WHEN d.doc_id % 23 = 0 THEN 'https://api.smartrecruiters.com/v1/companies/b' || (b.g % (SELECT count(*) FROM supplier)) || '/postings/' || d.doc_id
         WHEN d.doc_id % 2 = 1 THEN regexp_replace(p.url, '^http:', 'https:') ELSE p.url END AS apply_url,
    CASE WHEN d.doc_id % 2 = 0 THEN (d.doc_id % 9) || '+ years. ' ELSE '' END || {pick(fx.BODY_NOTES, "d.doc_id % 7")} || d.text AS description_text,
    p.html AS description_html,
    CASE WHEN {pick(fx.LOCATIONS, "d.doc_id % 12")} = '' THEN n.n_name ELSE {pick(fx.LOCATIONS, "d.doc_id % 12")} END AS location_raw,
    {pick(fx.WORKPLACES, "d.doc_id % 4")} AS workplace_type,
    {pick(fx.EMPLOYMENT, "d.doc_id % 6")} AS employment_raw,
    CASE WHEN d.doc_id % 5 <> 0 THEN e.ts END AS posted_at, e.ts AS first_seen_at,
    e.ts + to_days(CAST(d.doc_id % 4 AS INT)) AS last_seen_at,
    d.doc_id % 10 <> 9 AS is_active, CAST(d.doc_id % 3 AS INT) AS missed_runs,
    CASE WHEN d.doc_id % 4 <> 3 THEN v.embedding END AS embedding,
    CASE WHEN v.embedding IS NOT NULL AND d.doc_id % 4 <> 3 THEN CASE WHEN d.doc_id % 2 = 1 THEN 'b' ELSE 'a' END END AS embedding_provider,
    CASE WHEN e.ts IS NOT NULL AND d.doc_id % 5 <> 0 THEN e.ts ELSE e.ts END AS anchor
  FROM documents d
  JOIN (SELECT doc_id, doc_id % (SELECT count(*) FROM pages) AS g, (doc_id * 7919) % (SELECT count(*) FROM events) AS ek FROM documents) b USING (doc_id)
  JOIN pages p ON p.page_id = b.g
  JOIN part pt ON pt.p_partkey = b.g % (SELECT count(*) FROM part)
  JOIN supplier s ON s.s_suppkey = b.g % (SELECT count(*) FROM supplier)
  JOIN nation n ON n.n_nationkey = d.doc_id % 25
  JOIN events e ON e.event_id = b.ek
  LEFT JOIN embeddings v ON v.vec_id = d.doc_id
)"""

SPACED = "(title || ' ' || description_text)"
LINED = r"(title || E'\n' || description_text)"
_STAGE = f"""CASE
      WHEN {rx('title', lx.INTERN_TITLE)} OR contains(lower(coalesce(employment_raw, '')), 'intern') THEN 'internship'
      WHEN {rx('title', lx.SENIOR_TITLE)} THEN 'senior'
      WHEN {rx('title', lx.NEW_GRAD_TITLE)} THEN 'new_grad'
      WHEN {rx('title', lx.JUNIOR_TITLE)} THEN 'junior'
      WHEN {rx('title', lx.MID_TITLE)} THEN 'mid'
      WHEN {rx(SPACED, lx.INTERN_TITLE)} THEN 'internship'
      ELSE 'unknown' END"""
_YEARS_RE = lx.YEARS_PATTERN.replace(r"(?i)\b", "(?i)(?:^|[^\\pL\\p{Nd}_])", 1).removesuffix(r"\b")
_YEARS = f"""CASE WHEN {rx(LINED, lx.ZERO_YEARS)} THEN 0 ELSE
      list_min(list_filter(list_transform(regexp_extract_all({LINED}, {q(_YEARS_RE)}, 1), lambda x: TRY_CAST(x AS INT)), lambda x: x <= 15)) END"""


def skill_list(blob: str, lexicon: dict) -> str:
    tests = ", ".join(
        f"CASE WHEN {' OR '.join(rx(blob, '(?i)' + p) for p in ps)} THEN {q(n)} END" for n, ps in lexicon.items()
    )
    return f"list_sort(list_filter([{tests}], lambda x: x IS NOT NULL))"


BLOB = r"(title || E'\n' || description_text || E'\n' || coalesce(location_raw, ''))"
_CITY = "coalesce(" + any_like("lower(location_raw)", [c for c, _ in lx.CITY_LABELS]) + ", false)"
REGION = f"(workplace_type = 'remote' AND ({_CITY} OR {rx("(coalesce(location_raw, '') || ' ' || description_text)", lx.REGION_PATTERN)}))"
# The production lexicon is ASCII and its c# row has a pattern that needs a
# word character before a dot; both engines read the remaining rows alike.
SQL_LEXICON = {n: [p for p in ps if p != r"\b\.net\b"] for n, ps in lx.SKILL_LEXICON.items()}

ENRICHED = LISTINGS + f""",
staged AS (SELECT *, {_STAGE} AS career_stage, {_YEARS} AS years_required_min FROM listings),
enriched AS (
  SELECT *,
    CASE WHEN career_stage IN ('mid', 'senior') OR coalesce(years_required_min >= 3, false) THEN false
         WHEN {rx('title', lx.SENIOR_TITLE)} AND career_stage NOT IN ('internship', 'new_grad', 'junior') THEN false
         WHEN career_stage IN ('internship', 'new_grad', 'junior') THEN true
         ELSE career_stage = 'unknown' END AS junior_eligible,
    CASE WHEN career_stage = 'internship' AND coalesce(employment_raw, '') = '' THEN 'internship' ELSE employment_raw END AS employment_type,
    {skill_list(BLOB, SQL_LEXICON)} AS skills,
    {skill_list(BLOB, fx.CORPUS_LEXICON)} AS tech_tags,
    {REGION} AS region_friendly
  FROM staged
)"""

FRESH = f"is_active AND anchor >= {CUTOFF}"
PREF = f"list_position({arr(lx.SOURCE_PREFERENCE)}, source)"
TRUST = f"CASE WHEN source IN ({', '.join(q(s) for s in lx.BOARD_SOURCES)}) THEN 0 WHEN source IN ({', '.join(q(s) for s in lx.CURATED_SOURCES)}) THEN 1 ELSE 2 END"


def with_listings(body: str, extra: str = "") -> str:
    return f"WITH {LISTINGS}{', ' + extra if extra else ''} {body}"


def with_enriched(body: str, extra: str = "") -> str:
    return f"WITH {ENRICHED}{', ' + extra if extra else ''} {body}"


SAVED = """
saved AS (
  SELECT o_orderkey AS saved_id, o_custkey AS user_id, o_orderkey % ((SELECT count(*) FROM documents) + 20) AS listing_id, status,
    applied AS created_at, CASE WHEN status <> 'saved' THEN applied END AS applied_at,
    CASE WHEN o_orderkey % 4 <> 0 THEN applied END AS last_touch_at,
    CASE WHEN status = 'applied' AND o_orderkey % 5 <> 0 THEN applied + INTERVAL 7 DAY END AS follow_up_on,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Saved ' || (o_orderkey % 50) END AS saved_title,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Firm ' || (o_orderkey % 20) END AS saved_company,
    CAST(NULL AS VARCHAR) AS saved_url
  FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'saved' WHEN 'O' THEN 'applied' ELSE 'interview' END AS status,
          TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') % 30 AS INT)) AS applied
        FROM orders)
)"""

RUNS = """
runs AS (
  SELECT event_type AS source, ts AS started_at, CAST(floor(value) AS BIGINT) AS jobs_fetched,
    CAST(floor(value / 2) AS BIGINT) AS jobs_upserted,
    CASE WHEN value < 1 THEN 'x' WHEN event_id % 3 = 0 THEN '' END AS errors
  FROM events
)"""

REGISTRY = f"""
registry AS (
  SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 13 = 12 THEN '' ELSE {pick(lx.BOARD_SOURCES, 's_suppkey % 11')} END AS ats_type,
    CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE 'board-' || (s_suppkey % 60) END AS ats_slug,
    CASE WHEN s_suppkey % 6 <> 0 THEN s_name END AS name,
    CASE WHEN s_suppkey % 2 = 0 THEN 'https://s' || s_suppkey || '.example.com' END AS website,
    {pick([None, 'pakistan', 'both', 'global'], 's_suppkey % 4')} AS region_focus,
    s_suppkey % 7 <> 0 AS is_enabled
  FROM supplier
)"""

PROFILES = f"""
profiles AS (
  SELECT c_custkey AS user_id,
    ([['Python', 'React'], ['docker', 'k8s'], ['java'], ['the', 'and'], ['le', 'de'], ['agile', 'ReactJS'], []])[c_custkey % 7 + 1] AS skills,
    ([['typescript'], [], ['golang', 'python']])[c_custkey % 3 + 1] AS technologies,
    ([['small bolt'], [], ['Senior red anvil'], NULL, ['gear'], ['widget', 'plate']])[c_custkey % 6 + 1] AS desired_roles,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'junior' WHEN 'BUILDING' THEN 'senior' WHEN 'AUTOMOBILE' THEN 'mid'
      WHEN 'FURNITURE' THEN 'internship' WHEN 'HOUSEHOLD' THEN '' END AS experience_level,
    {pick(['remote', 'any', 'onsite'], 'c_custkey % 3')} AS remote_preference,
    [{pick(['Lahore', 'Berlin', 'Austin', ''], 'c_custkey % 4')}, n_name] AS cities,
    {pick([None, 'remote worldwide jobs', 'Germany preferred'], 'c_custkey % 3')} AS location_preference,
    c_custkey % 2 = 0 AS region_friendly_wanted,
    CASE WHEN c_custkey % 4 = 0 THEN '2024-01-02T00:00:00Z' END AS resume_uploaded_at,
    CASE WHEN c_custkey % 9 = 0 THEN '2024-01-03T00:00:00Z' END AS onboarding_skipped_at,
    CASE WHEN c_custkey % 11 = 0 THEN '2024-01-04T00:00:00Z' END AS onboarding_completed_at
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)"""

SEARCHES = f"""
searches AS (
  SELECT CAST(n_nationkey AS BIGINT) AS search_id, CAST(n_nationkey % 7 AS BIGINT) AS user_id, n_name AS name,
    {pick(['the', 'bolt', None, 'anvil', 'small ring', 'gear', None, 'python', 'le de'], 'n_nationkey % 9')} AS q,
    {pick([None, 'remote', None, 'hybrid'], 'n_nationkey % 4')} AS workplace,
    {pick([None, None, 'the, and', 'python'], 'n_nationkey % 4')} AS skills_csv,
    {pick(['10', '90', None, 'x', '3'], 'n_nationkey % 5')} AS posted_within,
    {pick([None, 'junior', None, 'senior', None], 'n_nationkey % 5')} AS career_stage_wanted,
    n_nationkey % 6 = 5 AS region_wanted, TIMESTAMP '2024-01-24 00:00:00' AS last_checked_at,
    CASE n_nationkey % 7 WHEN 2 THEN 'berlin' WHEN 4 THEN 'lahore' END AS city, CASE n_nationkey % 8 WHEN 3 THEN 'germany' WHEN 6 THEN 'canada' END AS country,
    CASE WHEN n_nationkey % 3 = 1 THEN 'supplier' END AS company, CASE WHEN n_nationkey % 5 = 4 THEN 'full' END AS employment,
    CASE WHEN n_nationkey % 9 = 8 THEN 'lever' END AS wanted_source, n_nationkey % 8 = 3 AS junior_wanted, n_nationkey % 10 <> 9 AS search_on
  FROM nation
)"""

PAIRS = """
pairs AS (
  SELECT conv_id AS doc_id,
    o || E'\\nGrew by 12% and 3x with python; ' || (conv_id % 40) || '% saved.' AS original,
    d || E'\\nGrew by 12%, ' || (conv_id % 40 + 1) || '% and 1,200 users with React.' AS derived
  FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user') AS o,
               string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS d
        FROM conversations GROUP BY conv_id)
  WHERE o <> '' AND d <> ''
)"""

SECTIONS = f"""
sections AS (
  SELECT doc_id, pos, {pick(["Summary", "References", "Technical Skills", "Work Experience", "professional references", "Awards", "Key Projects", "hobbies"], '(doc_id + pos) % 8')} AS heading, item
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS item FROM documents)
)"""

QUERY_SET = """
query_set AS (
  SELECT p_partkey AS query_id, CASE p_partkey // 50 % 5 WHEN 0 THEN p_name WHEN 1 THEN p_first || ' OR ' || p_last WHEN 2 THEN p_last || ' -senior'
    WHEN 3 THEN '"' || p_name || '" remote' ELSE 'junior ' || p_last || ' internship OR the python' END AS q
  FROM (SELECT *, string_split(p_name, ' ')[1] AS p_first, string_split(p_name, ' ')[-1] AS p_last FROM part WHERE p_partkey % 50 = 0)
)"""
