"""Grounding audits of derived documents."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.functions import enrich
from jobloom.operators import grounding, ranking
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.projections import map_sql
from jobloom.queries.sql_views import q, squash

C = F.col
NORM = lambda c: squash(f"lower({c})")
METRIC_SQL = r"(?i)(?:\d+(?:\.\d+)?\s*%|\b\d{1,3}(?:,\d{3})+(?:\+)?\b|\b\d+\s*(?:x|times)\b)"
METRICS = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, {q(METRIC_SQL)}), lambda m: {NORM('m')}))"


@query("unsupported_metrics", "R1", f"WITH {sv.PAIRS} SELECT doc_id, array_to_string(list_sort(list_filter({METRICS('derived')}, lambda m: NOT list_contains({METRICS('original')}, m) AND NOT contains({NORM('original')}, m))), '|') AS bad FROM pairs")
def _(spark, sf):
    return fx.grounding_pairs(spark, sf).select("doc_id", grounding.unsupported_metrics(C("original"), C("derived")).alias("bad"))


def supported(p, body):
    words = f"list_filter(regexp_extract_all({p}, '[a-z0-9+#.]{{2,}}'), lambda t: t NOT IN ({', '.join(q(w) for w in lx.PHRASE_STOPWORDS)}))"
    hits = f"len(list_filter({words}, lambda t: contains({body}, t)))"
    return f"({p} = '' OR contains({body}, {p}) OR len({words}) = 0 OR CASE WHEN len({words}) <= 3 THEN {hits} = len({words}) ELSE {hits} / len({words}) >= 0.85 END)"


@query("phrase_supported", "R2", f"WITH {sv.PAIRS}, p AS (SELECT doc_id, {NORM('original')} AS body, {NORM('derived')} AS phrase FROM pairs UNION ALL SELECT doc_id, {NORM('original')}, 'grew by python' FROM pairs) SELECT doc_id, phrase, {supported('phrase', 'body')} AS supported FROM p")
def _(spark, sf):
    p = fx.grounding_pairs(spark, sf).withColumn("body", grounding.norm(C("original")))
    both = p.select("doc_id", "body", F.explode(F.array(grounding.norm(C("derived")), F.lit("grew by python"))).alias("phrase"))
    return both.select("doc_id", "phrase", grounding.phrase_supported(C("phrase"), C("body")).alias("supported"))


LINE_WORDS = f"list_filter(regexp_extract_all({NORM('line')}, '[a-z0-9+#.]{{3,}}'), lambda t: t NOT IN ({', '.join(q(w) for w in lx.LINE_STOPWORDS)}))"
LINES = f"lines AS (SELECT doc_id, {NORM('original')} AS body, unnest(range(len(string_split(derived, chr(10))))) AS line_no, unnest(string_split(derived, chr(10))) AS line FROM pairs)"


@query("line_grounded", "R3", f"WITH {sv.PAIRS}, {LINES}, w AS (SELECT *, {LINE_WORDS} AS ws FROM lines WHERE trim(line) <> '') SELECT doc_id, line_no, len(ws) = 0 OR len(list_filter(ws, lambda t: contains(body, t))) / len(ws) >= 0.65 AS grounded FROM w")
def _(spark, sf):
    return grounding.ungrounded_lines(fx.grounding_pairs(spark, sf)).select("doc_id", C("line_no").cast("bigint").alias("line_no"), "grounded")


KEYWORDS = ["Python", "React", "graph databases", "users", "python"]


@query("match_panel", "R4", f"""WITH {sv.PAIRS}, a AS (SELECT doc_id, {NORM('original')} AS body, list_concat(['python', 'react', 'graph databases', 'users'], list_filter({sv.skill_list('derived', sv.SQL_LEXICON)}, lambda s: s NOT IN ('python', 'react'))) AS asked FROM pairs)
  SELECT doc_id, array_to_string(list_filter(asked, lambda k: {supported('k', 'body')}), '|') AS strong, array_to_string(list_filter(asked, lambda k: NOT {supported('k', 'body')}), '|') AS missing FROM a""")
def _(spark, sf):
    keys = F.array(*[F.lit(k) for k in KEYWORDS])
    p = fx.grounding_pairs(spark, sf).select("doc_id", grounding.match_panel(C("original"), keys, enrich.extract_skills(C("derived"))).alias("p"))
    return p.select("doc_id", "p.strong", "p.missing")


KEY_OF = f"coalesce({map_sql(grounding.KEY_TABLE, q)}[lower(heading)], lower(heading))"
KINDS = ["name", "email", "summary", "experience", "projects", "other", "skills"]


def entries(spark, sf):
    """Original and final documents: one entry per line, some lost or emptied."""
    s = fx.sections(spark, sf).select("doc_id", fx.pick(KINDS, (C("doc_id") + C("pos")) % 7).alias("kind"), "heading", C("item").alias("body"), "pos")
    final = s.filter("(doc_id + pos) % 5 <> 0").withColumn("body", F.when(C("doc_id") % 6 == 0, F.lit("")).otherwise(C("body")))
    return s, final.withColumn("heading", F.when((C("doc_id") % 11 == 3) & (C("pos") % 4 == 1), F.lit(" ")).otherwise(C("heading")))


ENTRIES = f"""o AS (SELECT doc_id, {sv.pick(KINDS, '(doc_id + pos) % 7')} AS kind, {KEY_OF} AS k, item AS body, pos FROM sections),
f AS (SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 THEN '' ELSE body END AS body, CASE WHEN doc_id % 11 = 3 AND pos % 4 = 1 THEN '' ELSE k END AS k) FROM o WHERE (doc_id + pos) % 5 <> 0)"""
COUNT_COLS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}' AND {sv.strip('body')} <> '') AS n_{k}" for k in ["name", "email", "summary", "skills", "experience", "projects"])
LOSSES = " UNION ALL ".join(
    [f"SELECT doc_id, '{v}' AS failure FROM j WHERE a_{k} > 0 AND b_{k} = 0" for k, v in {"name": "missing_name", "email": "missing_contact:email", "summary": "missing_summary", "skills": "missing_skills"}.items()]
    + [f"SELECT doc_id, 'lost_{k}:' || a_{k} || '->' || b_{k} FROM j WHERE b_{k} < a_{k}" for k in ["experience", "projects"]]
    + ["SELECT doc_id, 'empty_document' FROM j WHERE b_summary + b_skills + b_experience + b_projects = 0",
       "SELECT doc_id, 'lost_section:' || k FROM (SELECT DISTINCT doc_id, k FROM o WHERE kind = 'other' EXCEPT SELECT DISTINCT doc_id, k FROM f WHERE kind = 'other')",
       "SELECT doc_id, 'duplicate_section:' || k FROM f WHERE kind = 'other' GROUP BY doc_id, k HAVING count(*) > 1", "SELECT doc_id, 'empty_section_heading' FROM f WHERE kind = 'other' AND k = ''",
       "SELECT DISTINCT doc_id, 'invented_references' FROM f WHERE kind = 'other' AND k = 'references' AND doc_id NOT IN (SELECT doc_id FROM o WHERE kind = 'other' AND k = 'references')"])
COLS = ["name", "email", "summary", "skills", "experience", "projects"]
JOINED = f"a AS (SELECT doc_id, {COUNT_COLS} FROM o GROUP BY doc_id), b AS (SELECT doc_id, {COUNT_COLS} FROM f GROUP BY doc_id), j AS (SELECT doc_id, " + ", ".join(f"a.n_{k} AS a_{k}, coalesce(b.n_{k}, 0) AS b_{k}" for k in COLS) + " FROM a LEFT JOIN b USING (doc_id))"


@query("integrity_audit", "R5", f"WITH {sv.SECTIONS}, {ENTRIES}, {JOINED} {LOSSES}")
def _(spark, sf):
    return grounding.integrity_audit(*entries(spark, sf))


@query("changed_sections", "U6", f"WITH {sv.SECTIONS}, {ENTRIES} SELECT doc_id, k AS section, 'lost' AS change FROM (SELECT DISTINCT doc_id, k FROM o EXCEPT SELECT DISTINCT doc_id, k FROM f) UNION ALL SELECT doc_id, k, 'invented' FROM (SELECT DISTINCT doc_id, k FROM f EXCEPT SELECT DISTINCT doc_id, k FROM o)")
def _(spark, sf):
    return grounding.lost_and_invented_sections(*entries(spark, sf), unnamed=True)


BULLET = r"'^[•\-*–—]+\s*'"
NK = lambda c: squash(f"regexp_replace(regexp_replace(lower({c}), {BULLET}, ''), '[^\\pL\\p{{Nd}}_\\s]', ' ', 'g')")
SECTION_NAMES = ", ".join(q(k) for k in sorted(set(lx.SECTION_KEY.values())))
ITEM_CLEAN = squash(r"regexp_replace(lower(it), '[^\pL\p{Nd}_\s&+/]', ' ', 'g')")
ITEM_KEY = f"coalesce({map_sql(grounding.KEY_TABLE, q)}[{ITEM_CLEAN}], '')"
FOLD = """list_reduce(list_transform(xs, lambda x: [{'nk': x.nk, 'it': x.it}]), lambda acc, b: CASE
  WHEN list_position(list_transform(acc, lambda y: contains(y.nk, b[1].nk) OR contains(b[1].nk, y.nk)), true) IS NULL THEN list_concat(acc, b)
  ELSE list_transform(acc, lambda y, i: CASE WHEN i = list_position(list_transform(acc, lambda z: contains(z.nk, b[1].nk) OR contains(b[1].nk, z.nk)), true) AND length(b[1].it) > length(y.it) THEN b[1] ELSE y END) END)"""


TITLED = "array_to_string(list_transform(string_split(heading, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
FIRST = f"SELECT doc_id, {KEY_OF} AS section, first(heading ORDER BY pos) AS heading FROM sections GROUP BY doc_id, {KEY_OF}"


@query("merge_sections", "R6", f"""WITH {sv.SECTIONS}, c AS (SELECT doc_id, pos, {KEY_OF} AS section, regexp_replace({squash('item')}, {BULLET}, '') AS it FROM sections),
  n AS (SELECT *, {NK('it')} AS nk FROM c), k AS (SELECT * FROM n WHERE nk <> '' AND NOT (len(string_split(it, ' ')) <= 4 AND {ITEM_KEY} IN ({SECTION_NAMES}))),
  u AS (SELECT doc_id, section, it, nk, min(pos) AS pos FROM k GROUP BY ALL), l AS (SELECT doc_id, section, list({{'pos': pos, 'nk': nk, 'it': it}} ORDER BY pos, nk, it) AS xs FROM u GROUP BY ALL)
  SELECT doc_id, section, coalesce({map_sql(lx.SECTION_DISPLAY, q)}[section], {TITLED}) AS heading, array_to_string(list_transform({FOLD}, lambda y: y.it), '|') AS items FROM l JOIN ({FIRST}) USING (doc_id, section)""")
def _(spark, sf):
    return grounding.merge_sections(fx.sections(spark, sf))


@query("duplicate_section_keys", "R8", f"WITH {sv.SECTIONS} SELECT doc_id, {KEY_OF} AS section, count(*) AS n FROM sections GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return grounding.duplicate_section_keys(fx.sections(spark, sf))


FLAT_LINES = f"list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: {sv.strip('x')}), lambda x: x <> '')"
HEADS = f"len(list_filter({FLAT_LINES}, lambda x: regexp_matches(x, {q(lx.HEADING_LINE)})))"


@query("flattened_documents", "R9", f"SELECT doc_id, len({FLAT_LINES}) AS n_lines, {HEADS} AS n_headings, {sv.strip('text')} <> '' AND (len({FLAT_LINES}) <= 3 OR ({HEADS} < 2 AND length(text) > 400)) AS flattened FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Skills:' || chr(10) || 'EDUCATION' || chr(10) || text ELSE text END AS text FROM documents)")
def _(spark, sf):
    headed = F.when(C("doc_id") % 4 == 0, F.concat(F.lit("Skills:\nEDUCATION\n"), "text")).otherwise(C("text"))
    return grounding.flattened_documents(fx.table(spark, sf, "documents").select("doc_id", headed.alias("text")))


BAN_NOTE = ["", "Tailored for you.", "An AI-generated draft generated for review", "job match score: 9", "OPTIMIZED FOR robots, prepared for all", "Optimized using AI; ats score 7"]
BAN_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q(sv.wordy(p))}) THEN {q(n)} END" for n, p in lx.BANNED_PHRASES) + "], lambda x: x IS NOT NULL)"


@query("banned_phrases", "R11", f"SELECT doc_id, unnest({BAN_HITS}) AS phrase FROM (SELECT doc_id, text || chr(10) || {sv.pick(BAN_NOTE, 'doc_id % 6')} AS text FROM documents)")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n"), fx.pick(BAN_NOTE, C("doc_id") % 6)).alias("text"))
    return grounding.banned_phrases(docs)


ENTITY = lambda c: sv.strip(f"regexp_replace({NORM(c)}, '[^a-z0-9 ]', ' ', 'g')")
WORDS_OF = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: length(t) > 2))"
SHORTER = "least(len(b[1].ws), len(d.ws))"
SHARED_WORDS = "len(list_intersect(b[1].ws, d.ws))"
MATCH = f"b[1].key <> '' AND d.key <> '' AND (contains(b[1].key, d.key) OR contains(d.key, b[1].key) OR ({SHORTER} > 0 AND {SHARED_WORDS} / greatest({SHORTER}, 1) >= 0.6))"
# A fold over the base entries: every step keeps one element whose pick is the first free match.
PICK = f"list_filter(b[1].ds, lambda d: NOT list_contains(list_transform(acc, lambda a: a.pick), d.pos) AND {MATCH})[1].pos"
ALIGN = f"list_reduce(list_transform(bs, lambda x: [{{'pos': x.pos, 'key': x.key, 'ws': x.ws, 'ds': ds, 'pick': NULL::BIGINT}}]), lambda acc, b: list_concat(acc, [{{'pos': b[1].pos, 'key': NULL, 'ws': NULL, 'ds': NULL, 'pick': {PICK}}}]), []::STRUCT(pos BIGINT, \"key\" VARCHAR, ws VARCHAR[], ds STRUCT(pos BIGINT, \"key\" VARCHAR, ws VARCHAR[])[], pick BIGINT)[])"
SIDE = lambda where, pos, label: f"SELECT doc_id, list({{'pos': {pos}, 'key': {ENTITY(label)}, 'ws': {WORDS_OF(ENTITY(label))}}} ORDER BY pos) AS xs, list({pos}) FILTER (WHERE {sv.strip(label)} <> '') AS named FROM sections WHERE {where} GROUP BY doc_id"


@query("aligned_entries", "R10", f"""WITH {sv.SECTIONS}, b AS ({SIDE('pos % 4 <> 3', 'pos', 'item')}), d AS ({SIDE('pos % 3 <> 1', 'pos + 100', "item || ' lead'")}),
  j AS (SELECT doc_id, coalesce(b.xs, []) AS bs, coalesce(d.xs, []) AS ds, coalesce(d.named, []) AS named FROM b FULL JOIN d USING (doc_id)), f AS (SELECT doc_id, named, {ALIGN} AS out FROM j)
  SELECT doc_id, o.pos AS base_pos, o.pick AS derived_pos FROM (SELECT doc_id, unnest(out) AS o FROM f)
  UNION ALL SELECT doc_id, NULL, unnest(list_filter(named, lambda n: NOT list_contains(list_transform(out, lambda a: a.pick), n))) FROM f""")
def _(spark, sf):
    lines = fx.sections(spark, sf).select("doc_id", "pos", C("item").alias("label"))
    base, derived = lines.filter("pos % 4 <> 3"), lines.filter("pos % 3 <> 1").select("doc_id", (C("pos") + 100).alias("pos"), F.concat("label", F.lit(" lead")).alias("label"))
    return grounding.aligned_entries(base, derived)


CANDIDATES = ["Python", "React", "python", "Docker (compose)", "docker", "Users", "graph ql tools", "grew", "SQL", "x"]


FRAGMENTS = " ".join(f"WHEN contains(skill, {q(n)}) OR contains({q(n)}, skill) THEN {q(c)}" for n, c in lx.SKILL_CATEGORY.items() if len(n) >= 3)
CATEGORY = f"coalesce({map_sql(lx.SKILL_CATEGORY, q)}[skill], CASE {FRAGMENTS} ELSE {q(lx.CATEGORY_FALLBACK)} END)"
WRITTEN = "regexp_extract(original, '(?i)(?:^|[^\\w+#.])(' || regexp_escape(skill) || ')(?:$|[^\\w+#.])', 1)"
RELEVANCE = f"""0.3 + CASE WHEN skill IN ('python', 'sql') OR contains(job, skill) THEN 3 ELSE 0 END + CASE WHEN contains(skill, 'python') OR contains('python', skill) OR contains(skill, 'sql') OR contains('sql', skill) THEN 1.5 ELSE 0 END
  + CASE WHEN len(list_filter(string_split(skill, ' '), lambda t: length(t) >= 4 AND contains(job, t))) > 0 THEN 0.5 ELSE 0 END + CASE WHEN category IN ({', '.join(map(q, lx.CORE_CATEGORIES))}) THEN 0.15 ELSE 0 END"""


@query("skill_groups", "R7 W6", f"""WITH {sv.PAIRS}, c AS (SELECT doc_id, original || ' docker (compose) sql' AS original, derived, unnest(range({len(CANDIDATES)})) AS pos, unnest({sv.arr(CANDIDATES)}) AS raw FROM pairs),
  n AS (SELECT doc_id, pos, raw, original, {NORM('original')} AS body, {NORM('derived')} AS job, {NORM('raw')} AS skill FROM c), s AS (SELECT * FROM n WHERE length(skill) >= 2 AND {supported('skill', 'body')}),
  w AS (SELECT *, coalesce({map_sql(lx.SKILL_DISPLAY, q)}[skill], CASE WHEN {WRITTEN} <> lower({WRITTEN}) THEN {WRITTEN} END) AS written FROM s),
  v AS (SELECT doc_id, skill, any_value(job) AS job, min(pos) AS pos, coalesce(min(written), first(raw ORDER BY pos) FILTER (WHERE raw <> lower(raw)), first(raw ORDER BY pos)) AS name FROM w GROUP BY doc_id, skill),
  g AS (SELECT doc_id, {NORM("regexp_replace(skill, '[(\\[].*$', '')")} AS base, any_value(job) AS job, min(pos) AS pos, first(skill ORDER BY length(name) DESC, pos) AS skill, first(name ORDER BY length(name) DESC, pos) AS name FROM v GROUP BY doc_id, base HAVING base <> ''),
  k AS (SELECT *, {CATEGORY} AS category FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {RELEVANCE} DESC, pos) AS overall FROM k),
  t AS (SELECT * FROM r WHERE overall <= 36 QUALIFY row_number() OVER (PARTITION BY doc_id, category ORDER BY overall) <= 10)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({sv.arr(lx.CATEGORY_ORDER)}, category)) AS group_no, category, string_agg(skill, '|' ORDER BY overall) AS items, string_agg(name, '|' ORDER BY overall) AS names FROM t GROUP BY doc_id, category""")
def _(spark, sf):
    docs = fx.grounding_pairs(spark, sf).select("doc_id", F.concat("original", F.lit(" docker (compose) sql")).alias("original"), C("derived").alias("job_text"),
        F.array(*[F.lit(c) for c in CANDIDATES]).alias("candidates"), F.array(F.lit("python"), F.lit("sql")).alias("keywords"))
    return grounding.skill_groups(docs)


@query("top_per_category", "W6", "SELECT doc_id, event_id AS pos, category, row_number() OVER (PARTITION BY doc_id, category ORDER BY overall) AS in_category FROM (SELECT user_id AS doc_id, event_id, event_type AS category, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS overall FROM events QUALIFY overall <= 36) QUALIFY in_category <= 10")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(C("user_id").alias("doc_id"), C("event_id").alias("pos"), C("event_type").alias("category"), C("value").alias("relevance"))
    return ranking.top_per_category(e).select("doc_id", "pos", "category", "in_category")
