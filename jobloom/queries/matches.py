"""Profile matching."""

from pyspark.sql import functions as F

from jobloom import fixtures as fx, lexicons as lx
from jobloom.operators import matching, ranking
from jobloom.plans import recommend
from jobloom.queries import sql_views as sv
from jobloom.queries.base import query
from jobloom.queries.projections import EFFORT_CASE, EFFORT_HAY, GROW, map_sql
from jobloom.queries.sql_views import AS_OF, any_like, arr, q, with_enriched

C = F.col
NOW, DAYS = fx.AS_OF, fx.DAYS


def pairs(spark, sf):
    """Three listings per profile, spread over the whole catalogue."""
    docs = fx.row_count(fx.table(spark, sf, "documents"))
    p = matching.profile_side(fx.profiles(spark, sf))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    p = p.withColumns({"listing_id": (C("user_id") * 13 + C("k") * 37) % docs, "search_score": (C("k") * 20).cast("double")})
    return p.join(matching.listing_side(fx.enriched(spark, sf)), "listing_id")


VARIANTS = map_sql(lx.SKILL_ALIASES, arr)
ELIGIBLE = "(junior_eligible AND NOT (career_stage IN ('junior', 'new_grad') AND coalesce(years_required_min >= 4, false)))"
PAIRS = f"""prof AS (SELECT user_id, {GROW('list_concat(skills, technologies)')} AS universe, coalesce(nullif(experience_level, ''), 'junior') AS level, remote_preference AS pref,
    coalesce(desired_roles, []) AS roles, cities, location_preference AS lp, region_friendly_wanted AS wants FROM profiles),
pk AS (SELECT *, (user_id * 13 + k * 37) % (SELECT count(*) FROM documents) AS listing_id, k * 20.0 AS search_score FROM (SELECT *, unnest([0, 1, 2]) AS k FROM prof)),
side AS (SELECT id AS listing_id, title, lower(title) AS low_title, ' ' || lower(title) || ' ' || lower(description_text) || ' ' AS blob, {GROW('list_concat(skills, tech_tags)')} AS tags,
    career_stage, years_required_min, {ELIGIBLE} AS junior_eligible, workplace_type AS wt, lower(coalesce(location_raw, '')) AS place, region_friendly AS region_open, anchor, company_name FROM enriched),
j AS (SELECT *, regexp_replace(blob, '[.\\-]', '', 'g') AS squeezed FROM pk JOIN side USING (listing_id)),
m AS (SELECT *, list_sort(list_filter(universe, lambda s: length(s) >= 2 AND (list_contains(tags, s) OR len(list_filter(coalesce({VARIANTS}[s], [s]), lambda v: length(v) >= 2 AND
    (list_contains(tags, v) OR contains(low_title, v) OR contains(squeezed, replace(replace(v, '.', ''), '-', '')) OR contains(blob, ' ' || v || ' ')))) > 0))) AS matched FROM j),
s1 AS (SELECT *, list_sort(list_filter(tags, lambda t: NOT list_contains(matched, t))) AS missing,
    least(40.0, len(matched) * 6.0 + len(list_filter(universe, lambda s: contains(low_title, s))) * 2.5 + least(10.0, len(matched) * 1.5)) AS skill FROM m)"""
ROLE_POINTS = """list_transform(roles, lambda r: CASE WHEN trim(r) = '' THEN 0.0 WHEN contains(low_title, lower(trim(r))) THEN 20.0 ELSE least(20.0, 5.0 * len(list_intersect(
  list_filter(list_distinct(regexp_extract_all(lower(r), '[a-z0-9+#.]+')), lambda t: length(t) > 2), list_distinct(regexp_extract_all(low_title, '[a-z0-9+#.]+'))))) END)"""
EXCL = "(career_stage IN ('mid', 'senior') OR coalesce(years_required_min >= 3, false) OR (NOT junior_eligible AND career_stage NOT IN ('internship', 'new_grad', 'junior')))"
JUNIOR = f"level IN ({', '.join(q(x) for x in lx.JUNIOR_LEVELS)})"
DIST = lambda c: f"coalesce({map_sql(lx.STAGE_DISTANCE, str)}[{c}], 1)"
SAID = "list_filter(regexp_extract_all(lower(coalesce(lp, '')), '[a-z]+'), lambda t: length(t) > 2 AND t NOT IN ('remote', 'roles', 'jobs', 'preferred'))"
SCORES = f"""s2 AS (SELECT *, coalesce(list_max({ROLE_POINTS}), 0.0) AS role0, {SAID} AS said,
    CASE WHEN pref = 'any' THEN 10.0 WHEN pref = wt THEN 12.0 WHEN pref = 'remote' AND wt = 'hybrid' THEN 7.0 WHEN pref = 'remote' AND wt = 'unknown' THEN 6.0 WHEN pref <> 'onsite' THEN 4.0 ELSE 0.0 END AS wp0 FROM s1),
s3 AS (SELECT *, CASE WHEN role0 < 6 AND {any_like('low_title', ['engineer', 'developer', 'software', 'full stack', 'fullstack'])} AND len(universe) > 0 THEN greatest(role0, 8.0) ELSE role0 END AS role,
    CASE WHEN {JUNIOR} THEN CASE WHEN {EXCL} THEN 0.0 WHEN career_stage IN ('internship', 'new_grad', 'junior') THEN 12.0 WHEN junior_eligible AND career_stage = 'unknown' THEN 7.0 ELSE 4.0 END
      WHEN career_stage = level THEN 12.0 WHEN career_stage = 'unknown' THEN 8.0 WHEN {DIST('career_stage')} = {DIST('level')} THEN 12.0 WHEN abs({DIST('career_stage')} - {DIST('level')}) = 1 THEN 9.0 ELSE 4.0 END AS seniority,
    CASE WHEN len(list_filter(cities, lambda c: c <> '' AND contains(place, lower(c)))) > 0 THEN least(12.0, wp0 + 2) ELSE wp0 END AS wp1,
    CASE WHEN wants THEN CASE WHEN region_open THEN 10.0 WHEN wt = 'remote' THEN 5.0 ELSE 2.0 END WHEN wt = 'remote' THEN 3.0 ELSE 0.0 END AS region,
    round(greatest(1.0, 10.0 * exp(-greatest((epoch_us({AS_OF}) - epoch_us(anchor)) / 86400000000.0, 0) / 10.0)), 2) AS freshness FROM s2),
s4 AS (SELECT *, CASE WHEN len(list_filter(said, lambda t: contains(place, t))) > 0 THEN least(12.0, wp1 + 1.5) ELSE wp1 END AS wp2 FROM s3),
s5 AS (SELECT *, CASE WHEN wt = 'remote' AND list_has_any(said, ['worldwide', 'anywhere', 'global']) THEN least(12.0, wp2 + 1.5) ELSE wp2 END AS workplace, least(10.0, search_score * 0.2) AS prior FROM s4),
s6 AS (SELECT *, CAST(round(CAST(least(100.0, skill + role + seniority + workplace + region + freshness + prior) AS DECIMAL(12, 4)), 1) AS DOUBLE) AS total FROM s5)"""
BASE = f"{sv.PROFILES}, {PAIRS}"
FULL = f"{BASE}, {SCORES}"


def scored(spark, sf):
    return matching.score_pairs(pairs(spark, sf), NOW)


@query("skill_score", "M1", with_enriched("SELECT user_id, listing_id, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing, skill + 0.0 AS skill FROM s1", BASE))
def _(spark, sf):
    return matching.with_skill_score(pairs(spark, sf)).select("user_id", "listing_id", "matched", "missing", "skill")


@query("fit_components", "M2 M3 M4 M5 M6", with_enriched("SELECT user_id, listing_id, CAST(role AS DOUBLE) AS role, CAST(seniority AS DOUBLE) AS seniority, CAST(workplace AS DOUBLE) AS workplace, CAST(region AS DOUBLE) AS region, freshness FROM s6", FULL))
def _(spark, sf):
    return scored(spark, sf).select("user_id", "listing_id", "role", "seniority", "workplace", "region", "freshness")


REASONS = """array_to_string(list_filter([CASE WHEN len(matched) > 0 THEN 'Matched: ' || array_to_string(matched[1:5], ', ') END, CASE WHEN role >= 12 THEN 'Role title fit' END, CASE WHEN seniority >= 10 THEN level || ' level' END,
  CASE WHEN workplace >= 10 AND wt = 'remote' THEN 'Remote' END, CASE WHEN region >= 8 THEN 'Region-friendly remote' END, CASE WHEN freshness >= 7 THEN 'Fresh posting' END], lambda x: x IS NOT NULL), '|')"""


@query("fit_total", "M7", with_enriched(f"SELECT user_id, listing_id, total, {REASONS} AS reasons FROM s6", FULL))
def _(spark, sf):
    return scored(spark, sf).select("user_id", "listing_id", "total", "reasons")


@query("match_order", "O6", with_enriched("SELECT user_id, listing_id, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, skill DESC, listing_id) AS position FROM s6 QUALIFY position <= 2", FULL))
def _(spark, sf):
    return ranking.matches_per_user(scored(spark, sf), 2).select("user_id", "listing_id", "position")


WHERE = "title || ' at ' || company_name"
NARRATIVE = f"""concat_ws(' ', CASE WHEN total >= 70 THEN 'A close match: ' || {WHERE} || '.' WHEN total >= 50 THEN 'A fair match: ' || {WHERE} || '.' ELSE 'A long shot: ' || {WHERE} || '; worth it if you want to grow into it.' END,
  CASE WHEN len(matched) > 0 THEN 'You bring ' || array_to_string(matched[1:5], ', ') || '.' END, CASE WHEN len(missing) > 0 THEN 'The listing also names ' || array_to_string(missing[1:4], ', ') || '.' END,
  CASE WHEN region >= 8 THEN 'It is open to people where you live.' WHEN workplace >= 10 THEN 'It is remote; ask about working hours.' END, 'Apply where the employer asks you to.')"""


@query("fit_brief", "M9", with_enriched(f"SELECT user_id, listing_id, CASE WHEN total >= 70 THEN 'apply' WHEN total >= 45 THEN 'maybe' ELSE 'skip' END AS verdict, {NARRATIVE} AS narrative FROM s6", FULL))
def _(spark, sf):
    return matching.fit_brief(scored(spark, sf)).select("user_id", "listing_id", "verdict", "narrative")


@query("recommend", "M8 F7 O6 U2 T4")
def _(spark, sf):
    out = recommend.recommend(fx.profiles(spark, sf), fx.stored(spark, sf), NOW, DAYS, 20)
    return out.select("user_id", "listing_id", "position", "total", "skill", "reasons")


HUNT = f"""w AS (SELECT user_id, remote_preference <> 'onsite' AS r, region_friendly_wanted AS g, coalesce(nullif(experience_level, ''), 'junior') IN ('internship', 'intern') AS i FROM profiles),
kinds AS (SELECT DISTINCT r, g, i FROM w),
lists AS (SELECT r, g, i, id, title, row_number() OVER (PARTITION BY r, g, i ORDER BY posted_at DESC NULLS LAST, first_seen_at DESC, {sv.TRUST}, CASE WHEN posted_at IS NULL THEN 1 ELSE 0 END, id) AS position
  FROM kinds JOIN enriched ON is_active AND anchor >= {AS_OF} - INTERVAL 2 DAY AND (NOT r OR workplace_type = 'remote') AND (NOT g OR region_friendly) AND CASE WHEN i THEN career_stage = 'internship' ELSE {ELIGIBLE} END QUALIFY position <= 8)"""


@query("hunt_plan", "M10 J4", with_enriched("SELECT user_id, id AS listing_id, title, position FROM w JOIN lists USING (r, g, i) WHERE (user_id, id) NOT IN (SELECT (user_id, listing_id) FROM saved WHERE status IN ('applied', 'interview'))", ", ".join([sv.PROFILES, sv.SAVED, HUNT])))
def _(spark, sf):
    return recommend.hunt_plan(fx.profiles(spark, sf), fx.enriched(spark, sf), fx.saved(spark, sf), NOW)


GAPS = "list_sort(list_filter(list_distinct(list_concat(skills, tech_tags)), lambda t: NOT list_contains(have, t)))"
PATH = "CASE " + " ".join(f"WHEN contains(g, {q(k)}) THEN {q(l)}" for k, l in lx.LEARNING_PATHS) + " END"
PLAN = f"""mine AS (SELECT user_id, list_transform(list_concat(skills, technologies), lambda s: lower(s)) AS have FROM profiles),
pl AS (SELECT saved_id, e.*, have, {GAPS} AS gaps, {EFFORT_HAY} AS hay FROM saved JOIN enriched e ON e.id = listing_id JOIN mine USING (user_id)),
pp AS (SELECT *, list_filter(list_transform(gaps, lambda g: {{'skill': g, 'path': {PATH}}}), lambda x: x.path IS NOT NULL) AS paths FROM pl)"""


@query("apply_plan", "M11 J13 U4 P29", with_enriched(f"""SELECT saved_id, array_to_string(gaps, '|') AS gaps, coalesce(paths[1].skill, gaps[1], 'core') AS skill, coalesce(paths[1].path, 'Core software skills') AS path, {EFFORT_CASE(1)} AS minutes_low,
  CASE WHEN years_required_min >= 3 THEN 'It asks for ' || years_required_min || '+ years, more than a first job gives.' WHEN career_stage IN ('senior', 'mid') THEN 'The title is above entry level.' END AS skip_reason FROM pp""", ", ".join([sv.PROFILES, sv.SAVED, PLAN])))
def _(spark, sf):
    mine = fx.profiles(spark, sf).select("user_id", F.concat("skills", "technologies").alias("have"))
    rows = fx.saved(spark, sf).select("saved_id", "user_id", C("listing_id").alias("id")).join(fx.enriched(spark, sf), "id").join(mine, "user_id")
    return matching.apply_plan(rows).select("saved_id", "gaps", C("path.skill").alias("skill"), C("path.path").alias("path"), C("effort.minutes_low").alias("minutes_low"), "skip_reason")


SETS = f"""sets AS (SELECT DISTINCT universe FROM (SELECT {GROW('list_concat(skills, technologies)')} AS universe FROM profiles) WHERE len(universe) > 0),
tagged AS (SELECT id, posted_at, unnest({GROW('list_concat(skills, tech_tags)')}) AS tag FROM enriched),
shared AS (SELECT universe, id, posted_at, count(*) AS shared FROM (SELECT universe, unnest(universe) AS tag FROM sets) JOIN tagged USING (tag) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY shared DESC, posted_at DESC NULLS LAST, id) AS position FROM shared QUALIFY position <= 5)"""


@query("tag_candidates", "J10", with_enriched(f"SELECT user_id, id AS listing_id, shared, position FROM (SELECT user_id, {GROW('list_concat(skills, technologies)')} AS universe FROM profiles) JOIN best USING (universe)", ", ".join([sv.PROFILES, SETS])))
def _(spark, sf):
    return recommend.tag_candidates(fx.profiles(spark, sf), fx.enriched(spark, sf), 5, NOW)
