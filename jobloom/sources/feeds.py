"""Landed feed payloads to listing rows: one field map per source.

A landed row has ``source``, ``payload`` (JSON text of a whole response or of
one item) and, for boards, ``ats_slug``, ``company_name``, ``company_url`` and
``career_page_url``.  Payloads are parsed once into VARIANT; every field is
then a path lookup, and a malformed payload yields no rows instead of failing.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom import lexicons as lx
from jobloom.functions import enrich, seniority, times, urls
from jobloom.functions.enrich import NO_TAGS
from jobloom.functions.markup import markup_text
from jobloom.functions.text import (
    blank_to_null, has_any, let, looks_technical, software_role, split_company_role, strip, technical_category, text,
)
from jobloom.runtime import settle, union_all

# Words that keep an item of two general feeds.
TAGGED_WORDS = ["dev", "engineer", "software", "backend", "frontend", "full", "data", "python", "java", "react", "node", "devops", "mobile", "ai", "ml"]
TAGGED_TITLES = ["engineer", "developer", "software", "devops", "sre", "data", "ml", "ai"]
GENERAL_TITLES = ["engineer", "developer", "software", "devops", "data", "ml", "ai", "sre", "frontend", "backend", "full stack", "intern"]

# Where each source keeps each field.  Lists name alternatives,
# first present wins.  ``items`` is the path of the item list; ``board`` means
# ids are prefixed with the board; ``hint`` is the workplace hint.
FIELD_MAPS = {
    "remotive": {
        "items": "$.jobs", "id": ["id"], "title": ["title"], "company": ["company_name"], "link": ["url"],
        "body": ["description"], "place": ["candidate_required_location"], "place_default": "Remote",
        "tags": "tags", "employment": ["job_type"], "level_if_intern": ["job_type"], "posted": ["publication_date"],
        "workplace": "remote", "role": "any", "stale": "keep",
    },
    "remoteok": {
        "items": "$", "id": ["id"], "needs": ["id", "position"], "title": ["position", "title"], "company": ["company"],
        "company_url": ["company_link"], "link": ["apply_url", "url"], "career": ["url"], "body": ["description"],
        "place": ["location"], "place_default": "Remote", "tags": "tags", "posted": ["date", "epoch"],
        "hint": "remote", "role": "tagged", "stale": "keep", "html": "always",
    },
    "jobicy": {
        "items": "$.jobs", "id": ["id", "url"], "title": ["jobTitle"], "company": ["companyName"], "company_url": ["companyUrl"],
        "link": ["url"], "body": ["jobDescription"], "place": ["jobGeo"], "place_default": "Remote", "tags": "jobIndustry",
        "employment_list": ("jobType", ", "), "level_list": ("jobLevel", None, " "), "posted": ["pubDate"],
        "hint": "remote", "role": "general", "stale": "keep",
    },
    "himalayas": {
        "items": "$.jobs", "id": ["guid", "applicationLink"], "title": ["title"], "company": ["companyName"],
        "link": ["applicationLink"], "body": ["description", "excerpt"], "place_list": ("locationRestrictions", "name", 8),
        "place_default": "Worldwide Remote", "tags": "categories", "tag_cap": 8, "employment": ["employmentType"],
        "level_list": ("seniority", None, " "), "posted": ["pubDate"], "expires": ["expiryDate"],
        "hint": "remote", "role": "technical_or_category", "stale": "drop",
    },
    "arbeitnow": {
        "items": "$.data", "id": ["slug", "url"], "title": ["title"], "company": ["company_name"], "link": ["url"],
        "body": ["description"], "place": ["location"], "place_if_remote": "Remote", "tags": "tags",
        "employment_list": ("job_types", " "), "posted": ["created_at"], "hint_if": "remote", "role": "technical",
        "level_if_intern_in": True, "stale": "drop", "needs_link": True,
    },
    "themuse": {
        "items": "$.results", "id": ["id"], "title": ["name"], "company": ["company.name"], "link": ["refs.landing_page"],
        "body": ["contents"], "place_list": ("locations", "name", None), "place_default": "Remote",
        "employment": ["type"], "level_list": ("levels", "name", " "), "posted": ["publication_date"], "hint": "remote",
        "role": "technical", "stale": "drop",
    },
    "weworkremotely": {
        "items": "$", "id": ["guid", "link"], "title": ["title"], "split_title": True, "link": ["link"],
        "body": ["description"], "place": ["region", "country", "location"], "place_default": "Remote", "posted": ["pubDate"],
        "hint": "remote", "role": "technical_or_software", "stale": "drop", "html": "always",
    },
    "remotejobsorg": {
        "items": ["$", "$.jobs", "$.data"], "id": ["id", "slug", "url"], "title": ["title", "position"],
        "company": ["company.name", "company_name", "company"], "company_url": ["company.url", "company.website", "company_url", "company_website"],
        "link": ["url", "apply_url", "application_url", "link"], "body": ["description", "description_html"],
        "place": ["location", "location_raw"], "place_default": "Remote", "employment": ["type", "employment_type"],
        "posted": ["published_at", "posted_at", "date", "created_at"], "hint": "remote", "role": "technical_or_title",
        "stale": "drop", "needs_link": True, "html": "always",
    },
    "greenhouse": {
        "items": "$.jobs", "id": ["id"], "board": True, "title": ["title"], "link": ["absolute_url"], "body": ["content"],
        "place": ["location.name", "location"], "posted": ["first_published", "updated_at"], "role": "any", "stale": "drop",
        "needs_link": True, "html": "always",
    },
    "lever": {
        "items": "$", "id": ["id"], "board": True, "title": ["text"], "link": ["applyUrl", "hostedUrl"],
        "body_join": ["descriptionPlain", "description", "additionalPlain", "additional"], "body_lists": ("lists", ["text", "content"]),
        "place": ["categories.location"], "employment": ["categories.commitment"], "posted": ["createdAt"],
        "hint_keys": ["workplaceType", "categories.commitment"], "role": "technical", "stale": "drop",
    },
    "ashby": {
        "items": "$.jobs", "id": ["id"], "board": True, "title": ["title"], "link": ["applyUrl", "jobUrl"],
        "body": ["descriptionPlain", "descriptionHtml"], "body_html": ["descriptionHtml"], "place": ["location"],
        "employment": ["employmentType"], "posted": ["publishedAt"], "hint_keys": ["workplaceType"], "hint_if": "isRemote",
        "not_false": ["isListed"], "role": "technical", "stale": "drop",
    },
    "workable": {
        "items": "$.jobs", "id": ["shortcode", "id"], "board": True, "title": ["title"], "link": ["url", "shortlink"],
        "body": ["full_description", "description"], "place": ["location.city", "location.country", "locations[0].city", "locations[0].country"],
        "employment": ["employment_type"], "posted": ["published_on", "created_at"], "hint_if": "remote", "role": "technical", "stale": "drop",
    },
    "smartrecruiters": {
        "items": "$.content", "id": ["id", "uuid", "refNumber"], "board": True, "title": ["name", "title"],
        "link": ["applyUrl", "postingUrl"], "public_link": True, "body_sections": "jobAd.sections",
        "place_join": ["location.city", "location.region", "location.country"], "place_remote_flag": "location.remote",
        "employment": ["typeOfEmployment.label"], "posted": ["releasedDate", "createdOn"], "role": "software", "stale": "keep",
        "html": "never", "body_or_title": True,
    },
    "recruitee": {
        "items": "$.offers", "id": ["id", "slug"], "board": True, "title": ["title"], "link": ["careers_url", "url"],
        "link_form": ("https://", ".recruitee.com/o/", "slug"), "body": ["description", "description_html"], "place": ["location", "city"],
        "employment": ["employment_type", "contract_type"], "posted": ["published_at", "created_at"], "hint_if": "remote|workplace_type",
        "role": "technical", "stale": "drop",
    },
    "personio": {
        "items": "$", "id": ["id", "name"], "board": True, "title": ["name"], "link_form": ("https://", ".jobs.personio.de/job/", "id"),
        "body_lists": ("jobDescriptions.jobDescription", ["name", "value"]), "place": ["office"], "tags_from": ["department"],
        "employment": ["employmentType"], "title_suffix": ["seniority"], "posted": ["createdAt"], "role": "technical",
        "stale": "null", "html": "always",
    },
    "teamtailor": {
        "items": "$.items", "id": ["id", "url"], "title": ["title"], "link": ["url"], "body": ["content_html"],
        "place": ["_jobposting.jobLocation.address", "_jobposting.jobLocation.name", "_jobposting.jobLocation", "_jobposting.location.address", "_jobposting.location.name", "_jobposting.location"],
        "posted": ["date_published"], "role": "technical", "stale": "drop", "needs_link": True, "html": "always",
    },
    "breezy": {
        "items": "$", "id": ["_id", "id", "url"], "board": True, "title": ["name", "title"], "link": ["url", "friendly_id"], "relative_link": True,
        "body": ["description"], "place": ["location.name", "location.city", "location[0].name", "location[0]", "location"],
        "employment": ["type.name", "type.id", "type"], "posted": ["published_date", "created_date"], "hint_keys": ["type.name", "type.id", "type"],
        "departments": "department", "role": "technical", "stale": "drop", "needs_link": True,
    },
    "workday": {
        "items": "$", "id": ["jobPostingInfo.jobReqId", "jobPostingInfo.jobPostingId", "jobPostingInfo.id", "externalPath"], "board": True,
        "needs": ["jobPostingInfo"], "title": ["jobPostingInfo.title", "title"], "link": ["jobPostingInfo.externalUrl"], "board_path": "externalPath",
        "body": ["jobPostingInfo.jobDescription"], "place": ["jobPostingInfo.location", "locationsText"], "place_country": "jobPostingInfo.country.descriptor",
        "employment": ["jobPostingInfo.timeType", "timeType"], "posted": ["jobPostingInfo.startDate"],
        "not_false": ["jobPostingInfo.posted", "jobPostingInfo.canApply"], "role": "software", "stale": "drop", "needs_link": True,
        "html": "always", "body_or_title": True,
    },
    "bamboohr": {
        "items": "$.result", "id": ["id"], "board": True, "title": ["detail.jobOpeningName", "jobOpeningName", "jobTitle"],
        "link_form": ("https://", ".bamboohr.com/careers/", "id"), "body": ["detail.description", "detail.jobDescription", "detail.descriptionHtml"],
        "place_join": ["location.city", "location.state", "location.province", "location.country"], "place_remote_flag": "isRemote", "place_join_sep": ", ",
        "employment": ["employmentStatusLabel", "employmentType"], "posted": ["detail.datePosted", "detail.postedDate", "detail.createdDate"],
        "workplace_if": "isRemote", "role": "any", "stale": "drop", "html": "always",
    },
}


def landed_items(raw: DataFrame, source: str) -> DataFrame:
    """One row per item of a source's payloads, parsed once."""
    spec = FIELD_MAPS[source]
    rows = raw.filter(F.col("source") == source).withColumn("_doc", F.try_parse_json("payload"))
    paths = spec["items"] if isinstance(spec["items"], list) else [spec["items"]]
    lists = [F.try_variant_get("_doc", p, "array<variant>") for p in paths]
    single = F.array(F.col("_doc"))
    return rows.withColumn("v", F.explode(F.coalesce(*lists, single))).filter("v is not null").drop("_doc", "payload")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def _first(paths) -> Column:
    """First present, non-empty plain value; objects and lists do not count."""
    plain = lambda p: F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant")), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)"), _get(p))
    return F.coalesce(*[blank_to_null(plain(p)) for p in paths])


def _names(path: str, key: str | None, cap: int | None = None) -> Column:
    """Strings of a list of texts or of objects with a name; a lone text too."""
    items = F.coalesce(_get(path, "array<variant>"), F.array(F.try_variant_get("v", f"$.{path}", "variant")))
    if cap:
        items = F.slice(items, 1, cap)
    named = lambda x: F.coalesce(F.try_variant_get(x, f"$.{key}", "string") if key else F.lit(None), F.try_variant_get(x, "$", "string"))
    return F.filter(F.transform(items, named), lambda s: F.length(s) > 0)


def _truthy(paths: str) -> Column:
    tests = [F.coalesce(F.lower(_get(p)), F.lit("")) for p in paths.split("|")]
    return enrich.any_of([~t.isin("", "false", "0", "null") for t in tests])


def _body(spec) -> Column:
    if "body_sections" in spec:
        sections = F.map_values(F.try_variant_get("v", f"$.{spec['body_sections']}", "map<string,variant>"))
        return F.array_join(F.transform(sections, lambda s: F.coalesce(F.try_variant_get(s, "$.text", "string"), F.lit(""))), " ")
    parts = [blank_to_null(_get(p)) for p in spec.get("body_join", [])]
    if "body_lists" in spec:
        path, keys = spec["body_lists"]
        blocks = F.coalesce(_get(path, "array<variant>"), F.array().cast("array<variant>"))
        block = lambda b: F.concat_ws("\n", *[blank_to_null(F.try_variant_get(b, f"$.{k}", "string")) for k in keys])
        parts.append(blank_to_null(F.array_join(F.transform(blocks, block), "\n")))
    return F.concat_ws("\n", *parts) if parts else _first(spec["body"])


def _place(spec) -> Column:
    if "place_list" in spec:
        path, key, cap = spec["place_list"]
        place = blank_to_null(F.array_join(_names(path, key, cap), ", "))
    elif "place_join" in spec:
        joined = F.concat_ws(", ", *[blank_to_null(_get(p)) for p in spec["place_join"]])
        sep = spec.get("place_join_sep", " · ")
        remote = F.when(joined != "", F.concat(joined, F.lit(sep + "Remote"))).otherwise("Remote")
        place = blank_to_null(F.when(_truthy(spec["place_remote_flag"]), remote).otherwise(joined))
    else:
        place = _first(spec["place"])
        place = F.coalesce(place, blank_to_null(F.array_join(_names(spec["place"][0], "name"), ", "))) if spec.get("place_default") else place
    if "place_country" in spec:
        country = strip(text(_get(spec["place_country"])))
        lacks = (country != "") & ~F.lower(text(place)).contains(F.lower(country))
        place = F.when(lacks, F.concat_ws(", ", place, country)).otherwise(place)
    if "place_if_remote" in spec:
        place = F.coalesce(place, F.when(_truthy("remote"), F.lit(spec["place_if_remote"])))
    return F.coalesce(place, F.lit(spec["place_default"])) if "place_default" in spec else place


def _link(spec) -> Column:
    link = urls.normalize_url(_first(spec["link"])) if "link" in spec else F.lit(None).cast("string")
    if spec.get("public_link"):
        link = F.when(~F.lower(link).contains("api.smartrecruiters.com/"), link)
        link = F.coalesce(link, urls.public_posting_url(F.col("ats_slug"), _first(spec["id"]), strip(text(_first(spec["title"])))))
    if "link_form" in spec:
        head, middle, key = spec["link_form"]
        link = F.coalesce(link, F.concat(F.lit(head), F.col("ats_slug"), F.lit(middle), _first([key])))
    if "board_path" in spec:
        link = F.coalesce(link, F.concat(F.regexp_replace("career_page_url", "/+$", ""), _get(spec["board_path"])))
    if spec.get("relative_link"):
        absolute = F.concat(F.regexp_replace("career_page_url", "/+$", ""), F.lit("/"), F.regexp_replace(link, "^/+", ""))
        link = F.when(link.startswith("http"), link).otherwise(absolute)
    return link


def _keeps(spec, title, raw_title, body_text, tags) -> Column:
    role = spec["role"]
    if role == "technical":
        departments = _names(spec["departments"], "name") if "departments" in spec else None
        return looks_technical(title, departments)
    if role == "software":
        return software_role(title, body_text)
    if role == "technical_or_software":
        return looks_technical(title) | software_role(title, body_text) | looks_technical(raw_title)
    if role == "technical_or_title":
        return looks_technical(title) | software_role(title, F.lit(None).cast("string"))
    if role == "technical_or_category":
        return looks_technical(title) | technical_category(tags)
    if role == "tagged":
        blob = F.lower(F.array_join(tags, " "))
        return (F.size(tags) == 0) | has_any(blob, TAGGED_WORDS) | has_any(F.lower(title), TAGGED_TITLES)
    return has_any(F.lower(title), GENERAL_TITLES) if role == "general" else F.lit(True)


def normalize_source(raw: DataFrame, source: str, as_of, days: int) -> DataFrame:
    """Canonical rows of one source."""
    spec = FIELD_MAPS[source]
    board = {"ats_slug": "string", "company_name": "string", "company_url": "string", "career_page_url": "string"}
    for name, kind in board.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    items = landed_items(raw, source)
    for need in spec.get("needs", []):
        items = items.filter(F.try_variant_get("v", f"$.{need}", "variant").isNotNull())
    for flag in spec.get("not_false", []):
        items = items.filter(F.coalesce(_get(flag, "boolean"), F.lit(True)))
    raw_title = strip(text(_first(spec["title"])))
    if spec.get("split_title"):
        both = split_company_role(raw_title)
        title, company = both["role"], both["company"]
    else:
        title = raw_title
        company = strip(text(_first(spec["company"]))) if "company" in spec else F.col("company_name")
    empty = F.array().cast(NO_TAGS)
    tags = _names(spec["tags"], "name", spec.get("tag_cap")) if "tags" in spec else (
        F.array_compact(F.array(_first(spec["tags_from"]))) if "tags_from" in spec else empty)
    body = _body(spec)
    readable = lambda b: F.when(b.contains("<"), markup_text(b)).otherwise(b)
    body_text = F.col("_text")
    if "body_html" in spec:
        html = _first(spec["body_html"])
    else:
        html = {"always": F.col("_body"), "never": F.lit(None).cast("string")}.get(spec.get("html"), F.when(F.col("_body").contains("<"), F.col("_body")))
    posted = F.coalesce(*[times.parse_instant(_get(p)) for p in spec["posted"]])
    employment = (
        blank_to_null(F.array_join(_names(spec["employment_list"][0], None), spec["employment_list"][1])) if "employment_list" in spec
        else _first(spec["employment"]) if "employment" in spec else F.lit(None).cast("string"))
    if "level_list" in spec:
        path, key, sep = spec["level_list"]
        level = blank_to_null(strip(F.array_join(_names(path, key), sep)))
    elif "level_if_intern" in spec:
        level = F.when(F.lower(employment).contains("intern"), employment)
    elif spec.get("level_if_intern_in"):
        level = F.when(F.lower(F.concat_ws(" ", title, employment)).contains("intern"), F.lit("internship"))
    else:
        level = F.lit(None).cast("string")
    place = _place(spec)
    hint = F.lit(spec.get("hint")).cast("string")
    if "hint_keys" in spec:
        hint = F.coalesce(hint, _first(spec["hint_keys"]))
    if "hint_if" in spec:
        hint = F.coalesce(hint, F.when(_truthy(spec["hint_if"]), F.lit("remote")))
    workplace = F.lit(spec["workplace"]) if "workplace" in spec else enrich.workplace_type(place, hint, body_text)
    if "workplace_if" in spec:
        workplace = F.when(_truthy(spec["workplace_if"]), F.lit("remote")).otherwise(workplace)
    link = _link(spec)
    key = F.coalesce(_first(spec["id"]), link)
    external = F.concat(F.col("ats_slug"), F.lit(":"), key) if spec.get("board") else key
    stage_title = F.concat_ws(" ", title, *[_get(p) for p in spec.get("title_suffix", [])])
    carry = [c for c in ("seq",) if c in items.columns]
    # Many word tests read the same few fields, so those are bound first; the body is read only where the title leaves it open.
    fields = F.struct(title.alias("title"), raw_title.alias("raw"), tags.alias("tags"))
    kept = let(fields, lambda x: _keeps(spec, x["title"], x["raw"], let(body, readable), x["tags"]))
    # Body and text are columns of their own: as expressions they would be computed anew wherever they are named.
    items = items.filter(kept).withColumn("_body", body).withColumn("_text", readable(F.col("_body")))
    rows = items.select(
        F.lit(source).alias("source"), external.alias("external_id"), title.alias("title"),
        company.alias("company_name"), (urls.normalize_url(_first(spec["company_url"])) if "company_url" in spec else F.col("company_url")).alias("company_url"),
        F.coalesce(urls.normalize_url(_first(spec["career"])) if "career" in spec else F.lit(None), F.col("career_page_url"), link).alias("career_page_url"),
        link.alias("apply_url"), (F.coalesce(blank_to_null(body_text), title) if spec.get("body_or_title") else body_text).alias("description_text"),
        html.alias("description_html"), place.alias("location_raw"), workplace.alias("workplace_type"),
        employment.alias("employment_type"), level.alias("source_level"), tags.alias("source_tags"),
        stage_title.alias("stage_title"), posted.alias("posted_at"),
        (times.parse_instant(_first(spec["expires"])) if "expires" in spec else F.lit(None).cast("timestamp")).alias("expires_at"), *carry,
    ).filter("title <> '' and company_name <> ''")
    if spec.get("needs_link"):
        rows = rows.filter("apply_url is not null")
    old = F.coalesce(F.col("posted_at") < times.minus_days(as_of, days), F.lit(False))
    rows = rows.filter(~F.coalesce(F.col("expires_at") < times.at(as_of), F.lit(False)))
    if spec["stale"] == "drop":
        rows = rows.filter(~old)
    elif spec["stale"] == "null":
        rows = rows.withColumn("posted_at", F.when(~old, F.col("posted_at")))
    return rows.drop("expires_at")


def normalize_feed(raw: DataFrame, as_of, days: int, sources=None) -> DataFrame:
    """Canonical listing rows of every source, enriched and classified.

    Each source reads only its own rows (a partition when landed by source).
    The union is written once to the shared folder, so that the enrichment is
    one projection over it instead of one copy per source.
    """
    parts = [normalize_source(raw, s, as_of, days) for s in sources or FIELD_MAPS]
    rows = settle(union_all(parts), "normalized")
    blob = enrich.listing_blob(F.col("title"), F.col("description_text"), F.col("location_raw"))
    rows = seniority.classify(rows, title="stage_title")
    return rows.withColumns({
        "skills": enrich.extract_skills(blob), "tech_tags": enrich.extract_skills(blob, F.col("source_tags")),
        "region_friendly": enrich.region_friendly(F.col("workplace_type"), F.col("location_raw"), F.col("description_text")),
    }).drop("stage_title", "source_tags")


POSITION_SCHEMA = (
    "id string, name string, office string, department string, employmentType string, seniority string, createdAt string, "
    "jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
)
NEWS_SCHEMA = "guid string, link string, title string, description string, pubDate string, region string, country string, location string"


def read_xml_feed(spark, path: str, row_tag: str, schema: str, source: str) -> DataFrame:
    """XML positions or news items as landed rows, split by the XML reader."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    return rows.select(F.lit(source).alias("source"), F.to_json(F.struct("*")).alias("payload"))
