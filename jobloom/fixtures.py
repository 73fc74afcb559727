"""Catalogue views over the supplied tables.

Each view is a join of whole tables, so its work grows with them.  The same
rules are stated in SQL in ``queries/sql_views.py`` for the checks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobloom import lexicons as lx
from jobloom.functions import enrich, seniority
from jobloom.runtime import settle, spread

AS_OF = "2024-01-31T00:00:00"
DAYS = 14

# What the listings view mixes in.
TITLE_PREFIX = ["Senior ", "Junior ", "", "", "Intern ", "New Grad ", "Mid-level ", "Staff "]
LOCATIONS = [
    "Lahore, Pakistan", "Remote, United States", "Berlin, Germany",
    "London, UK", "Worldwide", "", "Toronto, ON, Canada", "Austin, TX",
    None, "Hybrid - Karachi", "Bengaluru, India", "Remote",
]
BODY_NOTES = [
    "Python and React with PostgreSQL. ", "Docker, Kubernetes on AWS. ", "", "",
    "Source code review in Java. Must be eligible to work. ",
    "Unpaid internship or equivalent experience. ", "Degree required. ",
]
EMPLOYMENT = ["Full-time", "Contract", None, "Part time", "Internship", "other"]
WORKPLACES = ["remote", "hybrid", "onsite", "unknown"]
CORPUS_LEXICON = {w: [rf"\b{w}\b"] for w in ["the", "and", "with", "that", "der", "le", "de", "el", "la"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def instant(name: str) -> Column:
    """Stored times carry no zone; they are UTC."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name).cast("timestamp_ntz"))
    return F.timestamp_micros(micros)


def pick(values, index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def row_count(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def sizes(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, under the names given."""
    counted = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in tables.items()]
    return reduce(DataFrame.crossJoin, counted)


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue.  What belongs to an id is joined on slim rows first; texts move once, by id, and vectors after them."""
    documents, pages, events, parts, suppliers = (table(spark, sf, t) for t in ("documents", "pages", "events", "part", "supplier"))
    doc = F.col("doc_id")
    counts = sizes(n_pages=pages, n_events=events, n_parts=parts, n_suppliers=suppliers)
    ids = documents.select("doc_id").distinct().crossJoin(F.broadcast(counts)).select(
        "doc_id", (doc % F.col("n_pages")).alias("g"),
        (doc * 7919 % F.col("n_events")).alias("ek"),
        (doc % 25).cast("int").alias("nk"), "n_parts", "n_suppliers",
    ).withColumns({"pk": F.col("g") % F.col("n_parts"), "sk": F.col("g") % F.col("n_suppliers")})
    part = parts.select(F.col("p_partkey").alias("pk"), "p_name")
    supplier = suppliers.select(F.col("s_suppkey").alias("sk"), "s_name")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    facts = (
        ids.join(part, "pk").join(supplier, "sk").join(nation, "nk")
        .join(events.select(F.col("event_id").alias("ek"), instant("ts").alias("ts")), "ek")
        .join(pages.select(F.col("page_id").alias("g"), "url", "html"), "g")
    )
    texts = spread(documents.select("doc_id", "text", "source"), "doc_id").select(
        "doc_id", F.col("text").alias("body"), (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 19).alias("si"))
    rows = texts.join(facts, "doc_id").join(vectors, "doc_id", "left")
    odd = doc % 2 == 1
    board = F.concat(F.lit("b"), F.col("sk").cast("string"))
    has_vector = F.col("embedding").isNotNull() & (doc % 4 != 3)
    title = F.concat(
        pick(TITLE_PREFIX, F.col("g") % 8), F.col("p_name"), F.when(F.col("g") % 3 == 0, " - Remote").otherwise("")
    )
    place = pick(LOCATIONS, doc % 12)
    body = F.concat(
        F.when(~odd, F.concat((doc % 9).cast("string"), F.lit("+ years. "))).otherwise(""),
        pick(BODY_NOTES, doc % 7), F.col("body"),
    )
    location = F.when(place == "", F.col("n_name")).otherwise(place)
    url = F.when(
        doc % 23 == 0,
        F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/"), board, F.lit("/postings/"), doc.cast("string")),
    ).when(odd, F.regexp_replace("url", "^http:", "https:")).otherwise(F.col("url"))
    return rows.select(
        doc.alias("id"), F.concat(board, F.lit(":"), doc.cast("string")).alias("external_id"),
        pick(lx.SOURCE_PREFERENCE, F.col("si")).alias("source"), title.alias("title"),
        F.col("s_name").alias("company_name"), url.alias("apply_url"),
        body.alias("description_text"), F.col("html").alias("description_html"),
        location.alias("location_raw"), pick(WORKPLACES, doc % 4).alias("workplace_type"),
        pick(EMPLOYMENT, doc % 6).alias("employment_type"),
        F.lit(None).cast("string").alias("source_level"),
        F.when(doc % 5 != 0, F.col("ts")).alias("posted_at"), F.col("ts").alias("first_seen_at"),
        F.timestamp_micros(F.unix_micros("ts") + (doc % 4) * 86_400_000_000).alias("last_seen_at"),
        (doc % 10 != 9).alias("is_active"), (doc % 3).cast("int").alias("missed_runs"),
        F.when(has_vector, F.col("embedding")).alias("embedding"),
        F.when(has_vector, F.when(odd, "b").otherwise("a")).alias("embedding_provider"),
        F.lit(None).cast("string").alias("embedding_hash"),
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with skills, tags, stage, eligibility and region."""
    df = seniority.classify(listings(spark, sf))
    blob = enrich.listing_blob(F.col("title"), F.col("description_text"), F.col("location_raw"))
    words = F.col("_words")
    return df.withColumn("_words", enrich.lexicon_words(blob, lx.SKILL_LEXICON, CORPUS_LEXICON)).withColumns({
        "skills": enrich.extract_skills(blob, words=words),
        "tech_tags": enrich.extract_skills(blob, lexicon=CORPUS_LEXICON, words=words),
        "region_friendly": enrich.region_friendly(F.col("workplace_type"), F.col("location_raw"), F.col("description_text")),
    }).drop("_words")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched catalogue as a table, for operators that read it often."""
    return settle(enriched(spark, sf).drop("description_html", "seniority_signals"), "listings")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    skill_sets = [
        ["Python", "React"], ["docker", "k8s"], ["java"], ["the", "and"], ["le", "de"], ["agile", "ReactJS"], [],
    ]
    roles = [["small bolt"], [], ["Senior red anvil"], None, ["gear"], ["widget", "plate"]]
    as_lists = lambda vs: [F.array(*[F.lit(x) for x in v]).cast("array<string>") if v is not None else F.lit(None).cast("array<string>") for v in vs]
    choose = lambda vs, i: F.element_at(F.array(*as_lists(vs)), i.cast("int") + 1)
    levels = {"MACHINERY": "junior", "BUILDING": "senior", "AUTOMOBILE": "mid", "FURNITURE": "internship", "HOUSEHOLD": ""}
    level = F.lit(None).cast("string")
    for segment, name in levels.items():
        level = F.when(F.col("c_mktsegment") == segment, F.lit(name)).otherwise(level)
    # Lists are normalised row by row, so the rows are dealt to all cores first.
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    return (
        customers.join(F.broadcast(nation), "c_nationkey")
        .select(
            key.alias("user_id"), choose(skill_sets, key % 7).alias("skills"),
            choose([["typescript"], [], ["golang", "python"]], key % 3).alias("technologies"),
            choose(roles, key % 6).alias("desired_roles"), level.alias("experience_level"),
            pick(["remote", "any", "onsite"], key % 3).alias("remote_preference"),
            F.array(pick(["Lahore", "Berlin", "Austin", ""], key % 4), F.col("n_name")).alias("cities"),
            pick([None, "remote worldwide jobs", "Germany preferred"], key % 3).alias("location_preference"),
            (key % 2 == 0).alias("region_friendly"),
            F.when(key % 4 == 0, "2024-01-02T00:00:00Z").alias("resume_uploaded_at"),
            F.when(key % 9 == 0, "2024-01-03T00:00:00Z").alias("onboarding_skipped_at"),
            F.when(key % 11 == 0, "2024-01-04T00:00:00Z").alias("onboarding_completed_at"),
        )
    )


def saved(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked applications; some point at listings that no longer exist."""
    docs = row_count(table(spark, sf, "documents"))
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "saved").when(F.col("o_orderstatus") == "O", "applied").otherwise("interview")
    # Order dates lie in the 1990s; shifted so that some fall in the look-back window.
    age = (F.datediff(F.lit("1999-01-01"), F.col("o_orderdate").cast("date")) % 30).cast("bigint")
    applied = F.timestamp_micros(F.unix_micros(F.lit(AS_OF + "Z").cast("timestamp")) - age * 86_400_000_000)
    return table(spark, sf, "orders").select(
        key.alias("saved_id"), F.col("o_custkey").alias("user_id"), (key % (docs + 20)).alias("listing_id"),
        status.alias("status"), applied.alias("created_at"),
        F.when(status != "saved", applied).alias("applied_at"),
        F.when(key % 4 != 0, applied).alias("last_touch_at"),
        F.when((status == "applied") & (key % 5 != 0), F.timestamp_micros(F.unix_micros(applied) + 7 * 86_400_000_000)).alias("follow_up_on"),
        F.when(key % 3 == 0, F.concat(F.lit("Saved "), (key % 50).cast("string"))).alias("saved_title"),
        F.when(key % 3 == 1, F.concat(F.lit("Firm "), (key % 20).cast("string"))).alias("saved_company"),
        F.lit(None).cast("string").alias("saved_url"),
    )


def saved_searches(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    words = ["the", "bolt", None, "anvil", "small ring", "gear", None, "python", "le de"]
    last = F.timestamp_micros(F.unix_micros(F.lit(AS_OF + "Z").cast("timestamp")) - F.lit(7 * 86_400_000_000))
    return table(spark, sf, "nation").select(
        key.cast("bigint").alias("search_id"), (key % 7).cast("bigint").alias("user_id"), F.col("n_name").alias("name"),
        pick(words, key % 9).alias("q"), pick([None, "remote", None, "hybrid"], key % 4).alias("workplace"),
        pick([None, None, "the, and", "python"], key % 4).alias("skills_csv"),
        pick(["10", "90", None, "x", "3"], key % 5).alias("posted_within"),
        pick([None, "junior", None, "senior", None], key % 5).alias("career_stage"),
        (key % 6 == 5).alias("region_friendly"), last.alias("last_checked_at"),
        pick([None, None, "Berlin", None, " lahore", None, None], key % 7).alias("city"),
        pick([None, None, None, "germany", None, None, "CANADA", None], key % 8).alias("country"),
        pick([None, "supplier", None], key % 3).alias("company"),
        pick([None, None, None, None, "full"], key % 5).alias("employment_type"),
        pick([None] * 8 + ["lever"], key % 9).alias("source"),
        (key % 8 == 3).alias("junior_eligible"), (key % 10 != 9).alias("is_active"),
    )


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), instant("ts").alias("started_at"),
        F.floor("value").cast("bigint").alias("jobs_fetched"),
        F.floor(F.col("value") / 2).cast("bigint").alias("jobs_upserted"),
        F.when(F.col("value") < 1, "x").when(F.col("event_id") % 3 == 0, "").alias("errors"),
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), instant("ts").alias("ts"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("seq"),
        F.when(key % 13 == 12, "").otherwise(pick(lx.BOARD_SOURCES, key % 11)).alias("ats_type"),
        F.when(key % 17 == 16, None).otherwise(F.concat(F.lit("board-"), (key % 60).cast("string"))).alias("ats_slug"),
        F.when(key % 6 != 0, F.col("s_name")).alias("name"),
        F.when(key % 2 == 0, F.concat(F.lit("https://s"), key.cast("string"), F.lit(".example.com"))).alias("website"),
        pick([None, "pakistan", "both", "global"], key % 4).alias("region_focus"),
        (key % 7 != 0).alias("is_enabled"),
    )


def grounding_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Original (user) and derived (assistant) text per conversation."""
    turns = table(spark, sf, "conversations").filter("role in ('user', 'assistant')")
    side = lambda role: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"]), "\n"
    )
    both = turns.groupBy("conv_id").agg(side("user").alias("original"), side("assistant").alias("derived"))
    figure = F.col("conv_id") % 40
    return both.filter("original <> '' and derived <> ''").select(
        F.col("conv_id").alias("doc_id"),
        F.concat("original", F.lit("\nGrew by 12% and 3x with python; "), figure.cast("string"), F.lit("% saved.")).alias("original"),
        F.concat("derived", F.lit("\nGrew by 12%, "), (figure + 1).cast("string"), F.lit("% and 1,200 users with React.")).alias("derived"),
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document line: heading, position and item text."""
    names = ["Summary", "References", "Technical Skills", "Work Experience", "professional references", "Awards", "Key Projects", "hobbies"]
    lines = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "item"))
    return lines.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        pick(names, (F.col("doc_id") + F.col("pos")) % 8).alias("heading"), "item",
    )


def query_set(spark: SparkSession, sf: str) -> DataFrame:
    """A search of every part whose id 50 divides: its name, OR, minus, phrase and hinting forms in turn."""
    words = F.split("p_name", " ")
    first, last = words[0], F.element_at(words, -1)
    forms = F.array(
        F.col("p_name"), F.concat(first, F.lit(" OR "), last), F.concat(last, F.lit(" -senior")),
        F.concat(F.lit('"'), F.col("p_name"), F.lit('" remote')), F.concat(F.lit("junior "), last, F.lit(" internship OR the python")),
    )
    key = F.col("p_partkey")
    return table(spark, sf, "part").filter(key % 50 == 0).select(key.alias("query_id"), F.element_at(forms, (key / 50 % 5).cast("int") + 1).alias("q"))


def job_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The searches of ``query_set`` with sorts and filters; every fourth has no words."""
    k = F.floor(F.col("query_id") / 50)
    when = lambda n, i, value: F.when(k % n == i, value)
    return query_set(spark, sf).select(
        "query_id", F.when(k % 4 != 3, F.col("q")).alias("q"), pick(["relevance", "newest", "company", "relevance"], k % 4).alias("sort"),
        when(5, 1, "Remote").alias("workplace"), F.when(k % 6 == 2, "Junior").when(k % 6 == 4, "senior").alias("career_stage"),
        when(7, 3, F.array(F.lit("the"), F.lit("le"))).alias("skills"), when(8, 2, "Berlin").alias("city"), when(9, 4, "SUPPLIER").alias("company"),
        when(10, 5, 3).alias("posted_within"), (k % 11 == 6).alias("region_friendly"),
    )


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id 50 divides."""
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )


def _nested(pairs: dict):
    """A struct from dotted paths."""
    tree = {}
    for path, value in pairs.items():
        node = tree
        *heads, leaf = path.split(".")
        for h in heads:
            node = node.setdefault(h, {})
        node[leaf] = value
    build = lambda n: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in n.items()])
    return build(tree)


def raw_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Every listing as the payload its source would have sent."""
    from jobloom.sources.feeds import FIELD_MAPS

    rows = listings(spark, sf)
    title = F.concat("title", F.lit(" software engineer"))
    posted = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    board = F.split_part("external_id", F.lit(":"), F.lit(1))
    payload = F.lit(None).cast("string")
    for source, spec in FIELD_MAPS.items():
        wanted = {spec["title"][0]: F.concat("company_name", F.lit(": "), title) if spec.get("split_title") else title}
        wanted[spec["id"][0]] = F.col("id")
        wanted[spec["posted"][0]] = posted
        if "company" in spec:
            wanted[spec["company"][0]] = F.col("company_name")
        if "link" in spec:
            wanted[spec["link"][0]] = F.col("apply_url")
        for need in spec.get("needs", []):
            if "." not in need and not any(k == need or k.startswith(need + ".") for k in wanted):
                wanted[need] = title
        if "body_sections" in spec:
            wanted[spec["body_sections"] + ".jobDescription.text"] = F.col("description_text")
        elif "body_join" in spec:
            wanted[spec["body_join"][0]] = F.col("description_text")
        elif "body_lists" in spec:
            path, keys = spec["body_lists"]
            wanted[path] = F.array(F.struct(F.col("description_text").alias(keys[-1])))
        else:
            wanted[spec["body"][0]] = F.col("description_text")
        if "place_list" in spec:
            wanted[spec["place_list"][0]] = F.array(F.struct(F.col("location_raw").alias("name")))
        elif "place" in spec:
            wanted[spec["place"][0].replace("[0]", "")] = F.col("location_raw")
        item = _nested(wanted)
        path = spec["items"] if isinstance(spec["items"], str) else "$"
        whole = F.array(item) if path == "$" else F.struct(F.array(item).alias(path[2:]))
        payload = F.when(F.col("source") == source, F.to_json(whole)).otherwise(payload)
    return rows.select(
        F.col("id").alias("seq"), "source", payload.alias("payload"), board.alias("ats_slug"), "company_name",
        F.lit(None).cast("string").alias("company_url"), F.lit("https://careers.example.com").alias("career_page_url"),
    )
