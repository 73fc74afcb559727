"""Sitemap entries, result views and schema.org documents."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import enrich, origin, places, times
from jobloom.functions.text import blank_to_null, capitalised, clip_with_ellipsis, squash, strip, text, thin_description
from jobloom.operators.filters import fresh


def sitemap_entries(df: DataFrame, as_of, days: int, page: int = 1, size: int = 5000) -> DataFrame:
    """Newest fresh listings with a real description; one page."""
    modified = F.coalesce("posted_at", "last_seen_at", "first_seen_at")
    rows = fresh(df, as_of, days).filter(F.length(text(F.col("description_text"))) >= 60)
    rows = rows.select("id", modified.alias("last_modified")).filter("last_modified is not null")
    return rows.orderBy(F.desc("last_modified"), F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def result_view(df: DataFrame, snippet: int = 500) -> DataFrame:
    """Listing rows as shown in a result list."""
    return df.withColumns({
        "description_text": clip_with_ellipsis(F.col("description_text"), snippet),
        "description_html": F.lit(None).cast("string"),
        "source_kind": origin.source_kind(F.col("source")), "source_kind_label": origin.source_label(F.col("source")),
    })


def shown_workplace() -> Column:
    return F.when((F.length("workplace_type") > 0) & (F.col("workplace_type") != "unknown"), capitalised(F.col("workplace_type")))


def listing_summary() -> Column:
    """Stand-in description of a listing that has none worth showing."""
    place, emp = blank_to_null(F.col("location_raw")), blank_to_null(F.col("employment_type"))
    return F.concat_ws(
        "\n\n", F.concat("title", F.lit(" at "), "company_name", F.lit(".")), F.concat(F.lit("Location: "), place, F.lit(".")),
        F.concat(F.lit("Employment: "), emp, F.lit(".")),
        F.concat(F.lit("Workplace: "), F.coalesce(shown_workplace(), F.lit("not specified by the source")), F.lit(".")),
        F.when(F.col("workplace_type") == "remote", "This role is listed as fully remote by the source."),
        F.lit("This listing is indexed from the employer’s official career system. Apply on the company page."),
    )


def meta_title() -> Column:
    return F.concat_ws(" — ", F.concat("title", F.lit(" at "), "company_name"), shown_workplace())


def meta_text() -> Column:
    """At most 160 characters describing a listing."""
    lead = F.concat_ws(" · ", blank_to_null(F.col("title")), blank_to_null(F.col("company_name")), shown_workplace(), blank_to_null(F.col("location_raw")))
    body = F.left(squash(text(F.col("description_text"))), F.lit(140))
    plain = F.concat(lead, F.lit(". Fresh listing — apply on the employer’s official career page."))
    good = (body != "") & (F.lower(body) != F.lower("title"))
    return F.left(F.when(good, F.concat(lead, F.lit(". "), body)).otherwise(plain), F.lit(160))


def body_html(c: Column) -> Column:
    """Plain text as paragraphs, escaped."""
    t = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.replace(F.regexp_replace(t, r"\n{2,}", "\u0001"), F.lit("\n"), F.lit("<br/>"))
    return F.concat(F.lit("<p>"), F.replace(t, F.lit("\u0001"), F.lit("</p><p>")), F.lit("</p>"))


def posting_export(df: DataFrame, as_of, days: int, base_url: str = "https://listings.example.com") -> DataFrame:
    """(id, document): one schema.org job posting per indexable listing.

    ``to_json`` leaves NULL fields out, so absent facts are simply not stated.
    """
    anchor = F.coalesce("posted_at", "first_seen_at", "last_seen_at")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = df.filter(times.is_indexable(F.col("is_active"), anchor, as_of, days) & anchor.isNotNull())
    wt = F.lower(text(F.col("workplace_type")))
    filled = blank_to_null(strip(text(F.col("description_text"))))
    body = body_html(F.when(thin_description(F.col("title"), F.col("description_text")), listing_summary()).otherwise(F.coalesce(filled, "title")))
    unstated = (wt == "remote") & ~body.rlike("(?i)remote|work from home|telecommut|wfh")
    body = F.when(unstated, F.concat(F.lit("<p>This role is listed as fully remote by the source.</p>"), body)).otherwise(body)
    rows = rows.withColumns({"_place": places.postal_address(F.col("location_raw")), "_countries": places.applicant_countries(F.col("location_raw"))})
    on_site = F.col("_place").isNotNull() & (wt != "remote")
    remote = ~on_site & (wt != "onsite")
    country = lambda name: F.struct(F.lit("Country").alias("@type"), name.alias("name"))
    named = F.when(F.size("_countries") > 0, F.transform("_countries", lambda c: country(places.export_country(c)))).otherwise(F.array(country(F.lit("Worldwide"))))
    address = F.struct(
        F.lit("PostalAddress").alias("@type"), F.col("_place.country").alias("addressCountry"),
        F.col("_place.locality").alias("addressLocality"), F.col("_place.region").alias("addressRegion"))
    optional = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    skills = F.array_join(F.slice(F.filter(F.transform(F.concat("skills", "tech_tags"), lambda s: F.trim(s)), lambda s: s != ""), 1, 24), ", ")
    document = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), "title", body.alias("description"),
        iso(anchor).alias("datePosted"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company_name").alias("name"),
                 F.coalesce(optional("company_url"), optional("career_page_url")).alias("sameAs"), optional("company_url").alias("url")).alias("hiringOrganization"),
        F.struct(F.lit("PropertyValue").alias("@type"), F.col("company_name").alias("name"),
                 F.coalesce(blank_to_null(F.col("external_id")), F.col("id").cast("string")).alias("value")).alias("identifier"),
        F.concat(F.lit(base_url + "/jobs/"), F.col("id").cast("string")).alias("url"), F.lit("en").alias("inLanguage"),
        enrich.employment_enum(F.col("employment_type"), F.col("career_stage")).alias("employmentType"),
        iso(times.valid_through(anchor, days)).alias("validThrough"),
        F.when(remote, "TELECOMMUTE").alias("jobLocationType"), F.when(remote, named).alias("applicantLocationRequirements"),
        F.when(on_site, F.struct(F.lit("Place").alias("@type"), address.alias("address"))).alias("jobLocation"),
        F.when(F.col("years_required_min").isNotNull(), F.struct(
            F.lit("OccupationalExperienceRequirements").alias("@type"), (F.col("years_required_min") * 12).alias("monthsOfExperience"))).alias("experienceRequirements"),
        blank_to_null(skills).alias("skills"), F.lit(False).alias("directApply"),
    )
    return rows.select("id", F.to_json(document).alias("document"))


def write_documents(exported: DataFrame, path: str) -> None:
    exported.select("document").write.mode("errorifexists").text(path)


