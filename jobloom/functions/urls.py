"""Link expressions: normal forms, dedupe keys, usability, board references.

Links are taken apart with the generic URI expression of RFC 3986 rather than
a strict parser, so odd characters give a best effort instead of NULL.
"""

from pyspark.sql import Column, functions as F

from jobloom import lexicons as lx
from jobloom.functions.text import ascii_fold, blank_to_null, strip, text

URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(c: Column, index: int) -> Column:
    return F.regexp_extract(c, URI, index)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def authority(c: Column) -> Column:
    return _part(c, 2)


def host(c: Column) -> Column:
    """Host in lower case, without user info or port."""
    return F.lower(F.regexp_extract(_part(c, 2), r"^(?:.*@)?([^@:]*)(?::\d*)?$", 1))


def path(c: Column) -> Column:
    return _part(c, 3)


def normalize_url(c: Column) -> Column:
    """Drop the fragment when the link has a scheme; empty gives NULL."""
    u = strip(c)
    bare = F.concat(scheme(u), F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*(:[^#]*)", 1))
    clean = F.regexp_replace(bare, r"\?$", "")
    return F.when(F.length(c) > 0, F.when(scheme(u) != "", clean).otherwise(u))


def _form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_apply_url(c: Column, drop_keys=tuple(lx.TRACKING_KEYS)) -> Column:
    """https, bare host, no trailing slash, tracking keys gone, pairs sorted."""
    stripped = strip(c)
    full = F.when(scheme(stripped) != "", stripped).otherwise(F.concat(F.lit("https://"), stripped))
    site = F.regexp_replace(host(full), r"^www\.", "")
    where = F.regexp_replace(path(full), r";[^/]*$", "")
    where = F.when(where == "/", where).otherwise(F.regexp_replace(where, "/$", ""))
    pairs = F.transform(
        F.split(_part(full, 4), "&"),
        lambda kv: F.struct(
            F.try_url_decode(F.substring_index(kv, "=", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(kv, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: (F.length(p["v"]) > 0) & ~F.lower(p["k"]).isin(list(drop_keys)))
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))),
        "&",
    )
    rebuilt = F.concat(
        F.lit("https://"), site, F.when((where == "") | where.startswith("/"), where).otherwise(F.concat(F.lit("/"), where)),
        F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    return F.when(F.length(stripped) > 0, F.when(site != "", rebuilt).otherwise(normalize_url(c)))


def batch_apply_key(c: Column) -> Column:
    """Key used to spot one posting twice inside a batch."""
    return blank_to_null(strip(F.lower(canonical_apply_url(c))))


def catalogue_apply_key(c: Column) -> Column:
    """Coarser key for the stored catalogue: no scheme, no query, no fragment."""
    no_scheme = F.regexp_replace(c, r"(?i)^https?://(www\.)?", "")
    no_query = F.split_part(no_scheme, F.lit("?"), F.lit(1))
    return F.lower(F.regexp_replace(F.regexp_replace(no_query, "/$", ""), "#.*$", ""))


def apply_url_is_usable(c: Column) -> Column:
    u = strip(text(c))
    h = host(u)
    refused = (h == "") | h.isin(lx.API_HOSTS) | (h.startswith("api.") & h.contains("greenhouse"))
    return ~refused & scheme(u).isin("http", "https")


def _title_slug(title: Column) -> Column:
    dashed = F.lower(F.regexp_replace(ascii_fold(text(title)), r"[^a-zA-Z0-9]+", "-"))
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def public_posting_url(board: Column, posting: Column, title: Column) -> Column:
    slug = _title_slug(title)
    suffix = F.when(slug != "", F.concat(F.lit("-"), slug)).otherwise(F.lit(""))
    return F.concat(F.lit("https://jobs.smartrecruiters.com/"), board, F.lit("/"), posting, suffix, F.lit("?oga=true"))


def repair_source_url(source: Column, external_id: Column, title: Column, url: Column) -> Column:
    """Replace a stored API link by the public page it stands for."""
    broken = (source == "smartrecruiters") & F.lower(url).contains("api.smartrecruiters.com/") & external_id.contains(":")
    rebuilt = public_posting_url(
        F.split_part(external_id, F.lit(":"), F.lit(1)), F.split_part(external_id, F.lit(":"), F.lit(2)), title
    )
    return F.when(broken, rebuilt).otherwise(url)


def visible_apply_url(source: Column, external_id: Column, title: Column, url: Column) -> Column:
    """Link shown to a reader: repaired where possible, else never an API link."""
    low = F.lower(url)
    api = F.lit(False)
    for h in lx.API_HOSTS:
        api = api | low.contains(h + "/")
    cut = F.locate(":", external_id)
    public = public_posting_url(
        F.substring_index(external_id, ":", 1), F.substr(external_id, cut + 1), title
    )
    can_repair = (source == "smartrecruiters") & external_id.contains(":")
    return F.when(F.length(url) > 0, F.when(api, F.when(can_repair, public)).otherwise(url))


def destination_label(url: Column) -> Column:
    """Name of the site a link opens; NULL when it has no host."""
    h = F.when(scheme(url) != "", F.regexp_replace(host(url), r"^www\.", ""))
    label = h
    for needle, shown in reversed(lx.DESTINATION_LABELS):
        label = F.when(h.contains(needle), F.lit(shown)).otherwise(label)
    return F.when(h != "", label)


def board_ref(url: Column) -> Column:
    """(ats_type, slug) of the careers board a link belongs to, or NULL."""
    found = []
    for kind, pattern in lx.BOARD_URL_PATTERNS:
        slug = F.regexp_extract(url, pattern, 1)
        good = (slug != "") & ~F.lower(slug).isin(lx.BOARD_SKIP_SLUGS)
        found.append(F.when(good, F.struct(F.lit(kind).alias("ats_type"), slug.alias("ats_slug"))))
    tenant = F.regexp_extract(host(url), r"^([^.]+)\..*myworkdayjobs\.com$", 1)
    site = F.regexp_extract(path(url), r"(?i)^/+en-(?:us|gb)/+([^/]+)", 1)
    found.append(
        F.when(
            (tenant != "") & (site != ""),
            F.struct(F.lit("workday").alias("ats_type"), F.concat_ws("|", host(url), tenant, site).alias("ats_slug")),
        )
    )
    return F.coalesce(*found)


def apply_effort(url: Column, source: Column) -> Column:
    """Minutes to budget for the form, by the first needle found."""
    hay = F.lower(F.concat_ws(" ", authority(text(url)), text(url), text(source)))
    low, high, note = lx.APPLY_EFFORT_DEFAULT
    minutes_low, minutes_high, said = F.lit(low), F.lit(high), F.lit(note)
    for needle, lo, hi, words in reversed(lx.APPLY_EFFORT):
        hit = hay.contains(needle)
        minutes_low = F.when(hit, F.lit(lo)).otherwise(minutes_low)
        minutes_high = F.when(hit, F.lit(hi)).otherwise(minutes_high)
        said = F.when(hit, F.lit(words)).otherwise(said)
    shown = F.coalesce(blank_to_null(F.lower(authority(text(url)))), blank_to_null(source), F.lit("unknown"))
    return F.struct(
        shown.alias("host"), minutes_low.alias("minutes_low"),
        minutes_high.alias("minutes_high"), said.alias("note"),
    )
