"""String helpers, title and role expressions."""

from pyspark.sql import Column, functions as F

from jobloom import lexicons as lx

SPACE = r"[\s\p{Z}]+"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    Catalyst inlines an expression wherever it is used; a one-element array
    binds it instead, which matters for regex and payload lookups.
    """
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def squash(c: Column) -> Column:
    """Trim, and reduce each run of white space to one blank."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_any(c: Column, words) -> Column:
    """True when the text holds any of the words as a plain substring."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def count_hits(c: Column, words) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total


def capitalised(c: Column) -> Column:
    """First letter upper case, underscores as blanks."""
    rest = F.replace(F.substr(c, F.lit(2)), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(c, F.lit(1))), rest)


def fingerprint(title: Column, company: Column, stage: Column) -> Column:
    part = lambda c: F.regexp_replace(strip(F.lower(c)), SPACE, " ")
    known = F.when(F.length(stage) > 0, stage).otherwise(F.lit("unknown"))
    return F.concat_ws("|", part(text(title)), part(text(company)), part(known))


# Letters that fold to ASCII by dropping their accent.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīİŃńŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
FOLD_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiINnNnOoOoRrSsSsSsTtTtUuUuUuZzZzZz"

def ascii_fold(c: Column) -> Column:
    """Drop accents, then anything still outside ASCII."""
    folded = F.translate(c, FOLD_FROM, FOLD_TO)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def slugify(name: Column, default: str = "company") -> Column:
    dashed = F.regexp_replace(F.lower(ascii_fold(text(name))), r"[^a-z0-9]+", "-")
    whole = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(F.length(whole) > 0, whole).otherwise(F.lit(default))


def title_key(title: Column) -> Column:
    """Title without a trailing remote or hybrid note."""
    t = squash(text(title))
    t = F.regexp_replace(t, r"(?i)\s*[-|–—]\s*(remote|hybrid|wfh|work from home).*$", "")
    t = F.regexp_replace(t, r"(?i)\s*\((remote|hybrid)\)\s*$", "")
    return strip(t)


def split_company_role(title: Column) -> Column:
    """``Company: Role`` as a struct; an unsplittable title has an unknown company."""
    t = strip(text(title))
    company = strip(F.regexp_extract(t, r"(?s)^([^:]*):(.*)$", 1))
    role = strip(F.regexp_extract(t, r"(?s)^([^:]*):(.*)$", 2))
    good = (F.length(company) > 0) & (F.length(role) > 0)
    return F.struct(
        F.when(good, company).when(F.length(t) == 0, "").otherwise("Unknown").alias("company"),
        F.when(good, role).otherwise(t).alias("role"),
    )


def looks_technical(title: Column, departments: Column | None = None) -> Column:
    t = F.lower(text(title))
    keep = has_any(t, lx.TECH_TITLE_WORDS)
    if departments is not None:
        in_department = F.exists(
            F.coalesce(departments, F.array().cast("array<string>")),
            lambda d: has_any(F.lower(text(d)), lx.TECH_DEPARTMENT_WORDS),
        )
        keep = keep | (in_department & has_any(t, lx.TECH_DEPARTMENT_TITLES))
    return ~has_any(t, lx.NON_TECH_TITLE_WORDS) & keep


def technical_category(categories: Column) -> Column:
    joined = F.lower(F.array_join(categories, " "))
    return F.coalesce(has_any(joined, lx.TECH_CATEGORY_WORDS), F.lit(False))


def software_role(title: Column, description: Column) -> Column:
    """Title wording decides; otherwise the body must lean to software."""
    t = F.lower(text(title))
    named = has_any(t, lx.SOFTWARE_TITLE_WORDS)
    training = has_any(t, lx.TRAINING_TITLE_WORDS) & has_any(t, lx.TRAINING_FIELD_WORDS)
    body = F.lower(F.concat(text(title), F.lit("\n"), text(description)))
    counts = let(body, lambda b: F.struct(count_hits(b, lx.SOFTWARE_BODY_WORDS).alias("plus"), count_hits(b, lx.PHYSICAL_BODY_WORDS).alias("minus")))
    return named | training | let(counts, lambda n: (n["plus"] > 0) & (n["plus"] >= n["minus"]))


def seniority_badge(stage: Column, eligible: Column) -> Column:
    s = F.lower(F.coalesce(blank_to_null(stage), F.lit("unknown")))
    return F.when(s != "unknown", capitalised(s)).when(eligible, F.lit("Seniority not stated"))


def thin_description(title: Column, description: Column) -> Column:
    body = squash(text(description))
    return (F.length(body) < 60) | (F.lower(body) == F.lower(text(title)))


def clip_with_ellipsis(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)
