"""Workplace, skills, places and region of a listing."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from jobloom import lexicons as lx
from jobloom.functions.text import has_any, let, strip, text

NO_TAGS = "array<string>"


def workplace_type(location: Column, explicit: Column, description: Column) -> Column:
    """Hybrid before onsite before remote, over everything the source said."""
    some = lambda c: F.when(F.length(c) > 0, c)
    blob = F.lower(F.concat_ws(" ", some(explicit), some(location), some(description)))
    return let(
        blob,
        lambda b: F.when(b.rlike(r"\bhybrid\b"), "hybrid")
        .when(b.rlike(r"\b(on[\s-]?site|in[\s-]?office|office[\s-]?based)\b"), "onsite")
        .when(b.rlike(r"\b(remote|work from home|wfh|distributed|anywhere)\b"), "remote")
        .otherwise("unknown"),
    )


def clean_tags(tags: Column) -> Column:
    """Lower-case trimmed tags without blanks."""
    lowered = F.transform(F.coalesce(tags, F.array().cast(NO_TAGS)), lambda t: F.lower(strip(t)))
    return F.filter(lowered, lambda t: F.length(t) > 0)


def plain_start(pattern: str) -> str:
    """Literal text any match of the pattern must hold, possibly empty."""
    body = re.sub(r"^(?:\\b)+", "", pattern)
    run = re.match(r"(?:(?:\\[+.]|[a-z0-9# ])(?![?*{]))*", body).group(0)
    return "" if "|" in body.split("(")[0] else run.replace("\\", "")


def spellings(pattern: str) -> list[str]:
    """All texts that a pattern of plain and optional letters between word boundaries matches; none where it says more."""
    optional = re.search(r"(?:\(\?:([^()|]*)\)|(\\.|[a-z0-9/ ]))\?", pattern)
    if optional:
        kept = optional[2] or optional[1]
        forms = [spellings(pattern[:optional.start()] + middle + pattern[optional.end():]) for middle in ("", kept)]
        return forms[0] + forms[1] if all(forms) else []
    plain = re.fullmatch(r"\\b((?:\\[^A-Za-z0-9]|[a-z0-9/# ])+)\\b", pattern)
    return [plain[1].replace("\\", "")] if plain else []


def needed_words(pattern: str) -> list[str]:
    """Words one of which stands in any text that the pattern matches; none if that can't be told."""
    found = [re.findall(r"[a-z0-9]+", s) for s in spellings(pattern)]
    return sorted({max(words, key=len) for words in found}) if all(found) else []


def lexicon_words(body: Column, *lexicons: dict) -> Column:
    """Those words that patterns of the lexicons need and the text has, found in one pass over it."""
    wanted = sorted({w for lexicon in lexicons for ps in lexicon.values() for p in ps for w in needed_words(p)})
    whole = text(body)
    for letter in "\u0130\u212a":  # in lower case they have ASCII letters, which would join the words beside them
        whole = F.replace(whole, F.lit(letter), F.lit(" "))
    return F.array_intersect(F.split(F.lower(whole), r"\W+"), F.array(*[F.lit(w) for w in wanted]).cast(NO_TAGS))


def lexicon_hits(body: Column, lexicon: dict, words: Column | None = None) -> Column:
    """Names in the lexicon with at least one pattern found in the text.

    Everything stays inside the JVM and the text is never exploded.  The words
    of the text are looked up at once, and only the patterns whose words it
    has are tried; a substring test goes before those that name no word.
    ``words`` hands on ``lexicon_words`` of this and other lexicons.
    """
    needs = {p: needed_words(p) for ps in lexicon.values() for p in ps}
    words = lexicon_words(body, lexicon) if words is None else words

    def tests(row):
        has = lambda p: any_of([F.array_contains(row["words"], w) for w in needs[p]]) if needs[p] else row["low"].contains(plain_start(p))
        hit = lambda p: has(p) & row["whole"].rlike("(?i)" + p)
        return F.array(*[F.when(any_of([hit(p) for p in ps]), F.lit(name)) for name, ps in lexicon.items()])

    fields = [body.alias("whole"), words.alias("words")]
    if not all(needs.values()):
        fields.append(F.lower(body).alias("low"))
    return F.array_compact(let(F.struct(*fields), tests))


def extract_skills(body: Column, existing: Column | None = None, lexicon: dict | None = None, words: Column | None = None) -> Column:
    hits = lexicon_hits(text(body), lexicon or lx.SKILL_LEXICON, words)
    if existing is not None:
        hits = F.concat(clean_tags(existing), hits)
    return F.array_sort(F.array_distinct(hits))


def listing_blob(title: Column, description: Column, location: Column) -> Column:
    return F.concat(text(title), F.lit("\n"), text(description), F.lit("\n"), text(location))


def detect_city(location: Column, cities=tuple(lx.CITY_LABELS)) -> Column:
    low = F.lower(location)
    label = F.lit(None).cast("string")
    for needle, shown in reversed(cities):
        label = F.when(low.contains(needle), F.lit(shown)).otherwise(label)
    return label


def region_friendly(workplace: Column, location: Column, description: Column, pattern: str = lx.REGION_PATTERN) -> Column:
    blob = F.concat(text(location), F.lit(" "), text(description))
    return (F.coalesce(workplace, F.lit("")) == "remote") & (detect_city(location).isNotNull() | blob.rlike(pattern))


def region_for(name: Column, slug: Column, employers=tuple(lx.REGION_EMPLOYERS)) -> Column:
    key = F.lower(F.concat(text(name), F.lit(" "), text(slug)))
    return F.when(has_any(key, employers), "both").otherwise("global")


def employment_enum(raw: Column, stage: Column) -> Column:
    """Export enums for free-text employment; nothing recognised is OTHER."""
    n = strip(F.regexp_replace(F.lower(text(raw)), "[_-]+", " "))
    tests = [
        (r"\bfull\s*time\b|\bpermanent\b|\bfte\b|\bfulltime\b", "FULL_TIME"),
        (r"\bpart\s*time\b|\bparttime\b", "PART_TIME"),
        (r"\bcontract\b|\bcontractor\b|\bfreelanc", "CONTRACTOR"),
        (r"\btemp(?:orary)?\b", "TEMPORARY"),
        (r"\bintern(?:ship)?\b", "INTERN"),
        (r"\bvolunteer\b", "VOLUNTEER"),
    ]
    named = F.array_compact(F.array(*[F.when(n.rlike(p), F.lit(v)) for p, v in tests]))
    intern = F.lower(text(stage)) == "internship"
    full = F.when(intern & ~F.array_contains(named, "INTERN"), F.array_append(named, F.lit("INTERN"))).otherwise(named)
    return F.when(F.size(full) > 0, full).otherwise(F.array(F.lit("OTHER")))


def embedding_document(title, company, skills, stage, workplace, description) -> Column:
    """Labelled lines describing a listing; empty lines are left out."""
    some = lambda c: F.when(F.length(c) > 0, c)
    listed = F.array_join(F.coalesce(skills, F.array().cast(NO_TAGS)), ", ")
    known = lambda c: F.coalesce(some(c), F.lit("unknown"))
    return F.concat_ws(
        "\n", some(title), some(company), F.concat(F.lit("Skills: "), listed),
        F.concat(F.lit("Stage: "), known(stage)), F.concat(F.lit("Workplace: "), known(workplace)),
        some(description),
    )


def embedding_hash(*parts) -> Column:
    return F.left(F.sha2(embedding_document(*parts), 256), F.lit(40))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)
