"""Tag spelling, alias expansion and the split into tools and capabilities."""

from pyspark.sql import Column, functions as F

from jobloom import lexicons as lx
from jobloom.functions.enrich import NO_TAGS, any_of
from jobloom.functions.text import has_any, let, squash, text


def lookup(table: dict) -> Column:
    """A literal map; values may be text or lists of text."""
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
    return F.create_map(*[c for k, v in table.items() for c in (F.lit(k), lit(v))])


def normalize_tag(tag: Column) -> Column:
    clean = F.regexp_replace(F.lower(squash(text(tag))), r"^[ ,;|/·•]+|[ ,;|/·•]+$", "")
    return let(clean, lambda s: F.coalesce(F.try_element_at(lookup(lx.TAG_CANONICAL), s), s))


def alias_table() -> dict:
    """Every spelling -> all spellings of the tags it may stand for."""
    table = {}
    for tag, spellings in lx.SKILL_ALIASES.items():
        for name in [tag, *spellings]:
            table.setdefault(name, set()).update([tag, *spellings])
    return {name: sorted(group) for name, group in table.items()}


def expand_aliases(tags: Column) -> Column:
    """Normalised tags plus every spelling they may stand for, sorted."""
    names = F.transform(F.coalesce(tags, F.array().cast(NO_TAGS)), normalize_tag)
    known = F.filter(names, lambda t: F.length(t) > 0)
    empty = F.array().cast(NO_TAGS)
    grown = F.flatten(
        F.transform(known, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(lookup(alias_table()), t), empty)))
    )
    return F.array_sort(F.array_distinct(grown))


def looks_like_tool(t: Column) -> Column:
    """For a tag that is already normalised."""
    vetoed = has_any(t, lx.TOOL_FRAGMENTS) & has_any(t, lx.TOOL_VETO_FRAGMENTS)
    one_word = t.rlike(r"^[a-z][a-z0-9+.#-]{0,32}$")
    return (
        F.when(F.length(t) < 2, False)
        .when(t.isin(lx.KNOWN_TOOLS), True)
        .when(t.isin(lx.KNOWN_CAPABILITIES) | vetoed, False)
        .when(one_word, ~t.isin(lx.SOFT_SINGLE_WORDS))
        .otherwise(t.rlike(r" (?:api|sdk|cli)$"))
    )


def looks_like_capability(t: Column) -> Column:
    """For a tag that is already normalised."""
    return (
        F.when(t.isin(lx.KNOWN_CAPABILITIES), True)
        .when(t.isin(lx.KNOWN_TOOLS), False)
        .otherwise(has_any(t, lx.CAPABILITY_FRAGMENTS))
    )


def capability_buckets(tools: Column) -> Column:
    """Broad capabilities implied by a tool list."""
    overlaps = lambda names: F.arrays_overlap(tools, F.array(*[F.lit(n) for n in names]))
    both = any_of([F.array_contains(tools, a) & F.array_contains(tools, b) for a, b in lx.BUCKET_FULLSTACK_PAIRS])
    modelled = overlaps(lx.BUCKET_AI) | F.exists(tools, lambda t: has_any(t, lx.BUCKET_AI_FRAGMENTS))
    found = F.array_compact(F.array(
        F.when(overlaps(lx.BUCKET_FRONTEND), "frontend development"),
        F.when(overlaps(lx.BUCKET_BACKEND), "backend development"),
        F.when(both, "full-stack development"),
        F.when(overlaps(lx.BUCKET_DEVOPS), "devops"),
        F.when(modelled, "ai application development"),
        F.when(overlaps(lx.BUCKET_DATA), "data modeling"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("software development")))


def partition_tags(*groups: Column) -> Column:
    """Struct of (skills, technologies): each tag lands on exactly one side."""
    empty = F.array().cast(NO_TAGS)
    raw = F.concat(*[F.coalesce(g, empty) for g in groups])
    tags = F.array_distinct(F.filter(F.transform(raw, normalize_tag), lambda t: F.length(t) >= 2))

    def is_tool(t):
        tool, cap = looks_like_tool(t), looks_like_capability(t)
        single = ~t.contains(" ")
        return F.when(tool != cap, tool).otherwise(single)

    def sides(marked):
        side = lambda tool: F.transform(F.filter(marked, lambda m: m["tool"] == tool), lambda m: m["tag"])
        return F.struct(side(False).alias("caps"), side(True).alias("tools"))

    def result(x):
        derived = F.when((F.size(x["caps"]) == 0) & (F.size(x["tools"]) > 0), capability_buckets(x["tools"])).otherwise(x["caps"])
        return F.struct(derived.alias("skills"), x["tools"].alias("technologies"))

    # Every tag is judged once, and the two sides are named more than once.
    return let(let(F.transform(tags, lambda t: F.struct(t.alias("tag"), is_tool(t).alias("tool"))), sides), result)


def _chip_value(raw: Column) -> Column:
    s = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    by_label = {shown.lower(): value for value, shown in lx.CHIP_LABELS.items()}
    return F.coalesce(
        F.try_element_at(lookup(lx.CHIP_ALIASES), s),
        F.when(s.isin(list(lx.CHIP_LABELS)), s),
        F.try_element_at(lookup(by_label), s),
        s,
    )


def _chip_label(value: Column) -> Column:
    word = lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(
        F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))
    )
    made = F.array_join(F.transform(F.split(value, r"[\s._/-]+"), word), " ")
    return F.coalesce(F.try_element_at(lookup(lx.CHIP_LABELS), value), made)


def profile_tools(skills: Column, technologies: Column, limit: int = 16) -> Column:
    """Chips for a profile: technologies first, one per value, labelled."""
    empty = F.array().cast(NO_TAGS)
    raw = F.concat(F.coalesce(technologies, empty), F.coalesce(skills, empty))
    values = F.array_distinct(F.filter(F.transform(raw, _chip_value), lambda v: F.length(v) > 0))
    return F.transform(
        F.slice(values, 1, limit), lambda v: F.struct(_chip_label(v).alias("label"), v.alias("value"))
    )


def onboarding_state(skills, technologies, roles, remote_preference, uploaded_at, skipped_at, completed_at, seeds) -> Column:
    """What a profile still lacks, and how complete it is."""
    empty = F.array().cast(NO_TAGS)
    s, t = F.coalesce(skills, empty), F.coalesce(technologies, empty)
    filled = lambda c: F.length(text(c)) > 0
    has_skills = (F.size(s) > 0) | (F.size(t) > 0)
    has_resume, skipped = filled(uploaded_at), filled(skipped_at)
    has_roles = F.size(F.coalesce(roles, empty)) > 0
    done = filled(completed_at) | skipped | (has_skills & (has_resume | has_roles))
    checks = [has_skills, has_resume | skipped, has_roles | skipped, filled(remote_preference)]
    score = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    seed = F.slice(F.filter(F.coalesce(seeds, empty), lambda x: F.length(x) > 0), 1, 4)
    first = F.slice(F.when(F.size(t) > 0, t).otherwise(s), 1, 2)
    return F.struct(
        has_skills.alias("has_skills"), has_resume.alias("has_resume"), has_roles.alias("has_desired_roles"),
        done.alias("onboarding_complete"), F.when(F.size(seed) > 0, seed).otherwise(first).alias("seed_skills"),
        F.round(100 * score / 4).cast("int").alias("completion_percent"),
    )
