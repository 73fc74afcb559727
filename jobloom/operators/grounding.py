"""Checks of derived documents against the text they were made from."""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobloom import lexicons as lx
from jobloom.functions.enrich import NO_TAGS
from jobloom.functions.tags import lookup
from jobloom.functions.text import has_any, squash, strip, text
from jobloom.operators.ranking import top_per_category
from jobloom.runtime import top_per_key, union_all

BULLET = r"^[•\-*–—]+\s*"


def norm(c: Column) -> Column:
    return squash(F.lower(text(c)))


def metrics(c: Column) -> Column:
    """Figures claimed in a text, normalised, each once."""
    found = F.regexp_extract_all(text(c), F.lit(lx.METRIC_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, norm))


def unsupported_metrics(original: Column, derived: Column) -> Column:
    body = norm(original)
    new = F.array_except(metrics(derived), metrics(original))
    return F.array_sort(F.filter(new, lambda m: ~body.contains(m)))


def phrase_supported(phrase: Column, body: Column) -> Column:
    """Whole phrase present; else all of up to three words, else 85 %.

    ``body`` is already normalised.
    """
    p = norm(phrase)
    words = F.filter(
        F.regexp_extract_all(p, F.lit(r"[a-z0-9+#.]{2,}"), F.lit(0)), lambda t: ~t.isin(lx.PHRASE_STOPWORDS)
    )
    n = F.size(words)
    hits = F.size(F.filter(words, lambda t: body.contains(t)))
    enough = F.when(n <= 3, hits == n).otherwise(hits / n >= 0.85)
    return (p == "") | body.contains(p) | (n == 0) | enough


def line_grounded(line: Column, body: Column, loose: bool = False) -> Column:
    """Share of a line's content words found in the normalised original."""
    words = F.filter(
        F.regexp_extract_all(norm(line), F.lit(r"[a-z0-9+#.]{3,}"), F.lit(0)), lambda t: ~t.isin(lx.LINE_STOPWORDS)
    )
    n = F.size(words)
    hits = F.size(F.filter(words, lambda t: body.contains(t)))
    return (n == 0) | (hits / F.greatest(n, F.lit(1)) >= (0.55 if loose else 0.65))


def ungrounded_lines(pairs: DataFrame, loose: bool = False) -> DataFrame:
    """(doc_id, line_no, line, grounded) for every non-blank derived line."""
    lines = pairs.select("doc_id", norm(F.col("original")).alias("body"), F.posexplode(F.split("derived", "\n")).alias("line_no", "line"))
    kept = lines.filter(F.length(strip(F.col("line"))) > 0)
    return kept.select("doc_id", "line_no", "line", line_grounded(F.col("line"), F.col("body"), loose).alias("grounded"))


def match_panel(original: Column, keywords: Column, found_skills: Column) -> Column:
    """Asked words split into supported and missing; of the latter the first few are also shown apart."""
    body = norm(original)
    asked = F.array_distinct(F.filter(F.transform(F.concat(keywords, found_skills), norm), lambda k: F.length(k) > 0))
    missing = F.filter(asked, lambda k: ~phrase_supported(k, body))
    return F.struct(
        F.filter(asked, lambda k: phrase_supported(k, body)).alias("strong"),
        missing.alias("missing"), F.slice(missing, 1, 8).alias("potential_gaps"),
    )


KEY_TABLE = lx.SECTION_KEY


def section_key(heading: Column) -> Column:
    """Canonical key of a section heading; unknown headings keep their words."""
    h = F.trim(F.regexp_replace(F.lower(text(heading)), r"[^\p{L}\p{Nd}_&+/]+", " "))
    return F.coalesce(F.try_element_at(lookup(KEY_TABLE), h), h)


def integrity_audit(original: DataFrame, final: DataFrame) -> DataFrame:
    """(doc_id, failure) of final documents against their originals.

    Both frames have one row per document entry: doc_id, kind (contact field,
    summary, skills, experience, projects, education or other), heading, body.
    Counts are combined per document before the two sides meet.  A row of kind
    other is a section: two of one key in a final document are a failure, and
    so is every one without a heading.
    """
    single = ["name", "email", "phone", "summary", "skills"]
    many = ["experience", "projects", "education"]

    def counts(df, tag):
        filled = F.length(strip(text(F.col("body")))) > 0
        aggs = [F.count_if((F.col("kind") == k) & filled).alias(f"{tag}_{k}") for k in single + many]
        keys = F.array_sort(F.collect_set(F.when(F.col("kind") == "other", section_key(F.col("heading")))))
        return df.groupBy("doc_id").agg(*aggs, keys.alias(f"{tag}_keys"))

    j = counts(original, "o").join(counts(final, "f"), "doc_id", "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    names = {"name": "missing_name", "email": "missing_contact:email", "phone": "missing_contact:phone", "summary": "missing_summary", "skills": "missing_skills"}
    tests = [F.when((n(f"o_{k}") > 0) & (n(f"f_{k}") == 0), F.lit(names[k])) for k in single]
    tests += [
        F.when(n(f"f_{k}") < n(f"o_{k}"), F.concat(F.lit(f"lost_{k}:"), n(f"o_{k}").cast("string"), F.lit("->"), n(f"f_{k}").cast("string")))
        for k in many
    ]
    empty = F.array().cast(NO_TAGS)
    o_keys, f_keys = F.coalesce("o_keys", empty), F.coalesce("f_keys", empty)
    invented = F.array_contains(f_keys, "references") & ~F.array_contains(o_keys, "references")
    bare = sum((n(f"f_{k}") for k in ["summary", "skills"] + many), F.lit(0)) == 0
    tests += [F.when(invented, "invented_references"), F.when(bare, "empty_document")]
    lost = F.transform(F.array_except(o_keys, f_keys), lambda k: F.concat(F.lit("lost_section:"), k))
    between = j.select("doc_id", F.explode(F.concat(F.array_compact(F.array(*tests)), lost)).alias("failure"))
    other = final.filter(F.col("kind") == "other").select("doc_id", "heading", section_key(F.col("heading")).alias("key"))
    twice = other.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.concat(F.lit("duplicate_section:"), "key").alias("failure"))
    unnamed = other.filter(strip(text(F.col("heading"))) == "").select("doc_id", F.lit("empty_section_heading").alias("failure"))
    return union_all([between, twice, unnamed])


def lost_and_invented_sections(original: DataFrame, final: DataFrame, unnamed: bool = False) -> DataFrame:
    """Section keys on one side only, per document; a blank heading names no section, unless ``unnamed`` ones count as one."""
    keyed = lambda df: df.select("doc_id", section_key(F.col("heading")).alias("section")).filter(F.lit(unnamed) | (F.col("section") != ""))
    keys = lambda df, side: keyed(df).distinct().withColumn(side, F.lit(True))
    both = keys(original, "_a").join(keys(final, "_b"), ["doc_id", "section"], "full_outer")
    change = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "invented")
    return both.withColumn("change", change).filter("change is not null").select("doc_id", "section", "change")


def norm_item(c: Column) -> Column:
    """Lower-case words, one blank between them; bullets and all other signs go."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{Nd}_]+", " "))


def strip_heading_echo(item: Column, heading: Column) -> Column:
    """Item text without a leading ``Heading:``; a bare echo becomes empty."""
    h = squash(text(heading))
    return _without_echo(item, h, section_key(heading), norm_item(item) == norm_item(h))


def _without_echo(item: Column, h: Column, key: Column, same: Column) -> Column:
    """The same, given the squashed heading, its key and whether item and heading are alike."""
    tail = lambda head: F.substr(item, F.length(head) + 1)
    leads = lambda head: (F.lower(F.left(item, F.length(head))) == F.lower(head)) & tail(head).rlike(r"^\s*[:\-–—|]")
    cut = lambda head: strip(F.regexp_replace(tail(head), r"^\s*[:\-–—|]\s*", ""))
    shorter = F.when(leads(h), cut(h)).when(leads(key), cut(key)).otherwise(item)
    echo = same | ((F.size(F.split(item, " ")) <= 3) & (section_key(item) == key))
    return F.when(echo, "").when(shorter != "", shorter).otherwise(item)


def merge_sections(items: DataFrame) -> DataFrame:
    """One row per (doc, section) with its heading as shown and the union of its items, in order.

    ``items`` has doc_id, pos, heading, item.  An unknown section is shown
    under its first heading, in title case.  Bullets and heading echoes are
    dropped.  Of two items of which one contains the other only the longer
    stays, in the earlier one's place.  The fold runs over one section of one
    document, from which exact repeats were removed by an aggregate first.

    Each step is a column of its own: what is named twice is computed once.
    """
    rows = items.select("doc_id", "pos", squash(text(F.col("heading"))).alias("heading"), F.regexp_replace(squash(text(F.col("item"))), BULLET, "").alias("clean"))
    rows = rows.withColumns({"section": section_key(F.col("heading")), "heading_nk": norm_item(F.col("heading")), "clean_nk": norm_item(F.col("clean"))})
    shown = rows.groupBy("doc_id", "section").agg(F.initcap(F.min_by("heading", F.struct("pos", "heading"))).alias("heading"))
    shown = shown.withColumn("heading", F.coalesce(F.try_element_at(lookup(lx.SECTION_DISPLAY), F.col("section")), "heading"))
    rows = rows.withColumn("item", _without_echo(F.col("clean"), F.col("heading"), F.col("section"), F.col("clean_nk") == F.col("heading_nk")))
    rows = rows.withColumn("nk", F.when(F.col("item") == F.col("clean"), F.col("clean_nk")).otherwise(norm_item(F.col("item"))))
    bare = (F.length("item") <= 48) & (F.size(F.split("item", " ")) <= 4) & section_key(F.col("item")).isin(sorted(set(lx.SECTION_KEY.values())))
    # A filter would be pushed down and have every step above computed again.
    kept = F.when((F.length("nk") > 0) & ~bare, F.array(F.struct("item", "nk")))
    rows = rows.select("doc_id", "pos", "section", F.explode(kept).alias("x")).select("doc_id", "pos", "section", "x.item", "x.nk")
    once = rows.groupBy("doc_id", "section", "item", "nk").agg(F.min("pos").alias("pos"))
    lists = once.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "nk", "item"))).alias("xs"))
    merged = lists.select("doc_id", "section", _union_of_items(F.col("xs.nk"), F.col("xs.item")).alias("items"))
    return merged.join(shown, ["doc_id", "section"]).select("doc_id", "section", "heading", "items")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _union_of_items(nks: pd.Series, items: pd.Series) -> pd.Series:
    """Items of one section in order; the first kept one that contains an item, or is contained, is where it goes."""

    def merged(nks, items):
        kept_nk, kept = [], []
        for nk, item in zip(nks, items):
            at = next((i for i, known in enumerate(kept_nk) if nk in known or known in nk), None)
            if at is None:
                kept_nk.append(nk)
                kept.append(item)
            elif len(item) > len(kept[at]):
                kept_nk[at], kept[at] = nk, item
        return kept

    return pd.Series([merged(n, x) for n, x in zip(nks, items)], dtype=object)


def duplicate_section_keys(sections: DataFrame) -> DataFrame:
    """Sections a document has more than once (doc_id, section_no, heading)."""
    keyed = sections.select("doc_id", section_key(F.col("heading")).alias("section"))
    return keyed.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def flattened_documents(docs: DataFrame) -> DataFrame:
    """Texts that seem to have lost their line structure."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), strip), lambda x: F.length(x) > 0)
    headings = F.size(F.filter(lines, lambda x: x.rlike(lx.HEADING_LINE)))
    flat = (F.size(lines) <= 3) | ((headings < 2) & (F.length("text") > 400))
    blank = F.length(strip(F.col("text"))) == 0
    return docs.select("doc_id", F.size(lines).alias("n_lines"), headings.alias("n_headings"), (flat & ~blank).alias("flattened"))


def banned_phrases(docs: DataFrame, phrases=tuple(lx.BANNED_PHRASES)) -> DataFrame:
    """(doc_id, phrase) for every template phrase a document still holds."""
    tests = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in phrases]))
    return docs.select("doc_id", F.explode(tests).alias("phrase"))


def entity_key(c: Column) -> Column:
    # All but a-z, 0-9 and the blank; as a negated class the same takes nine times as long.
    return F.trim(F.regexp_replace(norm(c), r"[\x00-\x1f!-/:-`{-\x{10ffff}]", " "))


def _entry_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: F.length(t) > 2))


def entries_match(a: Column, b: Column, wa: Column | None = None, wb: Column | None = None) -> Column:
    """Equal, contained, or 60 % of the shorter one's words shared; the words may be given."""
    wa, wb = _entry_words(a) if wa is None else wa, _entry_words(b) if wb is None else wb
    smaller = F.least(F.size(wa), F.size(wb))
    share = F.size(F.array_intersect(wa, wb)) / F.greatest(smaller, F.lit(1))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a) | ((smaller > 0) & (share >= 0.6)))


def aligned_entries(base: DataFrame, derived: DataFrame) -> DataFrame:
    """(doc_id, base_pos, derived_pos): each base entry with its rewrite, and what is new.

    Base entries choose in order and no derived entry is used twice; those
    left over that have a label are new (base_pos null).  One aggregate
    brings the entries of a document together; the choice is a walk over
    them, and nothing is joined pair by pair.
    """
    side = lambda df, of: df.select("doc_id", F.lit(of).alias("of"), F.col("pos").cast("bigint").alias("pos"), entity_key(F.col("label")).alias("key"), text(F.col("label")).rlike(r"[^\s\p{Z}]").alias("named"))
    entry = F.struct("pos", "key", "named")
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("of") == name, entry))).alias(name)
    both = union_all([side(base, "b"), side(derived, "d")]).groupBy("doc_id").agg(of("b"), of("d"))
    done = both.select("doc_id", F.col("b.pos").alias("base"), "d", _rewrites(F.col("b.key"), F.col("d.key"), F.col("d.pos")).alias("picked"))
    pair = lambda b, d: F.struct(b.alias("base_pos"), d.alias("derived_pos"))
    chosen = F.zip_with("base", "picked", pair)
    new = F.array_except(F.transform(F.filter("d", lambda d: d["named"]), lambda d: d["pos"]), F.array_compact("picked"))
    added = F.transform(new, lambda d: pair(F.lit(None).cast("bigint"), d))
    return done.select("doc_id", F.explode(F.concat(chosen, added)).alias("o")).select("doc_id", "o.base_pos", "o.derived_pos")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _rewrites(base: pd.Series, derived: pd.Series, places: pd.Series) -> pd.Series:
    """For each base key the place of the first free derived key that ``entries_match`` takes for it; null without one."""
    words = lambda keys: [{w for w in k.split() if len(w) > 2} for k in keys]

    def picks(base, derived, places):
        free, out = [(k, w, p) for k, w, p in zip(derived, words(derived), places) if k], []
        for a, wa in zip(base, words(base)):
            at = None
            for i, (b, wb, _) in enumerate(free if a else ()):
                fewer = min(len(wa), len(wb))
                if a in b or b in a or (fewer and len(wa & wb) / fewer >= 0.6):
                    at = i
                    break
            out.append(None if at is None else int(free.pop(at)[2]))
        return out

    return pd.Series([picks(*row) for row in zip(base, derived, places)], dtype=object)


def category(skill: Column) -> Column:
    """Category of a skill by name, else by a shared fragment."""
    by_name = lx.SKILL_CATEGORY
    part = F.lit(lx.CATEGORY_FALLBACK)
    for name, cat in reversed(list(by_name.items())):
        if len(name) >= 3:
            part = F.when(skill.contains(name) | F.lit(name).contains(skill), F.lit(cat)).otherwise(part)
    return F.coalesce(F.try_element_at(lookup(by_name), skill), part)


def skill_relevance(skill: Column, keywords: Column, job: Column, cat: Column) -> Column:
    """How much a supported skill matters for a posting; ``job`` is normalised."""
    named = F.array_contains(keywords, skill) | job.contains(skill)
    near = F.exists(keywords, lambda k: (F.length(k) >= 3) & (skill.contains(k) | k.contains(skill)))
    words = F.exists(F.split(skill, " "), lambda t: (F.length(t) >= 4) & job.contains(t))
    add = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    return F.lit(0.3) + add(named, 3.0) + add(near, 1.5) + add(words, 0.5) + add(cat.isin(lx.CORE_CATEGORIES), 0.15)


def cased(c: Column) -> Column:
    """Null if a text has no upper-case letter."""
    return F.when(c != F.lower(c), c)


def as_written(skill: Column, original: Column) -> Column:
    """First place of a skill as a whole word in a text, in the text's own letters; null without upper case."""
    pattern = F.concat(F.lit(r"(?i)(?<![\w+#.])\Q"), F.regexp_replace(skill, r"\\E", ""), F.lit(r"\E(?![\w+#.])"))
    return cased(F.regexp_substr(original, pattern))


def skill_groups(docs: DataFrame, max_groups: int = 7, max_per_group: int = 10, max_total: int = 36) -> DataFrame:
    """Supported skills of a document, grouped and ranked for a posting.

    ``docs`` has doc_id, candidates, original, keywords and job_text.  ``items``
    are normalised, ``names`` the same skills as shown: acronyms by table,
    else as the text writes them, else the first candidate with upper case.
    """
    rows = docs.select(
        "doc_id", "original", norm(F.col("original")).alias("body"), F.transform("keywords", norm).alias("keywords"),
        norm(F.col("job_text")).alias("job"), F.posexplode("candidates").alias("pos", "raw"))
    rows = rows.withColumn("skill", norm(F.col("raw"))).filter(F.length("skill") >= 2)
    rows = rows.filter(phrase_supported(F.col("skill"), F.col("body")))
    written = F.coalesce(F.try_element_at(lookup(lx.SKILL_DISPLAY), F.col("skill")), as_written(F.col("skill"), F.col("original")))
    # The texts end here: what they say of a skill goes on as numbers and names.
    relevance = F.round(skill_relevance(F.col("skill"), F.col("keywords"), F.col("job"), category(F.col("skill"))), 4)
    rows = rows.select("doc_id", "pos", squash(text(F.col("raw"))).alias("raw"), "skill", written.alias("written"), relevance.alias("relevance"))
    named = F.coalesce(F.first("written"), F.min_by("raw", F.when(cased(F.col("raw")).isNotNull(), F.col("pos"))), F.min_by("raw", "pos"))
    rows = rows.groupBy("doc_id", "skill").agg(F.min("pos").alias("pos"), named.alias("name"), F.first("relevance").alias("relevance"))
    # One row per skill of a document; a longer variant of a base name wins.
    base = norm(F.regexp_replace("skill", r"\s*[(\[].*$", ""))
    rows = rows.withColumn("base", base).filter(F.length("base") > 0)
    best = rows.groupBy("doc_id", "base").agg(
        F.min("pos").alias("pos"), F.max_by(F.struct("skill", "name", "relevance"), F.struct(F.length("name"), -F.col("pos"))).alias("best"))
    best = best.select("doc_id", "pos", "best.*").withColumn("category", category(F.col("skill")))
    kept = top_per_category(best.select("doc_id", "pos", "skill", "name", "category", "relevance"), max_total, max_per_group)
    grouped = kept.groupBy("doc_id", "category").agg(
        F.array_sort(F.collect_list(F.struct("in_category", "skill", "name"))).alias("in_order"))
    grouped = grouped.select("doc_id", "category", F.col("in_order.skill").alias("items"), F.col("in_order.name").alias("names"))
    order = {c: i for i, c in enumerate(lx.CATEGORY_ORDER)}
    placed = grouped.withColumn("place", F.coalesce(F.try_element_at(lookup(order), F.col("category")), F.lit(50)))
    last = placed.filter(F.col("category") == lx.CATEGORY_FALLBACK)
    named = top_per_key(placed, ["doc_id"], [F.asc("place")], max_groups, "group_no")
    crowded = named.filter(F.col("group_no") == max_groups).select("doc_id")
    # The fallback group takes the last place when the named ones fill all.
    swapped = last.join(crowded, "doc_id", "left_semi").withColumn("group_no", F.lit(max_groups))
    keep = named.join(swapped.select("doc_id", "group_no"), ["doc_id", "group_no"], "left_anti")
    return union_all([keep, swapped]).select("doc_id", "group_no", "category", "items", "names")
