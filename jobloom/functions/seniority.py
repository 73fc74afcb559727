"""Career stage, required years and junior eligibility."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom import lexicons as lx
from jobloom.functions.text import blank_to_null, has_any, strip, text

# The words that may lead the number take no part in what is found, and a look at one letter is cheaper than at a word boundary.
YEARS_STATED = lx.YEARS_PATTERN.replace(r"\b(?:(?:minimum|min(?:imum)?\.?|at least|over|more than)\s+)?", r"(?=\d)\b")
ZERO_STATED = lx.ZERO_YEARS.replace(r"\b", r"(?=[0nl])\b", 1)

def _whole(title: Column, description: Column, sep: str) -> Column:
    return F.concat(text(title), F.lit(sep), text(description))


def level_stage(source_level: Column) -> Column:
    low = F.lower(text(source_level))
    stage = F.lit(None).cast("string")
    for needles, name in reversed(lx.SOURCE_LEVELS):
        stage = F.when(has_any(low, needles), F.lit(name)).otherwise(stage)
    return stage


def career_stage(title: Column, description: Column, source_level: Column, employment: Column) -> Column:
    """Title first; the body only ever reveals an internship."""
    t = text(title)
    hint = F.coalesce(level_stage(source_level), F.lit(""))
    return (
        F.when(t.rlike(lx.INTERN_TITLE) | F.lower(text(employment)).contains("intern"), "internship")
        .when(hint == "internship", "internship")
        .when(t.rlike(lx.SENIOR_TITLE), "senior")
        .when(t.rlike(lx.NEW_GRAD_TITLE) | (hint == "new_grad"), "new_grad")
        .when(t.rlike(lx.JUNIOR_TITLE) | (hint == "junior"), "junior")
        .when(t.rlike(lx.MID_TITLE) | (hint == "mid"), "mid")
        .when(hint == "senior", "senior")
        .when(_whole(t, description, " ").rlike(lx.INTERN_TITLE), "internship")
        .otherwise("unknown")
    )


def years_required_min(title: Column, description: Column, ceiling: int = 15) -> Column:
    """Smallest lower bound named in the posting."""
    blob = _whole(title, description, "\n")
    bounds = F.transform(
        F.regexp_extract_all(blob, F.lit(YEARS_STATED), F.lit(1)), lambda y: y.try_cast("int")
    )
    low = F.array_min(F.filter(bounds, lambda y: y <= ceiling))
    return F.when(blob.rlike(ZERO_STATED), F.lit(0)).otherwise(low)


def _snippet(blob: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(blob, pattern, 0))


def seniority_signals(title: Column, description: Column, source_level: Column) -> Column:
    blob = _whole(title, description, "\n")
    flag = lambda p: F.when(blob.rlike(p), F.lit(True))
    return F.struct(
        blank_to_null(source_level).alias("source_level"),
        flag(lx.NO_SPONSOR).alias("no_sponsorship"),
        _snippet(blob, lx.NO_SPONSOR).alias("no_sponsorship_snippet"),
        flag(lx.DEGREE).alias("degree_required"),
        _snippet(blob, lx.DEGREE).alias("degree_snippet"),
        flag(lx.UNPAID).alias("unpaid"),
        _snippet(blob, lx.UNPAID).alias("unpaid_snippet"),
        flag(lx.EQUIVALENT).alias("equivalent_ok"),
        _snippet(blob, lx.EQUIVALENT).alias("equivalent_snippet"),
    )


def junior_eligible(stage: Column, years: Column, title: Column) -> Column:
    s = F.lower(F.coalesce(stage, F.lit("unknown")))
    young = s.isin(lx.ELIGIBLE_STAGES)
    return (
        F.when(s.isin(lx.SENIOR_STAGES) | F.coalesce(years >= 3, F.lit(False)), False)
        .when(text(title).rlike(lx.SENIOR_TITLE) & ~young, False)
        .when(young, True)
        .otherwise(s == "unknown")
    )


def classify(
    df: DataFrame, title="title", description="description_text", source_level="source_level",
    employment="employment_type",
) -> DataFrame:
    """Add stage, years, eligibility and signals; interns get an employment type."""
    t, d, lvl, emp = (F.col(c) for c in (title, description, source_level, employment))
    df = df.withColumns({
        "career_stage": career_stage(t, d, lvl, emp),
        "years_required_min": years_required_min(t, d),
        "seniority_signals": seniority_signals(t, d, lvl),
    })
    stage, years = F.col("career_stage"), F.col("years_required_min")
    clash = stage.isin("junior", "new_grad") & F.coalesce(years >= 4, F.lit(False))
    eligible = junior_eligible(stage, years, t) & ~clash
    note = F.concat(F.lit("Title looks "), stage, F.lit(" but JD asks "), years.cast("string"), F.lit("+ years"))
    signals = (
        F.col("seniority_signals")
        .withField("title_jd_contradiction", F.when(clash, F.lit(True)))
        .withField("contradiction", F.when(clash, note))
        .withField("junior_eligible", eligible)
    )
    return df.withColumns({
        "junior_eligible": eligible,
        "seniority_signals": signals,
        employment: F.when((stage == "internship") & (F.length(text(emp)) == 0), F.lit("internship")).otherwise(emp),
    })


def excluded_for_level(stage: Column, years: Column, eligible: Column, level: Column) -> Column:
    """Senior or 3+ year rows, for a reader at a junior level."""
    s = F.lower(F.coalesce(blank_to_null(stage), F.lit("unknown")))
    senior = s.isin(lx.SENIOR_STAGES) | F.coalesce(years >= 3, F.lit(False))
    barred = ~F.coalesce(eligible, F.lit(True)) & ~s.isin(lx.ELIGIBLE_STAGES)
    return F.lower(text(level)).isin(lx.JUNIOR_LEVELS) & (senior | barred)


def stage_rule(stage: str | None, eligible: bool = False):
    """(use the eligible set, exact stage) for a requested stage."""
    s = (stage or "").strip().lower().replace(" ", "_")
    if s in ("internship", "intern"):
        return False, "internship"
    if eligible or s in lx.ELIGIBLE_ALIASES:
        return True, None
    if s in ("new_grad", "new-grad", "newgrad"):
        return False, "new_grad"
    return False, s or None


def stage_matches(wanted: Column, wanted_eligible: Column, stage: Column, eligible: Column) -> Column:
    """The same rule when each row carries its own request."""
    return asked_stage_matches(asked_stage(wanted), wanted_eligible, stage, eligible)


def asked_stage(wanted: Column) -> Column:
    """A wanted stage as the rule reads it; to be made once per request, not per pair."""
    return F.replace(F.lower(strip(text(wanted))), F.lit(" "), F.lit("_"))


def asked_stage_matches(s: Column, wanted_eligible: Column, stage: Column, eligible: Column) -> Column:
    """``stage_matches`` for what ``asked_stage`` gave."""
    return (
        F.when(s.isin("internship", "intern"), stage == "internship")
        .when(F.coalesce(wanted_eligible, F.lit(False)) | s.isin(lx.ELIGIBLE_ALIASES), eligible)
        .when(s.isin("new_grad", "new-grad", "newgrad"), stage == "new_grad")
        .when(s != "", stage == s)
        .otherwise(F.lit(True))
    )
