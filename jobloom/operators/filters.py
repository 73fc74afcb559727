"""Row filters over a listings frame."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import seniority, times
from jobloom.functions.enrich import clean_tags


def age_anchor() -> Column:
    return times.age_anchor(F.col("posted_at"), F.col("first_seen_at"))


def in_window(as_of, days) -> Column:
    """Age test alone, written so that both bounds reach the file scan."""
    cutoff = times.minus_days(as_of, days)
    return (F.col("posted_at") >= cutoff) | (F.col("posted_at").isNull() & (F.col("first_seen_at") >= cutoff))


def fresh(df: DataFrame, as_of, days) -> DataFrame:
    return df.filter(F.col("is_active") & in_window(as_of, days))


def is_stale(as_of, days) -> Column:
    return F.coalesce(age_anchor() < times.minus_days(as_of, days), F.lit(False))


def stale(df: DataFrame, as_of, days) -> DataFrame:
    return df.filter(F.col("is_active") & is_stale(as_of, days))


def facet_filter(df, workplace=None, source=None, city=None, country=None, company=None, employment_type=None) -> DataFrame:
    """Equality on workplace and source, substring on the rest."""
    exact = {"workplace_type": workplace, "source": source}
    for column, value in exact.items():
        if value:
            df = df.filter(F.col(column) == value.lower())
    loose = [("location_raw", city), ("location_raw", country), ("company_name", company), ("employment_type", employment_type)]
    for column, value in loose:
        if value:
            df = df.filter(F.col(column).ilike(f"%{value}%"))
    return df


def stage_filter(df: DataFrame, stage=None, eligible=False) -> DataFrame:
    use_set, exact = seniority.stage_rule(stage, eligible)
    if use_set:
        return df.filter("junior_eligible")
    return df.filter(F.col("career_stage") == exact) if exact else df


def tag_overlap(df: DataFrame, tags) -> DataFrame:
    wanted = [t.strip().lower() for t in tags or [] if t.strip()]
    if not wanted:
        return df
    asked = F.array(*[F.lit(t) for t in wanted])
    return df.filter(F.arrays_overlap("skills", asked) | F.arrays_overlap("tech_tags", asked))


def region_filter(df: DataFrame) -> DataFrame:
    return df.filter("region_friendly")


def exclude_for_level(df: DataFrame, level) -> DataFrame:
    level = level if isinstance(level, Column) else F.lit(level)
    return df.filter(
        ~seniority.excluded_for_level(F.col("career_stage"), F.col("years_required_min"), F.col("junior_eligible"), level)
    )


def embed_candidates(df: DataFrame, provider: str, as_of, days) -> DataFrame:
    """Fresh rows with a link whose vector is missing or from another model."""
    missing = (
        F.col("embedding").isNull() | F.col("embedding_hash").isNull()
        | F.col("embedding_provider").isNull() | (F.col("embedding_provider") != provider)
    )
    return fresh(df, as_of, days).filter(F.col("apply_url").isNotNull() & missing)


def ingest_drop(df: DataFrame, as_of, days) -> DataFrame:
    """Drop rows known to be stale or expired; unknown dates stay."""
    now = times.at(as_of)
    known_old = F.coalesce(F.col("posted_at") < times.minus_days(as_of, days), F.lit(False))
    expired = F.coalesce(F.col("expires_at") < now, F.lit(False)) if "expires_at" in df.columns else F.lit(False)
    return df.filter(~known_old & ~expired)


def has_any_tag(tags) -> Column:
    """True when a stored tag, trimmed and lowered, is one of ``tags``."""
    asked = F.array(*[F.lit(t) for t in tags])
    return F.arrays_overlap(F.concat(clean_tags(F.col("skills")), clean_tags(F.col("tech_tags"))), asked)
