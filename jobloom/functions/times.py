"""Instants, ages and windows.  ``as_of`` is always an argument."""

from pyspark.sql import Column, functions as F

from jobloom.functions.text import strip

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?: ?(?:[Zz]|[+-]\d{2}:?\d{2}))?)?$"
DAY_MICROS = 86_400_000_000


def iso_instant(c: Column) -> Column:
    """ISO text to an instant; text without a zone is UTC; bad text is NULL."""
    t = F.replace(strip(c), F.lit(","), F.lit("."))
    t = F.regexp_replace(t, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    zoned = t.rlike(r"(?:[Zz]|[+-]\d{2}:\d{2})$") & t.rlike(r"[T ]\d{2}:")
    whole_day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    utc = F.when(zoned, t).when(whole_day, F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))
    return F.when(strip(c).rlike(ISO_SHAPE), utc.try_cast("timestamp"))


def epoch_instant(c: Column) -> Column:
    """Epoch seconds, or milliseconds when above 10^12."""
    v = c.try_cast("double")
    return F.timestamp_micros((F.when(v > 1e12, v * 1000).otherwise(v * 1_000_000)).cast("bigint"))


def mail_instant(c: Column) -> Column:
    """Mail-header dates as used by news feeds."""
    t = F.regexp_replace(strip(c), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    t = F.when(t.rlike(r"[+-]\d{4}$"), t).otherwise(F.concat(t, F.lit(" +0000")))
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z"))
    )


def parse_instant(c: Column) -> Column:
    """Any of the shapes above, read from text."""
    numeric = strip(c).rlike(r"^\d+(?:\.\d+)?$")
    return F.when(numeric, epoch_instant(strip(c))).otherwise(F.coalesce(iso_instant(c), mail_instant(c)))


def at(as_of) -> Column:
    """A literal instant from ISO text, a datetime or a Column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp") if not isinstance(as_of, str) else F.lit(as_of + ("" if as_of.endswith("Z") else "Z")).cast("timestamp")


def minus_days(as_of, days) -> Column:
    return F.timestamp_micros(F.unix_micros(at(as_of)) - (F.lit(days) * DAY_MICROS).cast("bigint"))


def plus_days(as_of, days) -> Column:
    return F.timestamp_micros(F.unix_micros(at(as_of)) + (F.lit(days) * DAY_MICROS).cast("bigint"))


def age_anchor(posted: Column, first_seen: Column) -> Column:
    return F.coalesce(posted, first_seen)


def age_days(anchor: Column, as_of) -> Column:
    return F.greatest((F.unix_micros(at(as_of)) - F.unix_micros(anchor)) / F.lit(float(DAY_MICROS)), F.lit(0.0))


def valid_through(anchor: Column, days: int) -> Column:
    return plus_days(anchor, days)


def is_indexable(active: Column, anchor: Column, as_of, days: int) -> Column:
    """Active, and not older than the window plus half a day; unknown age passes."""
    age = age_days(anchor, as_of)
    return F.coalesce(active, F.lit(True)) & F.coalesce(age <= days + 0.5, F.lit(True))


def clamp_window(requested: Column, low: int = 1, high: int = 30, default: int = 7) -> Column:
    """Requested days as an integer inside [low, high]; unreadable is the default."""
    days = F.coalesce(strip(requested.cast("string")).try_cast("int"), F.lit(default))
    return F.greatest(F.lit(low), F.least(F.lit(high), days))
