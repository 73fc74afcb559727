"""Postal address and applicant countries from free-text locations."""

from pyspark.sql import Column, functions as F

from jobloom import lexicons as lx
from jobloom.functions.enrich import any_of
from jobloom.functions.tags import lookup
from jobloom.functions.text import squash, strip, text

COUNTRY_BY_NAME = {n: iso for iso, names in lx.COUNTRY_NAMES.items() for n in names}
STATE_CODES = sorted(set(lx.US_STATES.values()))
ADDRESS = "struct<country:string,region:string,rest:array<string>>"


def _country(token: Column) -> Column:
    low, up = F.lower(token), F.upper(token)
    named = F.try_element_at(lookup(COUNTRY_BY_NAME), low)
    coded = F.when(up.isin(list(lx.COUNTRY_NAMES)), up).otherwise(named)
    return F.when(F.length(low) > 2, named).when(~up.isin(STATE_CODES), coded)


def _state(token: Column) -> Column:
    up = F.upper(token)
    return F.when(up.isin(STATE_CODES), up).otherwise(F.try_element_at(lookup(lx.US_STATES), F.lower(token)))


def postal_address(location: Column) -> Column:
    """(country, region, locality), read right to left; NULL without a country."""
    flat = squash(text(location))
    flat = strip(F.regexp_replace(flat, r"(?i)^(remote|hybrid|onsite|on-site)[\s,;:/|-]+", ""))
    parts = F.filter(
        F.transform(F.split(flat, r"[,/|]"), lambda p: strip(F.regexp_replace(p, r"\b\d{4,6}\b", ""))),
        lambda p: F.length(p) > 0,
    )
    start = F.from_json(F.lit('{"rest":[]}'), ADDRESS)

    def step(acc, part):
        country, state = _country(part), _state(part)
        takes_country = country.isNotNull() & acc["country"].isNull()
        takes_state = ~takes_country & state.isNotNull() & acc["region"].isNull()
        return F.struct(
            F.when(takes_country, country).when(takes_state & acc["country"].isNull(), "US").otherwise(acc["country"]).alias("country"),
            F.when(takes_state, state).otherwise(acc["region"]).alias("region"),
            F.when(takes_country | takes_state, acc["rest"]).otherwise(F.concat(F.array(part), acc["rest"])).alias("rest"),
        ).cast(ADDRESS)

    got = F.aggregate(F.reverse(parts), start, step)
    place = F.struct(
        got["country"].alias("country"), got["region"].alias("region"),
        F.when(F.size(got["rest"]) > 0, F.array_join(got["rest"], ", ")).alias("locality"),
    )
    vague = (F.length(flat) == 0) | flat.rlike(lx.VAGUE_LOCATION) | squash(text(location)).rlike(lx.VAGUE_LOCATION)
    return F.when(~vague & place["country"].isNotNull(), place)


def applicant_countries(location: Column) -> Column:
    """Codes of every country the text names; short codes are not trusted."""
    low = F.lower(text(location))
    tests = []
    for iso, names in lx.COUNTRY_NAMES.items():
        phrases = [n for n in names if len(n) >= 4 or n in ("usa", "uae")]
        hit = any_of([low.rlike(f"(^|[^a-z]){n}([^a-z]|$)") for n in phrases])
        tests.append(F.when(hit, F.lit(iso)))
    first = F.array_compact(F.array(postal_address(location)["country"]))
    return F.array_distinct(F.concat(first, F.array_compact(F.array(*tests))))


def export_country(iso: Column) -> Column:
    made = {i: lx.COUNTRY_EXPORT_NAMES.get(i, " ".join(w.capitalize() for w in n[0].split())) for i, n in lx.COUNTRY_NAMES.items()}
    return F.coalesce(F.try_element_at(lookup(made), iso), iso)
