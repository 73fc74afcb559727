"""Where a listing came from and how far to trust it."""

from pyspark.sql import Column, functions as F

from jobloom import lexicons as lx


def source_kind(source: Column) -> Column:
    s = F.lower(source)
    return F.when(s.isin(lx.BOARD_SOURCES), "ats").when(s.isin(lx.CURATED_SOURCES), "curated_board").otherwise("aggregator")


def source_rank(source: Column) -> Column:
    kind = source_kind(source)
    return F.when(kind == "ats", 0).when(kind == "curated_board", 1).otherwise(2)


def source_label(source: Column) -> Column:
    kind = source_kind(source)
    label = F.lit(None).cast("string")
    for k, shown in lx.SOURCE_LABELS.items():
        label = F.when(kind == k, F.lit(shown)).otherwise(label)
    return label


def source_preference(source: Column, order=tuple(lx.SOURCE_PREFERENCE)) -> Column:
    """Position in the preference list; unknown sources come last."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), source)
    return F.when(place > 0, place - 1).otherwise(F.lit(1000)).cast("int")
