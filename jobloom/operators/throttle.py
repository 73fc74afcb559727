"""Request limits over an event log: at most N per trailing period."""

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from jobloom.runtime import top_per_key


def per_second(events: DataFrame) -> DataFrame:
    """Events per key and second.

    Combined on the map side, so a key's history is bounded by its time span
    in seconds, however many events it has.
    """
    return events.groupBy("key", F.unix_seconds("ts").alias("sec")).agg(F.count(F.lit(1)).alias("n"))


def trailing_counts(events: DataFrame, limit: int, period: int) -> DataFrame:
    """(key, sec, n, in_period, over): all events count, accepted or not."""
    w = Window.partitionBy("key").orderBy("sec").rangeBetween(-period + 1, 0)
    counted = per_second(events).withColumn("in_period", F.sum("n").over(w))
    return counted.withColumn("over", F.greatest(F.lit(0), F.least("n", F.col("in_period") - limit)))


def accept(seconds, counts, state, limit: int, period: int):
    """Accepted events per second; ``state`` is the (second, n) list carried on."""
    taken = []
    for sec, n in zip(seconds, counts):
        while state and state[0][0] <= sec - period:
            state.pop(0)
        used = sum(m for _, m in state)
        got = min(int(n), max(0, limit - used))
        if got:
            state.append((int(sec), got))
        taken.append(got)
    return taken


def accepted_per_second(events: DataFrame, limit: int, period: int) -> DataFrame:
    """(key, sec, n, accepted) when refused events do not count.

    The rule is sequential in a key, so rows are hash-partitioned by key,
    sorted by Spark (which may spill) and streamed through a window of at
    most ``limit`` entries.  No group is ever held in memory, and the counts
    per second bound the rows of a hot key by its time span.
    """
    rows = per_second(events).repartition("key").sortWithinPartitions("key", "sec")

    def run(batches):
        current, state = None, []
        for pdf in batches:
            taken = []
            for key, sec, n in zip(pdf["key"], pdf["sec"], pdf["n"]):
                if key != current:
                    current, state = key, []
                taken += accept([sec], [n], state, limit, period)
            yield pdf.assign(accepted=pd.Series(taken, index=pdf.index, dtype="int64"))

    return rows.mapInPandas(run, "key long, sec long, n long, accepted long")


def throttle(events: DataFrame, limit: int, period: int) -> DataFrame:
    """Events with ``allowed``; within a second the lowest ids go first."""
    quota = accepted_per_second(events, limit, period).select("key", "sec", "accepted")
    slim = events.select("key", "event_id", "ts", F.unix_seconds("ts").alias("sec"))
    # No second accepts more than ``limit``, so only its first rows matter.
    first = top_per_key(slim, ["key", "sec"], [F.asc("ts"), F.asc("event_id")], limit)
    passed = first.join(quota, ["key", "sec"]).filter("position <= accepted").select("event_id", F.lit(True).alias("allowed"))
    return events.join(passed, "event_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
