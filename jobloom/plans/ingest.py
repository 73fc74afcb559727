"""One ingest run: landed payloads to the next catalogue snapshot."""

from pyspark.sql import DataFrame

from jobloom.operators.dedupe import batch_dedupe
from jobloom.operators.lifecycle import housekeeping, upsert
from jobloom.runtime import settle
from jobloom.sources.feeds import normalize_feed
from jobloom.sources.sinks import write_catalogue


def ingest_run(raw: DataFrame, current: DataFrame, out: str, as_of, fresh_days: int, purge_days: int, ok_sources):
    """Normalise, deduplicate, upsert, age and write; returns the counts.

    The snapshot between the upsert and the housekeeping is written to the
    shared folder, so a lost executor re-reads it instead of the feeds.
    """
    batch = batch_dedupe(normalize_feed(raw, as_of, fresh_days)).drop("first_seq", "seq")
    stored = settle(upsert(current, batch, as_of), "upserted")
    kept, seen = housekeeping(stored, ok_sources, as_of, as_of, fresh_days, purge_days)
    write_catalogue(kept, out)
    return seen.get
