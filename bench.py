"""Times the headline queries and prints one JSON line.

Each query runs once to warm up on the small tables and once for the clock on
``$BENCH_SF_DIR``; every row and column is produced, into a no-op sink.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobloom.queries import catalog  # noqa: E402
from jobloom.runtime import local_session  # noqa: E402

HEADLINES = [
    "fresh_sources", "extract_skills", "classify", "canonical_apply_url", "markup_text", "canonical_description",
    "batch_dedupe", "suppress_duplicates", "upsert", "housekeeping", "inventory", "source_health", "title_suggestions",
    "skill_landings", "country_landings", "build_index", "match_queries", "ranked_search", "vector_topk", "hybrid_search",
    "fit_total", "recommend", "saved_search_alerts", "followups", "throttle", "merge_sections", "integrity_audit", "normalize_feed",
]


def produce(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    produce(catalog.QUERIES["fresh_sources"](spark, warm if os.path.isdir(warm) else sf))
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        start = time.perf_counter()
        produce(catalog.QUERIES[name](spark, sf))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
