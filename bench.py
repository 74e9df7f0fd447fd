"""Headline queries on one folder; prints one JSON line with the seconds per query.

Each query is written to the no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from listing_radar.queries import queries  # noqa: E402
from listing_radar.session import build_session  # noqa: E402

HEADLINE = [
    "normalize_text", "normalize_url", "price_range", "gazetteer_match_words", "match_items", "upsert_candidates", "state_diff",
    "changed_by_municipality", "deduplicate_merge", "run_counters", "source_health", "coverage_snapshot", "triage_score", "audit_summary",
    "validate_promotions", "spread_coincident_points", "explore_prices", "validate_proposals", "apply_accepted_enrichment",
    "budget_admission", "reachable_pages", "html_titles", "extract_promotions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    every, seconds = queries(), {}
    for name in HEADLINE:
        start = time.time()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
