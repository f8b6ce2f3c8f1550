"""Headline queries timed at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "body_facts", "entry_names", "search_exact_key", "best_call_per_fdi", "template_key_picker", "hits_grouped_by_fdi",
    "coverage_calendar", "mirror_plan", "newest_call_per_key", "call_outcomes", "case_summaries", "three_way_verdicts",
    "noise_hits_per_rule", "noise_applied", "exact_block_matches", "word_changes", "unique_word_anchors", "html_blocks",
    "normalised_urls", "page_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from logloom.plans import catalogue, registry
    from logloom.session import build_session

    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    # the given files have one row group each
    spark.conf.set(registry.SPREAD_CONF, spark.sparkContext.defaultParallelism)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
