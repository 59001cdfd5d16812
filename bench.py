"""Seconds per headline query, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postmill.plans.all_queries import QUERIES  # noqa: E402
from postmill.session import local_session  # noqa: E402

HEADLINE = [
    "duplicate_overview", "agg_market_kpis", "agg_category_level_map", "agg_salary_iqr", "agg_salary_benchmark", "agg_premium_flag",
    "agg_skill_stats", "agg_skill_cooccurrence", "agg_company_summary", "facet_filter", "job_listing_page", "enrichment_batches",
    "upsert_by_key", "checkpoint_latest", "dedup_second_pass", "quality_report", "text_clean_description", "header_parse",
    "salary_repair_v3", "match_vocab_text", "skill_gap_sets", "prefill_extract", "activity_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["topk_values"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
