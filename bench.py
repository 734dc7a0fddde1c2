"""Headline queries at one data directory; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "resource_keys", "privacy_screen", "post_resources", "page_metadata", "library_upsert", "publish_gate", "redirect_merge",
    "tokens", "term_df", "bm25_topk", "captured_links", "message_keywords", "recall_rare", "recall_recent",
    "visit_summary", "search_chains", "most_opened", "wall_order",
]


def main() -> None:
    from linklake.plans.registry import QUERIES
    from linklake.session import build_session, drop_written

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(max(int(cpus), 2)), "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
        drop_written(spark)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
