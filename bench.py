"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Every query runs to completion into a no-op sink, after one small warm-up.
``ms_per_line`` relates full-table scan time to the number of source lines,
per layer configuration.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "document_risk", "regex_matches", "matches_by_rule", "scan_documents", "reported_findings",
    "ablation_metrics", "change_gate", "legacy_scan", "entropy_scores", "suppressed_findings",
    "classified_groups", "transition_entropy", "string_literals", "urls", "context_similarity",
    "patch_added_lines", "first_exposures", "findings_by_commit", "stream_scan",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    start = time.perf_counter()
    run(make())
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from credscan.operators.risk import CONFIGURATIONS
    from credscan.operators.scan import scan
    from credscan.plans.corpus import sources
    from credscan.plans.queries import QUERIES

    chosen = sys.argv[1:] or HEADLINE
    run(QUERIES["regex_matches"](spark, SF_DIR))
    seconds = {name: timed(lambda q=QUERIES[name]: q(spark, SF_DIR)) for name in chosen}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(m.group(1)) if (m := re.search(r"sf([0-9.]+)", SF_DIR)) else None,
    }
    if not sys.argv[1:]:
        files = sources(spark, SF_DIR)
        lines = QUERIES["explode_lines"](spark, SF_DIR).count()
        result["lines"] = lines
        result["ms_per_line"] = {
            name: round(1000 * timed(lambda x=layers: scan(files, layers=x)) / lines, 5)
            for name, layers in CONFIGURATIONS
        }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
