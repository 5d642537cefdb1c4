"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and then fully executed into Spark's ``noop`` sink (every
row is computed, nothing is collected).  Prints ONE JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "catalog_quantity_by_unit",     # flagship: parse + aggregate
    "catalog_parsed_features",      # TXT-9 row-wise parse
    "catalog_entry_fields",         # TXT-11..13
    "catalog_unit_normalised",      # TXT-14/15
    "documents_text_stats",         # TXT-2/3 on whole documents
    "documents_tfidf",              # FEA-1 on whole documents
    "model_comparison",             # MET-1..9
    "metrics_by_fold",              # MET-8 + SPL-1
    "ensemble_combinations",        # ENS-*
    "stratified_folds",             # SPL-2 distributed ranks
    "exact_sample",                 # SMP-1
    "catalog_quality_issues",       # DQ-1
    "numeric_drift",                # DRF-1/2
    "latency_summary",              # MET-14
    "service_metrics",              # MET-15
    "monitoring_alerts",            # ALR-1
    "registry_state",               # REG-1
    "embedding_f_regression",       # SEL-1
    "lineitem_log_gate",            # LOG-1
    "batch_inference_submission",   # PRD-2 (fit + score)
    "stream_tumbling_event_stats",  # STR-1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pricefold.plans import QUERIES
    from pricefold.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="pricefold-bench", shuffle_partitions=max(8, cpus),
                      extra={"spark.driver.memory": "16g"})
    # warm-up: JVM start, class loading
    spark.range(1000).selectExpr("sum(id)").collect()
    times, errors = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
