"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_table_lineitem", "profile_table_documents", "rank_quantiles", "sample_profile_part", "relationship_overlap_full", "relationship_overlap_pairs",
    "content_hash", "table_digest", "schema_overview", "table_capacity", "bi_relevance", "structural_drift", "evidence_diff", "run_drift", "hypothesis_ledger",
    "stored_objects", "impact", "clusters", "dependency_levels", "budgeted_selection", "metric_query", "disclosure_documents", "sql_audit",
    "collect_oracle_structure_columns", "collect_mssql_structure_constraints", "stream_run_drift",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from estatelens.plans import all_queries
    from estatelens.session import build_session
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(os.path.join(sf, "nation.parquet")).count()  # start the executors before the clock
    times = {}
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
