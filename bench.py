"""Time the headline queries once each, after a warm-up of the session, and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestra.plans import QUERIES
from attestra.session import build_session

HEADLINE = [
    "search_documents", "bm25_or", "rrf_fusion", "exact_search", "vector_topk", "tokenize", "segment_text", "make_chunks", "html_blocks",
    "page_links", "row_text", "infer_types", "typed_pivot", "find_numbers", "evidence_numbers", "resolve_lines", "resolve_exact", "read_context",
    "agg_filtered", "what_if", "snapshot_diff", "usage_cost", "verify_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
