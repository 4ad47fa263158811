"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose tables and cores; BENCH_QUERIES may name other queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from fathomgraph.plans import catalog
from fathomgraph.session import build_session

HEADLINE = [
    "c6_cooccurrence", "f6_node_table", "f7_pair_table", "g4_degree", "g5_pagerank", "g6_shared_neighbours", "g11_unconnected_pairs",
    "h2_all_solutions", "i10_feature_matrix", "j7_threshold_sweep", "k2_top_pairs", "k6_rank_and_quantile", "k10_category_matrix",
    "b3_clean_full", "c3_concept_ids", "c5_document_frequency", "l7_frequency_table", "m3_candidate_spans", "m8_suppressed_same_label",
    "m9_decoded_relations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["k4_score_bands"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up costs
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
