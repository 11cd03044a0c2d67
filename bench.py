"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1)   BENCH_CPUS (default 8)   BENCH_QUERIES (comma list, optional)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossier.plans.catalog_index import QUERIES
from dossier.session import build_session

HEADLINE = [
    "o31_build_signals", "o43_text_stats", "o46_analyze_document", "o49_fixed_256", "o50_hierarchical",
    "o52_sentence_windows", "o53_chunk_by_strategy", "o35_plantuml_parts", "o17_edge_merge", "o57_node_dedup",
    "o59_strengthens", "o62_graph_edges", "o63_signal_totals", "o65_embed_text", "o68_top_k", "o70_weighted_top_k",
    "o76_hybrid_merge", "o77_dedup", "o78_strategy_dispatch", "o81_cache_lookup", "o84_cache_insert", "o92_feedback",
    "o96_replay", "o97_skill_neighbourhood", "o98_pattern_evidence", "o100_person_summary", "o107_evidence_blocks",
    "o117_pair_pressure", "o119_latency_stats", "o126_running_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # One small pass through the JVM and the Python workers, so that the first query is not charged for start-up.
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": float(sf.group(1)) if sf else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
