"""Time the headline queries on one node and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from table_queries import QUERIES  # noqa: E402
from winnow.session import build_session  # noqa: E402

HEADLINES = (
    "flagship_gated_top",
    "P3_weighted_score",
    "P4_rescore",
    "P16_score_batch",
    "G8_apply_gates",
    "A1_funnel_report",
    "A2_failure_modes",
    "A3_strategy_breakdown",
    "A16_rank_intervals",
    "A16_top_presence",
    "W1_cap_per_genus",
    "W6_diverse_top",
    "W7_catalog_rank",
    "J1_enrich_metadata",
    "J2_novelty_gate",
    "J2_novelty_gate_large_known_set",
    "J9_check_geometry",
    "Q1_translate_codons",
    "Q6_kmer_windows",
    "Q7_window_load",
    "Q12_mean_pairwise_identity_documents",
    "Q15_substitution_scan",
    "E1_ortholog_funnel",
    "E2_triaged_ranking",
    "T1_incremental_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name in names.split(",") if names else HEADLINES:
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds), 3)
        print(name, timings[name], [round(s, 2) for s in seconds], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
