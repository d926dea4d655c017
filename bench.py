"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b05_render_transcripts", "b06_head_tail_cut", "b14_progress_score", "c01_first_problem", "c05_entry_quality",
    "c12_gate_outcome", "d01_seed_assembly", "d06_paired_deltas", "d07_contrast_pairs", "d10_top_k_neighbours",
    "d13_id_overlap", "d15_near_duplicates", "e02_dimension_means", "e03_pass_rate_by_source", "e04_failure_modes",
    "e10_vote_collapse", "e11_classification", "e13_posterior", "e18_mean_pairwise_distance", "e21_wilson_by_source",
    "e23_mean_difference", "f01_sliding_frontier_share", "f02_learning_slope", "f04_running_counters", "f06_child_priors",
    "g01_first_outcomes", "h01_pooled_texts", "j02_folds", "l02_components", "l04_fan_out", "m01_parse_operations",
    "m02_rule_ledger", "s02_rolling_summary", "c02_surface_novelty", "c03_key_delta", "c04_key_leaks", "d12_other_lineage_neighbours",
    "d20_row_audit", "e15_lineage_statistics", "g08_top_overlaps", "u05_hashed_embedding",
]


def main() -> None:
    from duologue.plans.registry import load_all
    from duologue.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    known = load_all()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the JVM's workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(sorted(took)[len(took) // 2], 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
