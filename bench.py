"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tracefold.operators.conformance import Model
from tracefold.plans import queries as q
from tracefold.session import build_session
from tracefold.sources.tables import orders_log

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "model_nodes_orders", "model_nodes_users", "model_stats_orders", "ngram_counts", "strict_replay", "strict_replay_arrival", "complete_match",
    "match_in_hops", "match_any_order", "late_flags", "replay_size", "ewma_multiplier", "inject_disorder", "summary_setting",
    "conformance_none", "conformance_ngrams", "conformance_greedy", "conformance_non_adaptive", "conformance_unaware",
    "conformance_user_days", "best_leaf_search", "experiment_orders",
]


def main() -> None:
    spark = build_session("bench", cores=CPUS, shuffle=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").count()  # start the executors
    seconds = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # the model as a task gets it, from the tables to the broadcast
    timed("build_model_orders", lambda: Model(orders_log(spark, SF_DIR)).ship(True))
    for name in HEADLINE:
        timed(name, lambda name=name: q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    events = orders_log(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "events_per_sec": {k: round(events / seconds[k]) for k in seconds if k.startswith("conformance_") and k != "conformance_user_days"},
            }
        )
    )


if __name__ == "__main__":
    main()
