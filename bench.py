"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs after one warm-up, default 3).  Each run executes the
whole plan with the ``noop`` sink (no collect to the driver); the reported
time per query is the median of the timed runs, ``value`` their sum.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# SURVEY 6 headline set: load path, best lot, state hours, FIFO pegging, plus
# the dedup and running-value workhorses.  The multi-start allocation (E6) is
# not in the set: its rounds take minutes at sf0.1 (see README).
HEADLINE = {
    "load_path": "c8_load_lines_report",
    "dedup_lifetime": "b3_dedup_lifetime",
    "best_lot": "d4_best_lot",
    "rank_lots": "d3_rank_lots",
    "state_hours": "f3_load_stat",
    "fifo_pegging": "f14_fifo_pegging",
    "wip_over_time": "f8_wip_over_time",
    "step_move": "f4_step_move",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from lotline.plans.registry import load_all
    from lotline.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    qs = load_all()
    times: dict[str, float] = {}
    for label, name in HEADLINE.items():
        build = qs[name].build
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:                                  # first run is the warm-up
                samples.append(time.perf_counter() - t0)
        times[label] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
