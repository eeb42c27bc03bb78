"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from watchloom.plans import catalog
from watchloom.session import local_session

HEADLINE = [
    "rule_scan", "sliding_count", "cooldown", "threshold_alerts", "monotonic", "telemetry_features", "ewma_rows",
    "traffic_ddos_volumetric", "traffic_c2_signatures", "extract_ips", "extract_urls", "ioc_match_all", "ioc_user_agent",
    "fim_diff", "fim_alerts", "process_diff", "connection_diff", "linux_auth", "parse_process", "dga", "payload_entropy",
    "sigma_match", "correlate_device", "correlate_global", "plan_actions", "blocklist", "fleet", "fleet_summary",
    "beacon_score", "observe", "hunt_where", "hunt_stats", "system_stats", "report_rollup", "top_threats", "format_cef",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    catalog.load_all()
    spark = local_session(cores, partitions=cores)
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        # The first run of a query also loads classes and compiles its stages.
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name:28} first {taken[0]:7.2f} s, then {times[name]:7.2f} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
