"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to its last row once to warm up and then BENCH_RUNS times
(default 1); the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from tallymark.plans import queries as _registered  # noqa: F401
from tallymark.plans.registry import QUERIES
from tallymark.session import build_session, clean_up

HEADLINE = [
    "match_exact", "unmatched_ledger", "unmatched_external", "duplicates", "match_fuzzy",
    "balance_rollforward", "eod_match", "key_overlap", "detect_breaks", "recon_run",
    "escalate_stale", "age_and_escalate", "manual_resolve", "auto_resolve", "rule_auto_resolve",
    "list_breaks_newest", "break_history", "run_report", "export_breaks", "report_by_asset",
    "break_alerts", "audit_envelope", "lifecycle_replay", "ledger_from_postings",
    "parse_external_payload", "ingest_dedupe", "dead_letters", "rollforward_opening",
    "balance_snapshots", "amount_mismatch_pairs", "stream_ingest", "stream_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", int(cpus), "bench", {"spark.driver.memory": "16g"})
    timings = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        timings[name] = round(min(spent[1:]), 3)
    clean_up(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
