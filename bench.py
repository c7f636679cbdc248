"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores, and
BENCH_RUNS the timed runs per query after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from ledgerflow.plans import registry
from ledgerflow.session import build_session

HEADLINE = (
    "gold_invoice_summary", "silver_merge", "latest_state", "overdue_total", "chunk_documents", "ocr_documents",
    "retrieve_lexical", "retrieve_vector", "retrieve_hybrid", "answer_questions", "slo_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            # The tables are single files.
            "spark.ledgerflow.input.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, timings = registry.queries(), {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(spent[1:]), 3)
    spark.stop()
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
