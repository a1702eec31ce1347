"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Each query
runs once cold and then ``BENCH_WARM`` times; ``queries`` holds warm medians.
Every result row is produced and discarded by the noop sink.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardledger.operators.benchmark import benchmark_overall, benchmark_summary  # noqa: E402
from wardledger.plans import bindings  # noqa: E402
from wardledger.plans.load_run import compare_layouts  # noqa: E402
from wardledger.plans.queries import ID_RANGE, QUERIES, YEAR  # noqa: E402
from wardledger.session import session  # noqa: E402
from wardledger.sources.staging import native_names, read_external  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM = int(os.environ.get("BENCH_WARM", "3"))

HEADLINES = [
    "flagship_q1",
    "flagship_q2",
    "flagship_q3",
    "flagship_full",
    "flagship_full_by_value",
    "sql_entry_q1",
    "external_q1",
    "external_q2",
    "external_q3",
    "csv_load",
    "staging_roundtrip",
    "analytics_table",
    "analytics_top10",
    "top5_per_year",
    "income_quartiles",
    "total_records",
    "year_distribution",
    "state_distribution",
    "bed_size_categories",
    "financial_summary",
    "top_expense_hospitals",
    "state_analysis",
    "profit_margin",
    "load_reconciliation",
    "dq_report",
    "synthetic_hospitals",
    "query_cost",
    "storage_cost",
    "end_to_end_cost",
    "benchmark_summary",
    "engine_comparison",
    "metrics_long_form",
]


def shuffled_bytes(spark) -> int:
    """Bytes written to shuffles since the session started."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    # Tables that several queries share are written once, and timed once.
    prepared = {
        "load_staging": seconds(lambda: bindings.staging_path(spark, SF_DIR)),
        "write_external": seconds(lambda: bindings.external_files(spark, SF_DIR)),
        "build_analytics": seconds(lambda: bindings.analytics_path(spark, SF_DIR)),
    }
    cold, warm, shuffled = {}, {}, {}
    for name in HEADLINES:
        cold[name] = round(seconds(lambda: run(name)), 4)
        before = shuffled_bytes(spark)
        warm[name] = round(statistics.median(seconds(lambda: run(name)) for _ in range(WARM)), 4)
        shuffled[name] = (shuffled_bytes(spark) - before) // WARM

    external = native_names(read_external(spark, bindings.external_files(spark, SF_DIR)))
    runs = compare_layouts(bindings.staging(spark, SF_DIR), external, YEAR, ID_RANGE, WARM)
    staged = bindings.staging(spark, SF_DIR).count()
    reduction = QUERIES["scan_reduction"](spark, SF_DIR).first().asDict()
    print(
        json.dumps(
            {
                "metric": "sum of warm median query times",
                "value": round(sum(warm.values()), 4),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "shuffled_bytes": shuffled,
                "prepared": {k: round(v, 4) for k, v in prepared.items()},
                "rows_per_sec": {
                    name: round(staged / warm[name])
                    for name in HEADLINES
                    if name.startswith(("flagship", "external"))
                },
                "scan_reduction": reduction,
                "native_vs_external": [r.asDict() for r in benchmark_summary(runs).collect()],
                "native_vs_external_overall": benchmark_overall(runs).first().asDict(),
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
