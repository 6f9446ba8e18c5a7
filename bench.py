"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

``build_*`` entries derive what later queries share (feeds, fact, order rollup,
customer base, scores) and are timed once, cold. Every query is then run twice; the
second, compiled run counts and the first is listed under ``cold``. Results go to
Spark's no-op sink: every row is computed, none is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import all_queries  # noqa: E402
from checks.workspace import workspace  # noqa: E402
from tillroll.operators import marts  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "clean_fact", "dq_change_log", "write_fact", "apply_filters", *marts.REGISTRY,
    "summary", "monthly", "country_rollup", "top_products", "cancellations_monthly",
    "reversal_reasons", "pareto", "concentration", "purchase_gap_days", "repeat_stats",
    "duplicate_counts", "conflicting_duplicates", "word_audit", "before_after",
    "year_over_year", "matched_cancellations",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    shared, seconds, cold = workspace(spark, SF_DIR), {}, {}

    def timed(into: dict, name: str, action) -> None:
        begun = time.perf_counter()
        action()
        into[name] = round(time.perf_counter() - begun, 3)

    timed(seconds, "build_feeds", lambda: shared.raw)
    timed(seconds, "build_fact", lambda: shared.fact)
    timed(seconds, "build_orders", lambda: shared.context.orders)
    timed(seconds, "build_customers", lambda: shared.context.customer_base)
    timed(seconds, "build_rfm", lambda: shared.context.rfm)
    known = all_queries()
    for name in HEADLINE:
        def run(query=known[name]):
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()

        timed(cold, name, run)
        timed(seconds, name, run)
        print(name, cold[name], seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
