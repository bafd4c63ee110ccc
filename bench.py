"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  data directory, default /root/testdata/sf0.1
    BENCH_CPUS    local cores, default 8
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom import catalog  # noqa: E402
from ledgerloom.catalog import matching_queries as mq  # noqa: E402
from ledgerloom.operators import comparison as cmp  # noqa: E402
from ledgerloom.operators import matching as m  # noqa: E402

HEADLINE = [
    "recon_summary", "recon_status", "run_summary", "discrepancies", "recon_all_banks",
    "bank_attribution", "our_status", "status_counts", "clean_amounts", "column_profile",
    "column_profile_sample", "amount_role", "id_features", "amount_features", "report_sections",
    "report_lines",
]


def million_rows(spark: SparkSession, sf: str):
    """The flagship reconciliation over both sides repeated until the ledger has 1M rows."""
    ours, bank = mq.ours_all(spark, sf), mq.bank_side(spark, sf)
    copies = max(1, -(-1_000_000 // max(ours.count(), 1)))

    def repeat(s):
        numbered = s.withColumn("copies", F.sequence(F.lit(1), F.lit(copies)))
        spread = numbered.withColumn("copy", F.explode("copies")).drop("copies")
        tag = F.concat("id", F.lit("-"), F.col("copy").cast("string"))
        return spread.withColumn("id", tag).withColumn("original", F.coalesce(tag, "original"))

    ours, bank = repeat(ours), repeat(bank)
    ours = m.of_bank(ours, m.target_bank(m.attribute(ours, bank)))
    return cmp.status_summary(m.reconcile_ids(ours, bank))


def timed(query, spark: SparkSession, sf: str) -> float:
    """Seconds to build and run a query: some look at their input while they are built."""
    start = time.time()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    runs = {name: queries[name] for name in HEADLINE} | {"recon_million_rows": million_rows}
    times = {}
    for name, query in runs.items():
        timed(query, spark, sf)  # warm the JVM
        times[name] = round(timed(query, spark, sf), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
