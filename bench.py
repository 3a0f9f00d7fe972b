"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerloom.session import build_session
from ledgerloom.workload import load

HEADLINE = (
    "D1_first_match",
    "D1_first_match_by_rule_set",
    "E6_applied_counts",
    "D4_category_ladder",
    "D6_conversion_chain",
    "E11_remainder_magnitude",
    "G1_duplicate_counter",
    "D7_duplicate_check",
    "A18_footprint_upsert",
    "E14_amount_profile",
    "E18_flagged_rows",
    "A3_delimiter_sniff_documents",
    "A4_csv_records",
    "A7_keyed_rows",
    "E1_date_formats",
    "B20_generated_operations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, _ = load()
    times: dict[str, float] = {}
    known["E6_applied_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
