"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.session import local_session  # noqa: E402
from workload.queries import QUERIES, prepare_serving  # noqa: E402

HEADLINE = [
    "entity_ranking", "classified_rows", "status_histogram", "monthly_ranking",
    "category_catalogue", "name_catalogue", "entity_summary", "row_numbers", "latest_facts",
    "run_upsert", "fact_rule_violations", "page_reconciliation", "slugify_docs",
    "json_attributes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, partitions=int(cpus), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    start = time.perf_counter()
    prepare_serving(spark, sf_dir)  # the load that serving queries read, with the JVM's start-up
    load = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "load": load, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
