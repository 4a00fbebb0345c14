"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from foldspark.plans import catalog

HEADLINE = (
    "compose_reducers_by_key", "preduce_reducers_global", "sum_fast", "sum_nan_remove", "lsum", "frequencies", "mode", "group_by_reduce", "group_by_vectors", "mmax_idx", "unique",
    "map_filter_chain", "map_union_sum", "map_intersection", "map_difference", "set_union", "set_xor", "intersect_sets", "sort_nan_last", "argsort", "take_min", "shift_fwd", "partition_by_runs", "partition_all", "pmap_udf", "bloom_semijoin",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    took: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            s = time.perf_counter() - began
            best = s if best is None else min(best, s)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
