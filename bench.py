"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
HEADLINE = (
    "agg_01_counts", "agg_04_statistics", "agg_09_summary", "agg_12_service_joins", "gra_04_hotspots", "join_01_hydrate", "join_03_channel_collapse", "join_04_route_match", "join_12_unique_references",
    "dif_01_row_diff", "set_03_bag_difference", "con_01_field_comparison", "top_01_samples", "str_07_tumbling_hours", "trv_01_simple_paths", "trv_07_impact", "trv_09_blast_radius", "fn_02_mask_path", "tf_strings",
)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomgraph.plans import catalog

    known = catalog.queries()
    known["agg_01_counts"](spark, d).collect()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        known[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
