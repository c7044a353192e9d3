"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import importlib
import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_found", "p9_found", "p1_guides",
    "seq_motif_scan", "seq_guides", "seq_long_scan", "near_pairs", "near_own", "near_search", "near_scores", "ots_reaggregate", "range_inner", "region_subtract", "gene_metagene", "rank_top", "track_lists", "track_rows",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/bench-warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    took: dict[str, float] = {}
    for name in [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in queries]:
        began = time.perf_counter()
        queries[name](spark, folder).write.mode("overwrite").format("noop").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
