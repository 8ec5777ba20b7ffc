"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.all import QUERIES  # noqa: E402
from gapfield.session import configured  # noqa: E402

# The folder that executors share; local runs make one of their own.
SHARED = os.environ.get("BENCH_SHARED")

HEADLINE = (
    "tri_attributes", "nearest_triangle", "signed_distance", "candidate_topk", "points_in_radius", "box_overlap_pairs",
    "nearest_triangle_fine", "build_dense", "build_sparse", "build_candidates", "build_candidates_untiled", "build_sparse_boxes", "voxel_hessian", "query_first", "query_second", "query_trilinear", "query_tricubic",
    "cell_table_trilinear", "repeated_tricubic", "query_candidates", "contact_wrench", "body_loads", "evaluate_contacts", "evaluate_measures", "torsion_plane",
    "contact_phases", "crossings", "signal_align", "signal_report", "merged_bodies", "obj_roundtrip", "entity_attrs",
    "field_file_import", "field_source_layouts", "bucketed_second", "sql_closest_point", "stream_phases", "stream_query_candidates",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    builder = (
        configured(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    if SHARED:
        builder = builder.config("spark.checkpoint.dir", SHARED)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for n in names:
        start = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
