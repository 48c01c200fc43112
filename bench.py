"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from lumapanel.plans import all_queries
from lumapanel.session import local_session

HEADLINE = [
    "p01_quality_filter",
    "a01_zonal_stats",
    "a05_raster_audit",
    "a09_land_cover_stats",
    "a15_pixel_slopes",
    "j01_cells_in_polygons",
    "j02_buffer_join",
    "j06_nearest_city",
    "a11_radial_profile",
    "t01_trend_class_rank",
    "t03_bootstrap_ci",
    "t06_trend_diagnostics",
    "t07_breakpoints",
    "t14_correlation_matrix",
    "t17_district_projection",
    "w03_tier_trajectory",
    "j13_town_matching",
    "a18_monthly_profiles",
    "a20_species_classes",
    "a23_density_surface",
    "w09_capped_sample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    queries["p04_box_subset"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
