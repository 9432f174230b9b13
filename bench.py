"""Headline queries at one scale factor; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose the data
and the cores. Results are computed in full and discarded by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["slope_percent", "edges_16", "base_cost_16", "base_cost_64", "degree_profile_16", "line_multipliers_b2",
            "total_cost", "lcpa_path_raster", "lcpa_path_lines", "fete_density",
            "cost_distance_wide", "lcpa_path_raster_wide", "fete_density_wide"]


def main() -> None:
    import fixtures.queries
    from fixtures.queries import QUERIES, Inputs
    from wayfield.schema import JobOptions

    # The checks use small tiles, so that test grids have many; a job uses the default.
    fixtures.queries.TILE = JobOptions.tile_size

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(spark, sf_dir)
    n_sources, n_wide = inputs.samples.count(), inputs.wide.samples.count()
    QUERIES["slope_percent"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms the session up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cells": inputs.meta.n_cells, "neighbours": 16,
        "sources": n_sources, "sources_per_sec": round(n_sources / seconds["fete_density"], 2),
        "wide_cells": inputs.wide.meta.n_cells, "wide_sources": n_wide, "wide_sources_per_sec": round(n_wide / seconds["fete_density_wide"], 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
