"""Times the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (names) may be set."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "U2_poi_mix_per_cell",
    "A01_merge_extracts_newest_version",
    "A04_extract_ways_within_outline",
    "A09_hierarchical_network",
    "B09_poi_class",
    "B15_link_defaults",
    "B16_link_type_rules",
    "D01_point_within_box",
    "D04_largest_overlap",
    "D06_distance_pairs_5_km",
    "D07_three_nearest",
    "D08_not_dominated_10_km",
    "D14_cells_along_ways",
    "E01_zonal_sum",
    "E02_population_within_4_km",
    "E04_poi_counts_per_cell",
    "I08_focal_maximum",
    "I10_kernel_density_of_pois",
    "I02_to_I06_population_chain",
    "J01_grid_levels_with_population",
    "K03_place_clusters",
    "K08_tier_allocation",
    "L02_duplicate_pois",
    "L03_intensity_peaks",
    "L05_level_4_centralities",
    "Z03_tier_competition",
    "N03_match_brackets",
    "N05_split_ways",
    "N09_main_classes",
    "N10_ramp_components",
    "N12_node_types",
    "N14_access_node_clusters",
    "N16_restructure_link_types",
    "O02_natural_neighbour_edges",
    "O07_level_links",
)


def main() -> None:
    from wayfold.plans import catalog
    from wayfold.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else list(HEADLINES)
    catalog.load()
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and read the footers before the first timing.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}
    for name in names:
        started = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total headline query time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
