"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = ["tile_selection", "sheets_over_areas", "coord_validation", "nearest_named", "scene_choice", "fill_int", "flow_accumulation", "main_channel", "raster_mosaic", "duplicate_content"]


def main() -> None:
    from talweg.plans.queries import QUERIES
    from talweg.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    spark.range(10).count()
    took = {}
    for name in HEADLINES:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
