"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from splatlake import queries
from splatlake.session import local_session

HEADLINE = [
    "j1_project_points", "a1_zbuffer_raw", "g11_center_in_mask", "flagship_point_labels", "p1_detection_gates", "j7_nms",
    "j8_drop_generic", "j9_drop_conflicts", "p3_mask_gates", "w5_area_jumps", "w6_label_states", "u3_union_runs", "m1_dilate",
    "a9_mask_iou", "c2_dbscan", "a27_object_boxes", "j16_room_conflict", "a20_depth_scale", "a24_multiview_support",
    "a30_audit_errors", "a38_calibration",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SPLATLAKE_SHUFFLE", cpus)
    spark = local_session(cpus, "bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    queries.load()
    queries.QUERIES["p1_detection_gates"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
