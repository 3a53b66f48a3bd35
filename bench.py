"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from burstlens import plans
from burstlens.session import build_session

HEADLINE = (
    "best_detection",
    "eyes_retained",
    "crop_moments",
    "image_summary",
    "photo_summary",
    "coverage_summary",
    "stack_rank",
    "score_batch",
    "group_split",
    "prepare_coco",
    "convert_end_to_end",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "burstlens-bench",
        master=f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false",
        spark_driver_memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = plans.queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # session start is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
