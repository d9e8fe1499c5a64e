"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

BENCH_QUERIES takes query names, separated by commas, or `all`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


# model fits that repeat what the other model queries already time
LONG = (
    "m6_forests m7_boosted m8_neural m9_search m11_stacking m14_batch_scoring m16_permutation "
    "s14_bundle s11_stream_daily t4_direct_forecast t4_pooled_forecast t7_forecast_run t8_model_comparison train_select"
).split()


def main() -> None:
    import catalog
    from chronopanel.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name, fn in catalog.QUERIES.items():
        if "all" not in only and (name not in only if only else name in LONG):
            continue
        start = time.time()
        try:
            # the noop sink runs the whole query without bringing rows to the driver
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        spark.catalog.clearCache()
    out = {
        "metric": "total query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf.rstrip("/").split("sf")[-1],
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
