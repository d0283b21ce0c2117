"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores. Each query runs from the raw tables: nothing is shared between queries. One
untimed run of the flagship warms up the JVM. ``full_run`` is the time to write all
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tailward.plans.catalog import QUERIES  # noqa: E402
from tailward.plans.products import Products  # noqa: E402
from tailward.plans.run import write_products  # noqa: E402
from tailward.session import local_session, scratch_path  # noqa: E402

HEADLINE = """
p1_profile p3_align_quality p4_validate p5_dedup_latest f1_to_bars f2_black76_price f3_implied_vol f4_iv_surface
f16_build_features f17_rolling_zscore g1_select_atm g4_build_greeks e1_fuse_events e2_label_bars w1_calibrate
w2_score_levels w7_backtest a3_tau_sweep c3_dual_side c6_robust_grid k3_similar_history k7_kg_edges v2_latest_status
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tailward-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("v2_latest_status")
    timings = {name: run(name) for name in HEADLINE}
    start = time.perf_counter()
    write_products(Products.of_fixture(spark, sf_dir), scratch_path(spark, "full-run"))
    full_run = round(time.perf_counter() - start, 3)
    quotes = QUERIES["p4_validate"](spark, sf_dir).agg({"n_rows": "max"}).first()[0]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "full_run": full_run,
                "clean_quotes": quotes,
                "features_quotes_per_sec": round(quotes / timings["f16_build_features"]),
            }
        )
    )


if __name__ == "__main__":
    main()
