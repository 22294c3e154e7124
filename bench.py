"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads (8).
Every query is computed to its last column with the ``noop`` sink, which no optimizer can prune.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from panelcast.plans.catalog import queries  # noqa: E402
from panelcast.session import build_session  # noqa: E402

HEADLINE = (
    "panel_base",
    "complete_series",
    "wide_join",
    "feature_frame",
    "ewm_country_only",
    "rank_product",
    "leaderboard",
    "scored_wide",
    "hw_grid_best",
    "hw_lsq",
    "backtest_hw",
    "arima_grid_best",
    "rf_forecast",
    "gbm_forecast",
    "mlp_forecast",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("panelcast-bench", cpus=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["panel_base"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
