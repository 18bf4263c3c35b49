"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to completion into a no-op sink, after one untimed warm-up
query that loads the JVM and the scan path.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.registry import load_all  # noqa: E402
from crosspanel.session import drop_tables, local_session  # noqa: E402

WARM_UP = "raw_floor"
HEADLINE = [
    "momentum_screen", "dense_daily_close", "rolling_stats", "percentile_ranks", "leave_one_out", "main_features",
    "second_features", "support_resistance", "family_voltail", "family_peermom", "family_betaidio", "family_downside",
    "family_combined", "peer_tercile", "universe_tercile", "walk_forward_folds", "news_features", "article_parse",
    "daily_rank_ic", "newey_west", "tail_rank_quality", "equal_weight_backtest", "long_short_books", "config_ratios",
    "overfit_probability", "search_word", "category_roll_up", "first_copy",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", partitions=int(cpus) if cpus.isdigit() else 8)
    entries = load_all()
    sink = lambda name: entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
    sink(WARM_UP)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        sink(name)
        times[name] = round(time.perf_counter() - start, 3)
        drop_tables(spark)
    label = os.path.basename(os.path.normpath(sf)).removeprefix("sf")
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(label) if label.replace(".", "", 1).isdigit() else label,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
