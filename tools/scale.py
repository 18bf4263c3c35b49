"""Times feature sets on a made-up panel of the size a real one has, and counts the exchanges of their plans.

    python tools/scale.py [--tickers 2000] [--dates 2500] [--sets v3 voltail ... all]
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from crosspanel.plans import families as FM  # noqa: E402
from crosspanel.plans import indicators as I  # noqa: E402
from crosspanel.plans.featureset import build  # noqa: E402
from crosspanel.session import drop_tables, local_session, materialise  # noqa: E402


def panel(spark, tickers: int, dates: int):
    """Prices that move by hashes, in 40 categories, one cell in 50 missing."""
    share = lambda *keys: F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, str) and k.startswith("#") else F.col(k) for k in keys]), F.lit(10_007)) / 10_007.0
    grid = spark.range(tickers, numPartitions=64).select(
        F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("ticker"), F.concat(F.lit("C"), (F.col("id") % 40).cast("string")).alias("category"),
        F.explode(F.sequence(F.lit(0), F.lit(dates - 1))).alias("t"))
    close = F.when(share("ticker", "t", "#gap") > 0.02, 50 + 30 * F.sin(F.col("t") / 90.0 + share("ticker", "#phase") * 6) + 4 * share("ticker", "t", "#step"))
    grid = grid.withColumn("date", F.date_add(F.lit("2015-01-01").cast("date"), F.col("t"))).withColumn("close", close)
    return grid.select("date", "t", "ticker", "category", (F.col("close") * 0.999).alias("open"), (F.col("close") * (1 + 0.02 * share("ticker", "t", "#high"))).alias("high"),
                       (F.col("close") * (1 - 0.02 * share("ticker", "t", "#low"))).alias("low"), "close", (1000 + 9000 * share("ticker", "t", "#volume")).alias("volume"))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--tickers", type=int, default=2000)
    ap.add_argument("--dates", type=int, default=2500)
    ap.add_argument("--sets", nargs="*", default=["v3", *[f.name for f in FM.FAMILIES], "all"])
    args = ap.parse_args()
    spark = local_session(8, "scale", partitions=64)
    grid = materialise(panel(spark, args.tickers, args.dates), "panel")
    named = {f.name: [f] for f in FM.FAMILIES} | {"all": list(FM.FAMILIES)}
    for name in args.sets:
        df = I.v3(grid, args.tickers) if name == "v3" else build(grid, named[name], args.tickers)
        exchanges = len(re.findall(r"Exchange (?:hash|range|Single)", df._jdf.queryExecution().executedPlan().toString()))
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        print(json.dumps({"set": name, "rows": args.tickers * args.dates, "columns": len(df.columns) - 2, "exchanges": exchanges, "sec": round(time.perf_counter() - start, 1)}), flush=True)
    drop_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
