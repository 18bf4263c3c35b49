"""The score stream over the events, in micro-batches, against one batch in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as B
from catalog.base import rs
from catalog.registry import query
from crosspanel.session import scratch_path
from crosspanel.streaming import scores as SS

KEY = ["event_type"]
WINDOW_SQL = """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(value) AS n, sum(value) AS total, min(value) AS low, max(value) AS high,
  arg_max(value, ts) AS latest, max(ts) AS newest FROM events GROUP BY 1, 2, 3"""


def appended(spark, sf, runs: int, late: bool):
    """Events written to a folder in several appends and read by as many runs of the stream; ``late`` ones come a day after their time."""
    events = B.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source, target, checkpoint = (scratch_path(spark, n) for n in ("stream-source", "stream-target", "stream-checkpoint"))
    day = F.date_diff(F.col("ts"), events.agg(F.min("ts")).scalar())
    if late:
        day = day + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    for k in range(runs):
        part = F.least(F.floor(day / 6), F.lit(runs - 1)) == k
        events.filter(part).coalesce(2).write.mode("append").parquet(source)
        SS.run(spark, source, events.schema, target, checkpoint, "ts", KEY, "value")
    made = SS.table(spark, target, KEY)
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end", "newest")})


@query("S13", f"SELECT window_start, window_end, event_type, n, {rs('total', 'low', 'high', 'latest')}, newest FROM ({WINDOW_SQL})")
def score_stream(spark, sf):
    """Daily windows of the event stream after several runs, each reading only what was appended since the last."""
    return appended(spark, sf, 3, late=False)


@query("S13", f"SELECT window_start, window_end, event_type, n, {rs('total', 'low', 'high', 'latest')}, newest FROM ({WINDOW_SQL})")
def late_score_stream(spark, sf):
    """The same with a fifth of the events a day late, within the watermark: they correct the windows they belong to."""
    return appended(spark, sf, 4, late=True)
