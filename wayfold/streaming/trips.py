"""Trips from a stream of positions: an extension, not a part of the batch engine's semantics.

Positions of one mover that follow each other within a gap form a session; late positions are dropped after the
watermark. State holds the open sessions' vertices only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(positions: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """moid, started, ended, n, t of each session of positions (moid, ts TIMESTAMP, x, y). Works on streams and tables."""
    vertex = F.expr("named_struct('m', CAST(unix_millis(ts) AS DOUBLE), 'x', x, 'y', y)")
    grouped = positions.withWatermark("ts", lateness).groupBy("moid", F.session_window("ts", gap).alias("s"))
    found = grouped.agg(F.collect_list(vertex).alias("v"))
    t = F.expr("transform(array_sort(v), p -> named_struct('x', p.x, 'y', p.y, 'm', p.m))")
    return found.select("moid", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), F.size("v").alias("n"), t.alias("t"))
