"""Overlapping windows and price summaries over unbounded input.

An extension: Spark's windows are half-open, those of `timeline` closed at both ends, so a row
that falls exactly on a boundary is in one window less here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkyard.operators.timeline import OVERLAP, SIZE, step


def windowed_lines(lines: DataFrame, at: str = "at", group: str = "video_id", line: str = "line", late: str = "10 minutes", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(group, window_start, window_end, n, lines) of each window, once the watermark has passed it."""
    w = F.window(at, f"{size} seconds", f"{step(size, overlap)} seconds")
    grouped = lines.withWatermark(at, late).groupBy(F.col(group), w.alias("w"))
    found = grouped.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(at, line))).alias("l"))
    return found.select(group, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", F.transform("l", lambda x: x[line]).alias("lines"))


def running_prices(lots: DataFrame, at: str = "at", every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(video_id, window_start, lots, avg_price, sold) by tumbling window."""
    w = F.window(at, every)
    found = lots.withWatermark(at, late).groupBy("video_id", w.alias("w")).agg(F.count("*").alias("lots"), F.avg(F.when(F.col("unit_price") > 0, F.col("unit_price"))).alias("avg_price"), F.count_if("sold").alias("sold"))
    return found.select("video_id", F.col("w.start").alias("window_start"), "lots", "avg_price", "sold")
