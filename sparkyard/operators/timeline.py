"""Overlapping closed time windows, and joins of intervals and points to them.

Window k of a group covers [k * step, k * step + size] with both ends, step = size - overlap. The
windows that an interval meets follow by arithmetic, so interval joins are an explode of a short
sequence and an equi-join on (group, k): never a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions.scalars import col, hms, hms_seconds, is_clock

SIZE, OVERLAP = 600, 60
NOTHING = "(sem conteúdo)"


def step(size: int, overlap: int) -> int:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"overlap has to be from 0 to below the size: {overlap}, {size}")
    return size - overlap


def spine(bounds: DataFrame, group: str, total: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(group, window_idx, window_start, window_end, label): windows that start before `total`."""
    stride = step(size, overlap)
    rows = bounds.where(F.col(total) > 0).select(group, F.posexplode(F.sequence(F.lit(0), F.col(total).cast("int") - 1, F.lit(stride))).alias("window_idx", "window_start"))
    rows = rows.withColumn("window_end", F.col("window_start") + size)
    return rows.withColumn("label", F.concat(hms("window_start"), F.lit(" - "), hms("window_end")))


def window_range(start: Column | str, end: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> tuple[Column, Column]:
    """First and last window that [start, end] meets, ends included; last < first: none."""
    stride = step(size, overlap)
    first = F.greatest(F.lit(0), F.ceil((col(start) - size) / stride)).cast("int")
    return first, F.floor(col(end) / stride).cast("int")


def assign(rows: DataFrame, start: str, end: str, last: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """rows with window_idx, once for each window that [start, end] meets; up to window `last` of the row."""
    lo, hi = window_range(start, end, size, overlap)
    if last:
        hi = F.least(hi, F.col(last))
    return rows.select("*", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))).alias("window_idx"))


def first_cover(rows: DataFrame, at: str, last: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """rows with window_idx of the earliest window that covers `at`; null where none does."""
    lo, hi = window_range(at, at, size, overlap)
    if last:
        hi = F.least(hi, F.col(last))
    return rows.withColumn("window_idx", F.when((F.col(at) >= 0) & (lo <= hi), lo))


def screen_line(tokens: Column | str) -> Column:
    """Tokens without broadcast clocks, joined by bars; null if none is left."""
    kept = F.filter(col(tokens), lambda t: ~is_clock(t))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def text_windows(segments: DataFrame, ocr: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows (video_id, window_idx, window_start, window_end, label, combined_text) of speech and screen text.

    segments: video_id, seg_idx, start, end, text. ocr: video_id, ocr_idx, ts (HH:MM:SS), tokens.
    Lines are ordered by their second; at one second speech comes before screen text, each in its
    own order. A window without lines has a placeholder. No segment is lost, sorted or not.
    """
    screen = ocr.withColumn("at", hms_seconds("ts").cast("double"))
    ends = segments.groupBy("video_id").agg(F.max("end").alias("t")).unionByName(screen.groupBy("video_id").agg(F.max("at").alias("t")))
    total = ends.groupBy("video_id").agg((F.greatest(F.coalesce(F.max("t"), F.lit(0.0)), F.lit(0.0)).cast("int") + 1).alias("total"))
    windows = spine(total, "video_id", "total", size, overlap)
    speech = assign(segments, "start", "end", None, size, overlap).select(
        "video_id",
        "window_idx",
        F.struct(hms(F.floor("start")).alias("ts"), F.lit(0).alias("kind"), F.col("seg_idx").alias("idx"), F.concat(F.lit("["), hms(F.floor("start")), F.lit("] ÁUDIO: "), "text").alias("line")).alias("l"),
    )
    shown = screen.withColumn("line", screen_line("tokens")).where("line is not null")
    shown = assign(shown, "at", "at", None, size, overlap).select(
        "video_id",
        "window_idx",
        F.struct("ts", F.lit(1).alias("kind"), F.col("ocr_idx").alias("idx"), F.concat(F.lit("["), "ts", F.lit("] TELA: "), "line").alias("line")).alias("l"),
    )
    lines = speech.unionByName(shown).groupBy("video_id", "window_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("combined_text"))
    return windows.join(lines, ["video_id", "window_idx"], "left").withColumn("combined_text", F.coalesce("combined_text", F.lit(NOTHING)))


def head_context(windows: DataFrame, video_info: DataFrame | None = None, first: int = 3) -> DataFrame:
    """(video_id, context): title, description and the first windows, for metadata extraction."""
    body = windows.where(F.col("window_idx") < first).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("window_idx", F.concat(F.lit("["), "label", F.lit("]\n"), "combined_text").alias("text")))).alias("w"))
    body = body.select("video_id", F.array_join(F.transform("w", lambda x: x["text"]), "\n\n").alias("body"))
    if video_info is None:
        return body.withColumnRenamed("body", "context")
    title = F.concat(F.lit("Título do vídeo: "), F.nullif("title", F.lit("")))
    description = F.concat(F.lit("Descrição do vídeo:\n"), F.nullif("description", F.lit("")))
    header = F.concat_ws("\n", title, description)
    info = video_info.select("video_id", F.when(header != "", F.concat(header, F.lit("\n\n---\n\n"))).alias("header"))
    return body.join(info, "video_id", "left").select("video_id", F.concat(F.coalesce("header", F.lit("")), "body").alias("context"))


def shift_chunks(rows: DataFrame, chunk: str, seconds: int = 900) -> DataFrame:
    """Segments of fixed-length chunks with times moved to the whole recording's."""
    return rows.withColumns({"start": F.col("start") + F.col(chunk) * seconds, "end": F.col("end") + F.col(chunk) * seconds})


def chunk_starts(rows: DataFrame, duration: str, seconds: int = 900) -> DataFrame:
    """rows with chunk_idx and chunk_start for each chunk of a recording of `duration` seconds."""
    n = F.ceil(F.col(duration) / seconds).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select("*", F.explode(starts).alias("chunk_idx")).withColumn("chunk_start", F.col("chunk_idx") * seconds)


def confident_text(detections: Column | str, least: float = 0.4) -> Column:
    """Texts of the detections with at least that confidence, in order."""
    return F.transform(F.filter(col(detections), lambda d: d["confidence"] >= least), lambda d: d["text"])


def whole_segments(rows: DataFrame, start: Column | str, end: Column | str, text: Column | str, order: str) -> DataFrame:
    """Any backend's transcript rows as (video_id, seg_idx, start, end, text), trimmed."""
    from sparkyard.functions.scalars import strip

    return rows.select("video_id", F.col(order).cast("int").alias("seg_idx"), col(start).cast("double").alias("start"), col(end).cast("double").alias("end"), strip(text).alias("text"))
