"""Screen texts from sampled frames: images are read where they lie, a recogniser tells their texts, one document a video."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.operators.timeline import confident_text
from sparkyard.session import delete, exists, settings_for, ship
from sparkyard.sources import readers, writers

#: Frames asked for, some 100 bytes each, up to which their names travel to all tasks that read images.
FRAMES_SENT = 200_000
#: Images that a Python worker holds at once: their bytes, and their number.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}

Recogniser = Callable[[bytes], list[tuple[str, float]] | None]


def texts_of_images(images: DataFrame, detect: Recogniser, least: float = 0.4) -> DataFrame:
    """(video_id, file, tokens, error) of images (video_id, file, content): texts of at least that confidence, in the recogniser's order.

    An image that the recogniser fails on has no tokens and says why. Set BATCH where this is run.
    """
    ship(images.sparkSession)

    def one(file: str, content: bytes) -> tuple[list, str | None]:
        try:
            return [{"text": str(t), "confidence": float(c)} for t, c in detect(bytes(content)) or []], None
        except Exception as e:
            return [], f"{file}: {e}"[:400]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            told = [one(f, c) for f, c in zip(pdf["file"], pdf["content"], strict=True)]
            yield pdf[["video_id", "file"]].assign(detections=[d for d, _ in told], error=[e for _, e in told])

    schema = "video_id string, file string, detections array<struct<text:string,confidence:double>>, error string"
    read = images.select("video_id", "file", "content").mapInPandas(run, schema)
    return read.select("video_id", "file", confident_text("detections", least).alias("tokens"), "error")


def texts_of_frames(frames: DataFrame, images: DataFrame, detect: Recogniser, least: float = 0.4) -> DataFrame:
    """(video_id, ocr_idx, ts, tokens, error) of every frame (video_id, frame_idx, ts, path); one without an image has no tokens.

    A frame's image is the one of its video with the name at the end of its path, wherever the
    folder lies now. Images don't shuffle: they are recognised by the task that reads them, and only
    texts meet the frames. Those that no frame names are left out before, as long as the names fit a
    broadcast (they are counted), and after the recogniser otherwise.
    """
    frames = frames.withColumn("file", F.element_at(F.split("path", r"[/\\]"), -1))
    asked = frames.select("video_id", "file").distinct()
    if asked.count() <= FRAMES_SENT:
        images = images.join(F.broadcast(asked), ["video_id", "file"], "left_semi")
    found = texts_of_images(images, detect, least)
    joined = frames.join(found, ["video_id", "file"], "left")
    return joined.select("video_id", F.col("frame_idx").alias("ocr_idx"), "ts", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "error")


def read_screens(spark: SparkSession, folder: str, detect: Recogniser, ids: Sequence[str] | None = None, least: float = 0.4, recogniser: str = "", resume: bool = True) -> DataFrame:
    """Write ocr_results_<id>.json for the videos with a frame index; returns failures (video_id, error).

    ids: the videos asked for (None: all); the indexes and images of others are not opened. A video
    is read again when its index, one of its images (by name, size and time), the least confidence or
    the `recogniser` (its name and version) has changed, or its document is gone. A video whose index
    can't be read, or one of whose images the recogniser fails on, gets no document and fails alone.
    """
    work = f"{folder}/_work/{uuid.uuid4().hex}"
    checked = readers.checked_frames(readers.stage_documents(spark, folder, "screenshots", ids)).kept(f"{work}/frames")
    images = readers.frame_images(spark, folder, ids)
    seen = images.groupBy("video_id").agg(F.concat_ws(" ", F.count("*"), F.hex(F.bit_xor(F.xxhash64("file", "length", "modified")))).alias("images"))
    good = checked.documents.where("error is null").select("video_id", F.to_json("items").alias("items"))
    wanted = good.join(seen, "video_id", "left").select("video_id", F.sha2(F.concat_ws("\n", "items", F.coalesce("images", F.lit(""))), 256).alias("input"))
    wanted.write.parquet(f"{work}/wanted")
    wanted = spark.read.parquet(f"{work}/wanted")
    texts = writers.StageTable(spark, f"{folder}/_stages/screens", least=least, recogniser=recogniser)
    placed = writers.StageTable(spark, f"{folder}/_stages/ocr_results")
    if exists(spark, f"{folder}/_stages"):
        placed.clear(wanted.select("video_id").join(readers.known_ids(spark, folder, "ocr_results"), "video_id", "left_anti"))
    if not resume:
        for table in (texts, placed):
            table.clear(wanted.select("video_id"))

    def make(keys: DataFrame) -> DataFrame:
        only = lambda df: df.join(keys, "video_id", "left_semi")
        place = f"{work}/texts/{uuid.uuid4().hex}"
        texts_of_frames(only(checked.rows), images, detect, least).write.parquet(place)
        return spark.read.parquet(place)

    def put(keys: DataFrame) -> DataFrame:
        told = writers.ocr_document(found.join(keys, "video_id", "left_semi"))
        writers.write_documents(keys.join(told, "video_id", "left").withColumn("value", F.coalesce("value", F.lit("{}"))), folder, "ocr_results")
        return keys

    with settings_for(spark, BATCH):
        found = texts.fill(wanted, make)
    failed = checked.failures
    if exists(spark, f"{work}/texts"):
        failed = failed.union(spark.read.parquet(f"{work}/texts/*").where("error is not null").groupBy("video_id").agg(F.min("error").alias("error")))
    failures = spark.createDataFrame(failed.collect(), "video_id string, error string")  # a row a failed video
    done = texts.stamp(wanted).withColumnRenamed("stamp", "input").join(failures, "video_id", "left_anti")
    placed.fill(done, put)
    delete(spark, work)
    return failures
