"""From evidence to lots, auctions and batch reports, as lazy plans over all videos at once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.operators import lots as L
from sparkyard.operators import parsing, reports, summaries, timeline
from sparkyard.sources.readers import metadata
from sparkyard.sources.writers import result_document

from .providers import Called, Provider


@dataclass(frozen=True)
class Settings:
    """What a run depends on; checked when made."""

    window_size: int = timeline.SIZE
    overlap: int = timeline.OVERLAP
    frame_interval: int = 30
    video_height: int = 480
    confidence: float = 0.4
    provider: str = "openrouter"
    transcriber: str = "mlx"
    output: str = "output"
    stop_on_error: bool = False

    def __post_init__(self):
        from .providers import ASR_BACKENDS, default_model

        timeline.step(self.window_size, self.overlap)
        default_model(self.provider)
        if self.frame_interval < 1:
            raise ValueError("frame_interval has to be at least 1")
        if self.video_height not in (480, 720):
            raise ValueError("video_height is 480 or 720")
        if self.transcriber not in ASR_BACKENDS:
            raise ValueError(f"transcriber is one of {', '.join(ASR_BACKENDS)}")


def windows(segments: DataFrame, ocr: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return timeline.text_windows(segments, ocr, settings.window_size, settings.overlap)


def merged_lots(responses: DataFrame, windows: DataFrame) -> DataFrame:
    """Lots by video and number: parsed, repaired, guarded against bursts, merged."""
    read = L.repair(parsing.valid(parsing.read_lots(responses.select("video_id", "window_idx", "response"))))
    kept = L.burst_guard(L.with_support(read, windows), "video_id", "window_idx", "lot_number", "supported")
    # a merge that meets a lot again builds it anew: prices are read once more
    return parsing.rebuilt(L.merge_lots(kept))


def fenced(lots: DataFrame) -> DataFrame:
    return L.flag_outliers(lots, L.fences(lots, ["video_id"], "unit_price"), ["video_id"], "unit_price")


def stored(provider: Provider, spark: SparkSession) -> Provider:
    """provider with a place for its answers, since plans read them more than once and each question is put once.

    Without one of its own a calling provider gets a folder of this run's in the folder that the
    cluster names for checkpoints.
    """
    if not isinstance(provider, Called) or provider.store is not None:
        return provider
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise ValueError("answers need a folder to be kept in: give the provider a store or set spark.checkpoint.dir")
    return replace(provider, store=f"{shared}/answers-{uuid.uuid4().hex}")


def extract(windows: DataFrame, provider: Provider, settings: Settings = Settings()) -> DataFrame:
    """Final lots of all videos; every question is put to the provider once."""
    provider = stored(provider, windows.sparkSession)
    flagged = fenced(merged_lots(provider.extract(windows), windows))
    verdicts = provider.verify(L.evidence_packets(flagged, windows, settings.window_size, settings.overlap))
    done = L.settle(L.apply_verdicts(flagged, verdicts))
    names = ["video_id", *parsing.FIELDS]
    return done.select(*names)


def results(info: DataFrame, windows: DataFrame, lots: DataFrame, provider: Provider) -> DataFrame:
    """(video_id, video_url, facts, value): auctions with their result documents, lots included.

    info: video_id, video_url, title, description. A video whose metadata answer is missing or
    unreadable has no facts, but a document all the same.
    """
    provider = stored(provider, windows.sparkSession)
    found = auctions(info, provider.metadata(timeline.head_context(windows, info)))
    return found.join(result_document(found, lots), "video_id")


#: Facts of an auction.
FACTS = ["date", "city", "auctioneer", "farm", "auction_type", "notes"]


def facts_of(info: DataFrame, windows: DataFrame, provider: Provider) -> DataFrame:
    """(video_id, date, ..., notes, answered) of all videos of info; answered: whether there is an answer that could be read."""
    provider = stored(provider, windows.sparkSession)
    contexts = info.select("video_id").join(timeline.head_context(windows, info), "video_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    answers = provider.metadata(contexts).select("video_id", "response")
    known = metadata(answers, "response").select("video_id", *FACTS, J.object_of("response").isNotNull().alias("answered"))
    return info.select("video_id").join(known, "video_id", "left")


def auctions(info: DataFrame, answers: DataFrame) -> DataFrame:
    """(video_id, video_url, date, ..., notes): facts from metadata answers (video_id, response)."""
    facts = metadata(answers, "response").drop("response", "odd_fields")
    return info.select("video_id", "video_url").join(facts, "video_id", "left")


def batch(urls: DataFrame, auctions_: DataFrame, lots: DataFrame, failures: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Batch items in the order of urls; with stop_on_error none after the first failed one."""
    items = reports.batch_items(urls, auctions_, summaries.auction_summary(lots), failures, settings.output)
    if settings.stop_on_error:
        first = items.where("status = 'failed'").agg(F.min("index").alias("__stop"))
        items = items.crossJoin(first).where(F.col("__stop").isNull() | (F.col("index") <= F.col("__stop"))).drop("__stop")
    return items


def run_batch(name: str, urls: DataFrame, auctions_: DataFrame, lots: DataFrame, failures: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(report, markdown) of a batch, one row each."""
    report = reports.batch_report(name, batch(urls, auctions_, lots, failures, settings))
    return report, reports.markdown(report)


@contextmanager
def stage(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs inside are described by name; the time they took is told when they end."""
    began = time.monotonic()
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
        minutes, seconds = divmod(int(time.monotonic() - began), 60)
        print(f"{name}: {minutes}m {seconds:02d}s")
