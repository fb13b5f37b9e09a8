"""Runs over a folder of stage documents: what each video's stages were made from, failures by video, documents by video.

Stages form a graph: documents -> lots -> result, documents and lots -> metadata -> result -> written
documents. Each key's stage knows the digest of what it was made from, the digests of earlier stages
included, so that a changed transcript makes its own video's stages anew and no others. What can't be read is a
failure of its own video; the others go on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.operators import parsing
from sparkyard.session import delete, exists
from sparkyard.sources import readers, writers

from . import auctions, providers

#: Stages with a document of their own in the output folder.
WRITTEN = ("lots", "metadata", "result")


@dataclass(frozen=True)
class Outcome:
    """urls: ordinal, url, video_id of what was attempted. failures: ordinal, error. auctions, lots: of the videos that succeeded."""

    urls: DataFrame
    failures: DataFrame
    auctions: DataFrame
    lots: DataFrame
    work: str | None = None

    def release(self) -> None:
        """Delete what the run has read and kept for its outcome, which can't be read any more then."""
        if self.work:
            delete(self.lots.sparkSession, self.work)

    def report(self, name: str, settings: auctions.Settings) -> tuple[DataFrame, DataFrame]:
        """(report, markdown) of the run as a batch, one row each."""
        return auctions.run_batch(name, self.urls, self.auctions, self.lots, self.failures, settings)


def _answer_digests(rows: DataFrame | None, keys: DataFrame) -> DataFrame:
    """(video_id, stamp) of recorded answers: any change of a video's answers changes it."""
    if rows is None:
        return keys.select("video_id", F.lit("").alias("stamp"))
    each = rows.groupBy("video_id").agg(F.concat_ws(" ", F.count("*"), F.hex(F.bit_xor(F.xxhash64(*rows.columns)))).alias("stamp"))
    return keys.select("video_id").join(each, "video_id", "left")


def _depends(keys: DataFrame, *stamps: DataFrame) -> DataFrame:
    """keys (video_id) with `input`: a digest of the stamps that they are made from, in order."""
    out = keys.select("video_id")
    for i, s in enumerate(stamps):
        out = out.join(s.select("video_id", F.coalesce("stamp", F.lit("")).alias(f"__s{i}")), "video_id", "left")
    parts = [F.coalesce(f"__s{i}", F.lit("")) for i in range(len(stamps))]
    return out.select("video_id", F.sha2(F.concat_ws("\n", *parts), 256).alias("input"))


def resolved(spark: SparkSession, urls: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """urls with the ids that no URL holds filled in from a table (url, video_id) of answers; null: still unknown."""
    if lookup is None:
        return urls
    known = lookup.where("video_id is not null").groupBy("url").agg(F.min("video_id").alias("__id"))
    return urls.join(known, "url", "left").withColumn("video_id", F.coalesce("video_id", "__id")).select("ordinal", "url", "video_id")


def _failures(urls: DataFrame, there: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(ordinal, error) of URLs without an id, without documents, or with one that can't be read."""
    bad = unreadable.groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_set("error")), "; ").alias("bad"))
    joined = urls.join(there.select("video_id", F.lit(True).alias("there")), "video_id", "left").join(bad, "video_id", "left")
    error = (
        F.when(F.col("video_id").isNull(), F.concat(F.lit("no video id in "), "url"))
        .when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("there").isNull(), "no transcript or screen text")
    )
    return joined.select("ordinal", error.alias("error")).where("error is not null")


def _until_first_failure(urls: DataFrame, failures: DataFrame) -> DataFrame:
    first = failures.agg(F.min("ordinal")).first()[0]
    return urls if first is None else urls.where(F.col("ordinal") <= first)


@dataclass(frozen=True)
class Evidence:
    """Readable evidence of a run's videos: urls attempted and failures, keys with `stamp`, segments, screen texts, titles."""

    urls: DataFrame
    failures: DataFrame
    keys: DataFrame
    segments: DataFrame
    ocr: DataFrame
    info: DataFrame


def evidence(spark: SparkSession, folder: str, work: str, urls: DataFrame | None, stop: bool = False) -> Evidence:
    """Read the documents of the URLs' videos (None: all of the folder), each once and nothing of others, into `work`."""
    if urls is None:
        listed = readers.known_ids(spark, folder, "transcript", "ocr_results")
        urls = listed.select(F.dense_rank().over(_by("video_id")).alias("ordinal"), F.lit(None).cast("string").alias("url"), "video_id")
        ids = None
    else:
        ids = [r[0] for r in urls.select("video_id").where("video_id is not null").distinct().collect()]  # as many as URLs were given
    urls.write.parquet(f"{work}/urls")
    urls = spark.read.parquet(f"{work}/urls")
    found = {}
    for stage in ("transcript", "ocr_results", "video_info"):
        documents = readers.stage_documents(spark, folder, stage, ids)
        documents.select("video_id", "value", F.sha2(F.coalesce("value", F.lit("")), 256).alias("stamp")).write.parquet(f"{work}/documents/{stage}")
        found[stage] = spark.read.parquet(f"{work}/documents/{stage}")
    speech = readers.checked_segments(found["transcript"]).kept(f"{work}/transcript")
    screen = readers.checked_ocr(found["ocr_results"]).kept(f"{work}/ocr_results")
    there = found["transcript"].select("video_id").union(found["ocr_results"].select("video_id")).distinct()
    failures = _failures(urls, there, speech.failures.union(screen.failures))
    failures.write.parquet(f"{work}/failures")
    failures = spark.read.parquet(f"{work}/failures")
    if stop:
        urls = _until_first_failure(urls, failures)
        failures = failures.join(urls.select("ordinal"), "ordinal", "left_semi")
    good = urls.join(failures, "ordinal", "left_anti").select("video_id").distinct()
    only = lambda df: df.join(good, "video_id", "left_semi")
    titles = readers.video_info(found["video_info"].select("video_id", F.from_json("value", "title string, description string").alias("i")).select("video_id", "i.*"))
    keys = _depends(good, found["transcript"], found["ocr_results"]).withColumnRenamed("input", "stamp")
    first = urls.groupBy("video_id").agg(F.min_by("url", "ordinal").alias("video_url"))
    info = good.join(first, "video_id").join(titles, "video_id", "left").join(found["video_info"].select("video_id", F.col("stamp").alias("info_stamp")), "video_id", "left")
    return Evidence(urls, failures, keys, only(speech.rows), only(screen.rows), info)


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # a folder's videos, numbered for a report


def _provider_stamp(provider: providers.Provider) -> dict:
    """What a calling provider's answers depend on."""
    named = ("model", "extraction_prompt", "verify_prompt", "metadata_prompt", "in_order")
    return {k: getattr(provider, k, None) for k in named} | {"kind": type(provider).__name__}


def run(
    spark: SparkSession,
    folder: str,
    output: str,
    settings: auctions.Settings,
    provider: providers.Provider,
    urls: DataFrame | None = None,
    resume: bool = True,
    lots_only: bool = False,
) -> Outcome:
    """Lots, metadata and result documents of the URLs' videos (None: all of the folder) under output.

    urls: ordinal, url, video_id. Each video gets lots_<id>.json and, without lots_only,
    metadata_<id>.json and result_<id>.json; documents of other videos stay. Videos without any
    evidence line get documents without lots. Calling providers keep their answers under
    output/_stages unless they have a store of their own.
    """
    if isinstance(provider, providers.Called) and provider.store is None:
        provider = replace(provider, store=f"{output}/_stages/answers")
    work = f"{output}/_work/{uuid.uuid4().hex}"
    with auctions.stage(spark, "Read evidence"):
        e = evidence(spark, folder, work, urls, settings.stop_on_error)
    own = {k: getattr(settings, k) for k in ("window_size", "overlap", "frame_interval", "video_height", "confidence", "provider", "transcriber")} | _provider_stamp(provider)
    lots = writers.StageTable(spark, f"{output}/_stages/lots", **own)
    facts = writers.StageTable(spark, f"{output}/_stages/metadata", **own)
    results = writers.StageTable(spark, f"{output}/_stages/{'lots_document' if lots_only else 'result'}")
    # documents that someone has taken away are written again
    last_stage = "lots" if lots_only else "result"
    if exists(spark, f"{output}/_stages"):
        results.clear(e.keys.select("video_id").join(readers.known_ids(spark, output, last_stage), "video_id", "left_anti"))
    if not resume:
        for table in (lots, facts, results):
            table.clear(e.keys.select("video_id"))

    def windows_of(keys: DataFrame) -> DataFrame:
        """Windows of these videos, put together once and read by everything that is made of them."""
        place = f"{work}/windows/{uuid.uuid4().hex}"
        auctions.windows(*(df.join(keys, "video_id", "left_semi") for df in (e.segments, e.ocr)), settings).write.parquet(place)
        return spark.read.parquet(place)

    recorded = lambda name: _answer_digests(getattr(provider, name, None), e.keys)
    wanted = _depends(e.keys, e.keys, recorded("responses"), recorded("verdicts"))
    with auctions.stage(spark, "Extract lots"):
        found = lots.fill(wanted, lambda keys: auctions.extract(windows_of(keys), provider, settings))
    only = lambda df, keys: df.join(keys, "video_id", "left_semi")
    put_lots = lambda keys: writers.write_documents(writers.document(only(found, keys), ["video_id"], "lot_number", list(parsing.FIELDS), wanted=keys), output, "lots")
    if lots_only:
        with auctions.stage(spark, "Write documents"):
            results.fill(_depends(e.keys, lots.stamp(wanted)), lambda keys: put_lots(keys) or keys)
        return Outcome(e.urls, e.failures, e.info.select("video_id", "video_url", *(F.lit(None).cast("string").alias(c) for c in auctions.FACTS)), found, work)
    head = _depends(e.keys, e.keys, e.info.select("video_id", F.col("info_stamp").alias("stamp")), recorded("facts"))
    with auctions.stage(spark, "Extract metadata"):
        made = lambda keys: auctions.facts_of(e.info.join(keys, "video_id", "left_semi"), windows_of(keys), provider)
        known = facts.fill(head, made)
    joined = e.info.select("video_id", "video_url").join(known, "video_id", "left")
    urls_ = e.info.select("video_id", F.sha2(F.coalesce("video_url", F.lit("")), 256).alias("stamp"))
    last = _depends(e.keys, lots.stamp(wanted), facts.stamp(head), urls_)

    def write(keys: DataFrame) -> DataFrame:
        put_lots(keys)
        writers.write_documents(writers.metadata_document(only(joined, keys), auctions.FACTS, known=F.coalesce("answered", F.lit(False))), output, "metadata")
        writers.write_documents(writers.result_document(only(joined, keys).select("video_id", "video_url", *auctions.FACTS), only(found, keys)), output, "result")
        return keys

    with auctions.stage(spark, "Write documents"):
        results.fill(last, write)
    return Outcome(e.urls, e.failures, joined.drop("answered"), found, work)


def batch(spark: SparkSession, folder: str, urls: DataFrame, stop: bool = False) -> Outcome:
    """The outcome of a batch by the lots and metadata documents of a folder; a video whose lots are missing or unreadable has failed."""
    ids = [r[0] for r in urls.select("video_id").where("video_id is not null").distinct().collect()]  # as many as URLs were given
    documents = readers.stage_documents(spark, folder, "lots", ids)
    checked = readers.checked_lots(documents)
    answers = readers.stage_documents(spark, folder, "metadata", ids).select("video_id", F.col("value").alias("response"))
    failures = _failures(urls, documents.select("video_id"), checked.failures)
    failures = failures.withColumn("error", F.when(F.col("error") == "no transcript or screen text", "no lots for this video").otherwise(F.col("error")))
    if stop:
        urls = _until_first_failure(urls, failures)
    info = urls.where("video_id is not null").groupBy("video_id").agg(F.min_by("url", "ordinal").alias("video_url"))
    return Outcome(urls, failures, auctions.auctions(info, answers), checked.rows.drop("pos"))


def models(spark: SparkSession, folder: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """((video_id, model, lots...), (video_id, model, error)) of lots documents in folder/<model>; unreadable ones are failures."""
    rows, failed = [], []
    for name in names:
        checked = readers.checked_lots(readers.stage_documents(spark, f"{folder}/{name}", "lots"))
        rows.append(checked.rows.withColumn("model", F.lit(name)))
        failed.append(checked.failures.withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, failed)
