"""Sources: JSON documents of each stage, URL lists, media listings, probes."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions import jsons as J
from sparkyard.functions.scalars import clip, strip, video_id
from sparkyard.operators.parsing import FIELDS, lots_of_text, read_lots
from sparkyard.session import names_in

#: Id in the file names of stage documents, as transcript_<id>.json.
_ID = r"(?:^|/)(?:video_info|transcript|screenshots|ocr_results|lots|metadata|result)_([^/]+)\.json$"


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, video_id, value): whole text files, the id taken from the file name."""
    return named(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def _decoded(in_name: Column) -> Column:
    """The id that `file_id` has made this part of a name of."""
    return F.when(in_name.startswith("~"), F.decode(F.unhex(F.substr(in_name, F.lit(2))), "UTF-8")).otherwise(in_name)


def named(rows: DataFrame) -> DataFrame:
    """(path, video_id, value) of rows (path, value)."""
    return rows.select("path", _decoded(F.nullif(F.regexp_extract("path", _ID, 1), F.lit(""))).alias("video_id"), "value")


def file_id(video_id: Column | str) -> Column:
    """An id as part of a file's name: as it is, or its bytes in hexadecimal behind a ~ where it has other than letters, digits and ._-"""
    c = F.col(video_id) if isinstance(video_id, str) else video_id
    return F.when(c.rlike(r"^[A-Za-z0-9._-]+$"), c).otherwise(F.concat(F.lit("~"), F.lower(F.hex(c))))


def _names(spark: SparkSession, stage: str, ids: Sequence[str], ending: str) -> list[str]:
    """<stage>_<id><ending> of each id."""
    return [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(F.concat(F.lit(f"{stage}_"), file_id("i"), F.lit(ending))).collect()] if ids else []


def stage_documents(spark: SparkSession, folder: str, stage: str, ids: Sequence[str] | None = None) -> DataFrame:
    """(path, video_id, value) of a folder's documents <stage>_<id>.json; with ids, the files of others are not opened."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{stage}_*.json")
    if ids is not None:
        found = found.where(F.col("_metadata.file_name").isin(_names(spark, stage, ids, ".json")))
    return named(found.select(F.col("_metadata.file_path").alias("path"), "value"))


def frame_images(spark: SparkSession, folder: str, ids: Sequence[str] | None = None) -> DataFrame:
    """(video_id, file, length, modified, content) of the images in folder/screenshots_<id>/.

    With ids, the folders of others are not listed. Bytes are read only where `content` is selected.
    """
    there = [n for n in names_in(spark, folder) if re.fullmatch(r"screenshots_[A-Za-z0-9._~-]+", n) and not n.endswith(".json")]
    if ids is not None:
        there = sorted(set(there) & set(_names(spark, "screenshots", ids, "")))
    if not there:
        return spark.createDataFrame([], "video_id string, file string, length bigint, modified timestamp, content binary")
    read = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in there])
    of = lambda group: F.regexp_extract("path", r"screenshots_([^/]+)/([^/]+)$", group)
    return read.select(_decoded(of(1)).alias("video_id"), of(2).alias("file"), "length", F.col("modificationTime").alias("modified"), "content")


def known_ids(spark: SparkSession, folder: str, *stages: str) -> DataFrame:
    """(video_id) of all that have a document of these stages; only names are read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{','.join(stages)}}}_*.json").load(folder).select("path", F.lit(None).cast("string").alias("value"))
    return named(listed).select("video_id").distinct()


#: A document that is no such JSON raises an error; see `tolerant` for reading past it.
_STRICT = {"mode": "FAILFAST"}


def _array(rows: DataFrame, element: str, index: str) -> DataFrame:
    parsed = rows.select("video_id", F.posexplode(F.from_json("value", f"array<struct<{element}>>", _STRICT)).alias(index, "__e"))
    return parsed.select("video_id", index, "__e.*")


def segments_of(rows: DataFrame) -> DataFrame:
    """(video_id, seg_idx, start, end, text) of rows (video_id, value); a corrupt document raises an error."""
    return _array(rows, "start:double,end:double,text:string", "seg_idx")


def segments(spark: SparkSession, path: str) -> DataFrame:
    return segments_of(documents(spark, path))


def frames_of(rows: DataFrame) -> DataFrame:
    """(video_id, frame_idx, seconds, ts, path) of rows (video_id, value)."""
    found = _array(rows, "seconds:int,timestamp_str:string,path:string", "frame_idx")
    return found.select("video_id", "frame_idx", "seconds", F.col("timestamp_str").alias("ts"), "path")


def frames(spark: SparkSession, path: str) -> DataFrame:
    return frames_of(documents(spark, path))


def ocr_of(rows: DataFrame) -> DataFrame:
    """(video_id, ocr_idx, ts, tokens) of JSON objects of token lists by time (video_id, value).

    Of a repeated time the last tokens count, at the first one's place.
    """
    entries = F.map_entries(F.from_json("value", "map<string,array<string>>", _STRICT))
    found = rows.select("video_id", F.posexplode(entries).alias("i", "__e")).select("video_id", "i", F.col("__e.key").alias("ts"), F.col("__e.value").alias("tokens"))
    return found.groupBy("video_id", "ts").agg(F.min("i").alias("ocr_idx"), F.max_by("tokens", "i").alias("tokens")).select("video_id", "ocr_idx", "ts", "tokens")


def ocr(spark: SparkSession, path: str) -> DataFrame:
    return ocr_of(documents(spark, path))


def lots(spark: SparkSession, path: str) -> DataFrame:
    """Stored lots with their place `pos`, re-validated and with prices re-read; an invalid one raises an error."""
    return lots_of_text(documents(spark, path).drop("path"))


@dataclass(frozen=True)
class Checked:
    """Documents by key, each parsed once: (video_id, items, error), where `error` says why there are no items.

    One that can't be read costs its own key only: its error is a row, and so travels with the
    others' results to the report.
    """

    documents: DataFrame
    position: str
    columns: tuple[str, ...]

    @property
    def rows(self) -> DataFrame:
        """An item a row, of the documents that could be read."""
        listed = self.documents.where("error is null").select("video_id", F.posexplode("items").alias(self.position, "__e"))
        flat = listed.select("video_id", self.position, "__e.*")
        return flat.select("video_id", *self.columns)

    @property
    def failures(self) -> DataFrame:
        """(video_id, error) of those that could not."""
        return self.documents.where("error is not null").select("video_id", "error")

    def kept(self, folder: str) -> Checked:
        """The same, written to a folder, so that rows and failures come from one parse."""
        self.documents.write.mode("overwrite").parquet(folder)
        return Checked(self.documents.sparkSession.read.parquet(folder), self.position, self.columns)


def _listed(rows: DataFrame, stage: str, element: str, whole: Callable[[Column], Column], lacks: Callable[[Column], Column]) -> DataFrame:
    """(video_id, items, error) of rows (video_id, value): JSON of type `element` and nothing more, no item of which `lacks` something."""
    # as an object's field, a value that does not fit its type is told in a column of its own; what would end
    # the object early does not fit into a list of one
    read = F.from_json(F.concat(F.lit('{"x":'), "value", F.lit("}")), f"x {element}, bad string", {"columnNameOfCorruptRecord": "bad"})
    single = F.size(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{element}>")) == 1
    parsed = rows.select("video_id", "value", F.coalesce(single, F.lit(False)).alias("__one"), read.alias("__r"))
    items = whole(F.col("__r.x"))
    error = (
        F.when(F.col("value").isNull() | ~F.col("__one") | F.col("__r.x").isNull() | F.col("__r.bad").isNotNull(), f"{stage}: no such JSON")
        .when(F.exists(items, lacks), f"{stage}: an item without its fields")
    )
    checked = parsed.select("video_id", items.alias("items"), error.alias("error"))
    return checked.select("video_id", F.when(F.col("error").isNull(), F.col("items")).alias("items"), "error")


def checked_segments(rows: DataFrame) -> Checked:
    """Transcripts (video_id, value): every item has start, end and text."""
    lacks = lambda e: e["start"].isNull() | e["end"].isNull() | e["text"].isNull()
    read = _listed(rows, "transcript", "array<struct<start:double,end:double,text:string>>", lambda x: x, lacks)
    return Checked(read, "seg_idx", ("seg_idx", "start", "end", "text"))


def checked_frames(rows: DataFrame) -> Checked:
    """Frame indexes (video_id, value): every item has seconds, time and path."""
    lacks = lambda e: e["seconds"].isNull() | e["ts"].isNull() | e["path"].isNull()
    named_ = lambda x: F.transform(x, lambda e: F.struct(e["seconds"].alias("seconds"), e["timestamp_str"].alias("ts"), e["path"].alias("path")))
    read = _listed(rows, "screenshots", "array<struct<seconds:int,timestamp_str:string,path:string>>", named_, lacks)
    return Checked(read, "frame_idx", ("frame_idx", "seconds", "ts", "path"))


def checked_ocr(rows: DataFrame) -> Checked:
    """Screen texts (video_id, value): lists of tokens by time; of a repeated time the last ones, at the first one's place."""
    def entries(x: Column) -> Column:
        listed = F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("ts"), e["value"].alias("tokens")))
        # later entries of a time overwrite the tokens of its first one
        into = lambda acc, e: F.when(F.exists(acc, lambda a: a["ts"] == e["ts"]), F.transform(acc, lambda a: F.when(a["ts"] == e["ts"], e).otherwise(a))).otherwise(F.concat(acc, F.array(e)))
        repeated = F.size(F.array_distinct(F.transform(listed, lambda e: e["ts"]))) < F.size(listed)
        return F.when(repeated, F.aggregate(listed, F.slice(listed, 1, 0), into)).otherwise(listed)

    lacks = lambda e: e["ts"].isNull() | e["tokens"].isNull()
    read = _listed(rows, "ocr_results", "map<string,array<string>>", entries, lacks)
    return Checked(read, "ocr_idx", ("ocr_idx", "ts", "tokens"))


def checked_lots(rows: DataFrame) -> Checked:
    """Stored lots (video_id, value), re-validated: one invalid lot makes the document unreadable."""
    spoken = rows.select("video_id", J.items(J.strict_json("value")).isNotNull().alias("listed"))
    read = read_lots(rows.select("video_id", "value"), "value").withColumn("__lot", F.struct(*FIELDS)).groupBy("video_id")
    read = read.agg(F.sort_array(F.collect_list(F.struct("pos", "__lot"))).alias("l"), F.array_distinct(F.flatten(F.collect_list("errors"))).alias("e"))
    joined = spoken.join(read, "video_id", "left")
    wrong = F.coalesce(F.size("e") > 0, F.lit(False))
    error = F.when(~F.col("listed"), "lots: no such JSON").when(wrong, F.concat(F.lit("lots: invalid "), F.array_join("e", ", ")))
    items = F.transform("l", lambda x: x["__lot"])
    checked = joined.select("video_id", F.coalesce(items, F.slice(items, 1, 0), F.array().cast(joined.select(items.alias("x")).schema["x"].dataType)).alias("items"), error.alias("error"))
    return Checked(checked.select("video_id", F.when(F.col("error").isNull(), F.col("items")).alias("items"), "error"), "pos", ("pos", *FIELDS))


def metadata(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows with date, city, auctioneer, farm, auction_type and notes of a JSON object in the text.

    A text without one gives nulls. Values that are no text are rendered as text, and named in
    `odd_fields`.
    """
    v = J.object_of(text)
    names = ("date", "city", "auctioneer", "farm", "auction_type", "notes")
    as_text = {n: F.coalesce(F.try_variant_get(J.field(v, n), "$", "string"), F.when(J.kind(J.field(v, n)).isin("ARRAY", "OBJECT"), F.to_json(J.field(v, n)))) for n in names}
    odd = F.filter(F.array(*(F.when(~J.kind(J.field(v, n)).isin("STRING", "VOID"), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return rows.withColumns(as_text | {"odd_fields": odd})


def video_info(rows: DataFrame) -> DataFrame:
    """(video_id, title, description): null as empty, descriptions cut at 2000 characters."""
    return rows.select("video_id", F.coalesce("title", F.lit("")).alias("title"), clip("description", 2000).alias("description"))


def listed_urls(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows once for each URL of their lines, with its line: blank lines and those that start with # are left out."""
    kept = [c for c in rows.columns if c != text]
    lines = rows.select(*kept, F.posexplode(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("line", "url")).withColumn("url", strip("url"))
    return lines.where(~F.col("url").startswith("#") & (F.col("url") != ""))


def batch_urls(spark: SparkSession, urls: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """(ordinal, url, video_id): given URLs first, then a file's lines without blanks and comments."""
    given = spark.createDataFrame([(0, i, u.strip()) for i, u in enumerate(urls) if u.strip()], "part int, line bigint, url string")
    if path:
        listed = listed_urls(spark.read.text(path, wholetext=True))
        given = given.unionByName(listed.select(F.lit(1).alias("part"), F.col("line").cast("bigint").alias("line"), "url"))
    from pyspark.sql import Window

    numbered = given.withColumn("ordinal", F.row_number().over(Window.orderBy("part", "line")))  # a list of URLs, not data
    return numbered.select("ordinal", "url", video_id("url").alias("video_id"))


def tolerant(rows: DataFrame, expected: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """Every expected key with its document as VARIANT; null where it is missing or no JSON."""
    read = rows.select(*keys, J.strict_json(text).alias("document"))
    return expected.join(read, list(keys), "left")


def prompt(spark: SparkSession, path: str) -> str:
    """A prompt's text: one small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def audio_sources(listing: DataFrame) -> DataFrame:
    """(video_id, path): the first finished audio download of each video by name."""
    named = listing.withColumn("video_id", F.regexp_extract("path", r"audio_source_([^/.]+)\.", 1))
    return named.where((F.col("video_id") != "") & ~F.col("path").endswith(".part")).groupBy("video_id").agg(F.min("path").alias("path"))


def frame_index(listing: DataFrame, interval: int = 30) -> DataFrame:
    """(video_id, frame_idx, seconds, ts, path) of sampled frames: frame i was taken at i * interval."""
    from sparkyard.functions.scalars import hms

    if interval < 1:
        raise ValueError("interval has to be at least 1")
    rows = listing.groupBy("video_id").agg(F.sort_array(F.collect_list("path")).alias("p")).select("video_id", F.posexplode("p").alias("frame_idx", "path"))
    rows = rows.withColumn("seconds", F.col("frame_idx") * interval)
    return rows.select("video_id", "frame_idx", "seconds", hms("seconds").alias("ts"), "path")


def duration(probe: Column, codec_type: str) -> Column:
    """Seconds of the first stream of that type in a media probe's JSON; an error without one."""
    streams = F.from_json(probe, "struct<streams:array<struct<codec_type:string,duration:string>>>")["streams"]
    first = F.get(F.filter(streams, lambda s: s["codec_type"] == codec_type), F.lit(0))["duration"].cast("double")
    return F.coalesce(first, F.raise_error(F.lit(f"no {codec_type} stream")).cast("double"))
