"""Sinks: stage tables with parameter fingerprints, JSON documents, reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkyard.functions.scalars import model_folder
from sparkyard.session import delete, exists, move, names_in

from .readers import file_id


def document(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str = "value", wanted: DataFrame | None = None) -> DataFrame:
    """One JSON array of the rows' fields a key, in order; nulls and non-ASCII text are kept.

    wanted: keys that get a document in any case, [] where they have no rows.
    """
    element = F.struct(F.col(order).alias("__order"), F.struct(*fields).alias("__e"))
    listed = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(element)), lambda x: x["__e"]).alias("__l"))
    made = listed.select(*keys, F.to_json("__l", {"ignoreNullFields": "false"}).alias(name))
    if wanted is None:
        return made
    return wanted.select(*keys).distinct().join(made, list(keys), "left").withColumn(name, F.coalesce(name, F.lit("[]")))


def ocr_document(ocr: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object of token lists by time a video; of repeated times the last one's tokens, at the first one's place."""
    at = Window.partitionBy("video_id", "ts")
    rows = ocr.select("video_id", "ts", F.min("ocr_idx").over(at).alias("i"), F.max_by("tokens", "ocr_idx").over(at).alias("tokens")).distinct()
    listed = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("i", "ts", "tokens"))).alias("l"))
    return listed.select("video_id", F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["ts"], x["tokens"])))).alias(name))


def result_document(auctions: DataFrame, lots: DataFrame, name: str = "value") -> DataFrame:
    """(video_id, value): an auction with its lots by number, as one JSON document."""
    fields = [c for c in lots.columns if c != "video_id"]
    listed = lots.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("lots"))
    joined = auctions.join(listed, "video_id", "left")
    empty = F.array().cast(joined.schema["lots"].dataType)
    head = [c for c in auctions.columns if c not in ("lots", "total_lots")]
    total = F.coalesce(F.size("lots"), F.lit(0))
    lots_ = F.coalesce("lots", empty)
    return joined.select("video_id", F.to_json(F.struct(*head, F.when(F.col("lots").isNull(), 0).otherwise(total).alias("total_lots"), lots_.alias("lots")), {"ignoreNullFields": "false"}).alias(name))


def write_documents(rows: DataFrame, path: str, stage: str, key: str = "video_id", value: str = "value") -> None:
    """path/<stage>_<key>.json for each row; documents of other keys stay as they are.

    All documents are written to a folder of their own first. Each is then put in its place by one
    rename, so that a reader sees the old one or the new one. What a writer has written in full but
    not put in place is put there by the next one. Of rows with one key the greatest value counts;
    a null value leaves the key's document alone.
    """
    spark = rows.sparkSession
    _put_in_place(spark, path)
    name = F.concat(F.lit(f"{stage}_"), file_id(key), F.lit(".json")).alias("name")
    one = rows.where(F.col(value).isNotNull()).select(name, F.col(value).alias("value")).groupBy("name").agg(F.max("value").alias("value"))
    one.write.partitionBy("name").text(f"{path}/{_STAGED}{time.time_ns():020d}-{uuid.uuid4().hex}")
    _put_in_place(spark, path)


#: Folders of documents that are not in place yet, by time; readers pass over names that begin with _.
_STAGED = "_staged-"


def _put_in_place(spark: SparkSession, path: str) -> None:
    """Move the documents of all completed staging folders, oldest first. Only names pass the driver."""
    for folder in (n for n in names_in(spark, path) if n.startswith(_STAGED)):
        staged = f"{path}/{folder}"
        if not exists(spark, f"{staged}/_SUCCESS"):
            continue  # its writer is at work, or has failed

        def put(part: str, staged: str = staged) -> None:
            for file in names_in(spark, f"{staged}/{part}"):
                if file.startswith("part-"):
                    move(spark, f"{staged}/{part}/{file}", f"{path}/{part.removeprefix('name=')}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(put, [n for n in names_in(spark, staged) if n.startswith("name=")]))
        delete(spark, staged)


def write_by_model(rows: DataFrame, path: str, model: str = "model") -> None:
    """One folder a model, named safely."""
    rows.withColumn("model_dir", model_folder(model)).write.mode("overwrite").partitionBy("model_dir").json(path)


def write_report(report: DataFrame, text: DataFrame, path: str) -> None:
    """A batch report (one row each) as JSON and as markdown."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/batch_summary")
    text.select("value").coalesce(1).write.mode("overwrite").text(f"{path}/comparison")


def metadata_document(rows: DataFrame, fields: Sequence[str], name: str = "value", known: Column | None = None) -> DataFrame:
    """(video_id, value): facts as a JSON object, nulls kept; {} where nothing is known.

    known: whether there is an answer at all; by default, whether any field is there.
    """
    if known is None:
        known = reduce(Column.__or__, (F.col(f).isNotNull() for f in fields))
    return rows.select("video_id", F.when(known, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).otherwise("{}").alias(name))


def append_run(runs: DataFrame, path: str) -> None:
    """Rows of a run table; errors are cut at 400 characters."""
    short = runs.withColumn("error", F.left("error", F.lit(400))) if "error" in runs.columns else runs
    short.write.mode("append").parquet(path)


def fingerprint(**parameters: object) -> Column:
    """Digest of what a stage's result depends on beside its input."""
    text = "\n".join(f"{k}={v!r}" for k, v in sorted(parameters.items()))
    return F.sha2(F.lit(text), 256)


_MARKS = "fingerprint string, input string, run string, at timestamp"


class StageTable:
    """A stage's results as Parquet by video, each with what it was made from.

    `rows` holds results, `done` which keys a run has completed, with the stage's parameters and a
    digest of the key's `input` (see `stamp`), so a key without any result is known to be done and one
    whose input has changed is not. A run writes its rows first and its keys then; what a run that broke
    off has left is never read. The last run of a key counts.
    """

    def __init__(self, spark: SparkSession, path: str, **parameters: object):
        self.spark, self.path, self.parameters = spark, path, parameters

    def _done(self, key: str) -> DataFrame | None:
        """(key, run, __input) of the keys that are completed with these parameters."""
        if not exists(self.spark, f"{self.path}/done"):
            return None
        marks = self.spark.read.schema(f"{key} string, {_MARKS}").parquet(f"{self.path}/done").where(F.col("fingerprint") == fingerprint(**self.parameters))
        last = marks.groupBy(key).agg(F.max_by(F.struct("run", F.col("input").alias("__input")), "at").alias("last"))
        return last.select(key, "last.*").where("run is not null")

    def stamp(self, wanted: DataFrame, key: str = "video_id") -> DataFrame:
        """(key, stamp): digest of the parameters and the key's input, to be an input of stages that are made from this one."""
        return wanted.select(key, F.sha2(F.concat_ws("\n", fingerprint(**self.parameters), _input(wanted)), 256).alias("stamp"))

    def present(self, key: str = "video_id") -> DataFrame | None:
        """Rows made with these parameters; None before the first run."""
        done = self._done(key)
        if done is None or not exists(self.spark, f"{self.path}/rows"):
            return None
        return self.spark.read.parquet(f"{self.path}/rows").join(done.select(key, "run"), [key, "run"], "left_semi").drop("run")

    def missing(self, wanted: DataFrame, key: str = "video_id") -> DataFrame:
        """Rows of wanted (key, and `input` where results depend on one) that are not completed yet."""
        done = self._done(key)
        if done is None:
            return wanted
        same = (F.col(f"w.{key}") == F.col(f"d.{key}")) & _input(wanted).eqNullSafe(F.col("d.__input"))
        return wanted.alias("w").join(done.alias("d"), same, "left_anti")

    def put(self, rows: DataFrame, keys: DataFrame, key: str = "video_id") -> None:
        """Results of keys, in place of earlier ones; keys with a row that has an `error` don't count as completed."""
        run, folder = uuid.uuid4().hex, f"{self.path}/rows"
        named = rows.withColumn("run", F.lit(run))
        # a column of the run's, not of the folder's, so that a run without rows leaves a schema behind
        named.write.mode("append").parquet(folder)
        if "error" in rows.columns:
            failed = self.spark.read.schema(named.schema).parquet(folder).where((F.col("run") == run) & F.col("error").isNotNull())
            keys = keys.join(failed, key, "left_anti")
        self._mark(keys, key, run)

    def _mark(self, keys: DataFrame, key: str, run: str | None) -> None:
        marks = keys.select(key, _input(keys).alias("input")).distinct()
        marks.select("*", fingerprint(**self.parameters).alias("fingerprint"), F.lit(run).cast("string").alias("run"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/done")

    def fill(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], key: str = "video_id") -> DataFrame:
        """Results for all of wanted; only missing ones are made, and kept even where they have an error."""
        names = [key, "input"] if "input" in wanted.columns else [key]
        # read once: what is made of them may change what is missing
        folder = f"{self.path}/wanted/{uuid.uuid4().hex}"
        self.missing(wanted, key).select(*names).distinct().write.parquet(folder)
        due = self.spark.read.parquet(folder)
        if not due.isEmpty():
            self.put(make(due.select(key)), due, key)
        delete(self.spark, folder)
        rows = self.present(key)
        if rows is None:
            return make(wanted.select(key).limit(0))
        return rows.join(self._current(wanted, key), key, "left_semi")

    def _current(self, wanted: DataFrame, key: str) -> DataFrame:
        """Keys of wanted that are completed with their inputs."""
        done = self._done(key)
        same = (F.col(f"w.{key}") == F.col(f"d.{key}")) & _input(wanted).eqNullSafe(F.col("d.__input"))
        return wanted.alias("w").join(done.alias("d"), same, "left_semi").select(key).distinct()

    def clear(self, keys: DataFrame, key: str = "video_id") -> None:
        """Forget the results of keys; they are made anew when next wanted."""
        if exists(self.spark, f"{self.path}/done"):
            self._mark(keys, key, None)


def _input(rows: DataFrame) -> Column:
    return F.col("input") if "input" in rows.columns else F.lit(None).cast("string")


class AnswerStore:
    """Answers that cost money or time, by the digest of all that was asked.

    A question's key is the digest of model, prompt and body: other words are another question, and
    the same words are asked once, however often they come. Questions are put in batches of about
    `batch`, and each batch's answers are written when it ends, so that a run that breaks off loses at
    most one batch. An empty answer is an answer; a failed call is put again next time.
    """

    _ANSWER = "answer_key string, response string, input_tokens bigint, output_tokens bigint, error string, at timestamp"

    def __init__(self, spark: SparkSession, path: str, model: str = "", batch: int = 5_000):
        self.spark, self.path, self.model, self.batch = spark, path, model, batch

    def answers(self) -> DataFrame:
        """(answer_key, response, input_tokens, output_tokens, error): the last good answer of each question, else the last error."""
        if not names_in(self.spark, f"{self.path}/answers"):
            return self.spark.createDataFrame([], self._ANSWER).drop("at")
        rows = self.spark.read.schema(self._ANSWER).parquet(f"{self.path}/answers/*")
        rest = ("response", "input_tokens", "output_tokens", "error")
        return rows.groupBy("answer_key").agg(F.max_by(F.struct(*rest), F.struct(F.col("error").isNull(), "at")).alias("__a")).select("answer_key", "__a.*")

    def ask(self, questions: DataFrame, keys: Sequence[str], prompt: str, body: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(keys, response, input_tokens, output_tokens, error) for questions (keys, body).

        call gets rows (answer_key, body) and answers with (answer_key, response, input_tokens,
        output_tokens, error).
        """
        run = uuid.uuid4().hex
        name = F.sha2(F.concat_ws("\x00", F.lit(self.model), F.lit(prompt), F.col(body)), 256)
        questions.select(*keys, F.col(body).alias("body"), name.alias("answer_key")).write.parquet(f"{self.path}/questions/{run}")
        asked = self.spark.read.parquet(f"{self.path}/questions/{run}")
        known = self.answers().where("error is null").select("answer_key")
        todo = asked.groupBy("answer_key").agg(F.first("body").alias("body")).join(known, "answer_key", "left_anti")
        parts = max(1, -(-asked.count() // self.batch))
        todo.withColumn("part", F.pmod(F.xxhash64("answer_key"), F.lit(parts))).write.partitionBy("part").parquet(f"{self.path}/todo/{run}")
        for part in (n for n in names_in(self.spark, f"{self.path}/todo/{run}") if n.startswith("part=")):
            rows = self.spark.read.parquet(f"{self.path}/todo/{run}/{part}")
            call(rows.select("answer_key", "body")).withColumn("at", F.current_timestamp()).write.parquet(f"{self.path}/answers/{run}-{part.removeprefix('part=')}")
        delete(self.spark, f"{self.path}/todo/{run}")
        return asked.select(*keys, "answer_key").join(self.answers(), "answer_key").drop("answer_key")

    def compact(self) -> None:
        """One answer a question in a few files; superseded rows go, and so do the questions of earlier runs."""
        before = names_in(self.spark, f"{self.path}/answers")
        if not before:
            return
        self.answers().withColumn("at", F.current_timestamp()).write.parquet(f"{self.path}/answers/whole-{uuid.uuid4().hex}")
        for name in before:  # until they are gone, rows stand twice, which changes nothing
            delete(self.spark, f"{self.path}/answers/{name}")
        delete(self.spark, f"{self.path}/questions")
