"""Providers: whatever answers prompts. The plans only see their answers as tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkyard import schemas
from sparkyard.operators import lots as L
from sparkyard.operators import parsing
from sparkyard.operators.timeline import confident_text
from sparkyard.session import names_in, ship
from sparkyard.sources.writers import AnswerStore

# Model of each provider when none is named.
DEFAULT_MODELS = {
    "openai": "gpt-4.1-mini",
    "openrouter": "google/gemini-2.5-flash-lite-preview-09-2025",
}


def default_model(provider: str) -> str:
    try:
        return DEFAULT_MODELS[provider]
    except KeyError:
        raise ValueError(f"unknown provider: {provider}") from None


class Provider(Protocol):
    def extract(self, windows: DataFrame) -> DataFrame:
        """(video_id, window_idx, response, input_tokens, output_tokens, error) for windows."""

    def verify(self, packets: DataFrame) -> DataFrame | None:
        """(video_id, lot_number, response) for evidence packets; None: no verification."""

    def metadata(self, contexts: DataFrame) -> DataFrame:
        """(video_id, response) for contexts (video_id, context); a null response: nothing is known."""


def _nothing_known(contexts: DataFrame) -> DataFrame:
    return contexts.select("video_id", F.lit(None).cast("string").alias("response"))


@dataclass
class Recorded:
    """Answers that are there already."""

    responses: DataFrame
    verdicts: DataFrame | None = None
    facts: DataFrame | None = None

    def metadata(self, contexts: DataFrame) -> DataFrame:
        if self.facts is None:
            return _nothing_known(contexts)
        return contexts.select("video_id").join(self.facts.select("video_id", "response"), "video_id", "left")

    def extract(self, windows: DataFrame) -> DataFrame:
        return self.responses.join(windows.select("video_id", "window_idx"), ["video_id", "window_idx"], "left_semi")

    def verify(self, packets: DataFrame) -> DataFrame | None:
        return None if self.verdicts is None else self.verdicts.join(packets.select("video_id", "lot_number"), ["video_id", "lot_number"], "left_semi")


def with_retries(call: Callable[[str], str], retries: int = 3, first_wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """call, tried again after 5, 10 and 20 seconds where the error says 429."""

    def run(prompt: str) -> str:
        for k in range(retries + 1):
            try:
                return call(prompt)
            except Exception as e:
                if "429" not in str(e) or k == retries:
                    raise
                sleep(first_wait * 2**k)
        raise AssertionError("unreachable")

    return run


@dataclass
class Called:
    """Answers by a function from prompt to text, one call a question; an error becomes a row's error.

    The function returns the text, or the text and the tokens read and written. A window's question
    holds that window alone, so windows run in parallel; with `in_order` the windows of a video
    follow each other, and each question lists the lots found before. With `store`, a folder,
    answers are kept there by the digest of what was asked, and no question that has one is put again;
    without it a plan that reads answers more than once refuses to run. `batch`: questions whose
    answers are written together.
    """

    complete: Callable[[str], str | tuple[str, int, int]]
    extraction_prompt: str = ""
    verify_prompt: str | None = None
    metadata_prompt: str | None = None
    in_order: bool = False
    store: str | None = None
    model: str = ""
    batch: int = 5_000

    def _ask(self, questions: DataFrame, keys: list[str], prompt: str, body: str) -> DataFrame:
        """(keys, response, input_tokens, output_tokens, error); through the store, if there is one."""
        if self.store is None:
            return self._asked(questions, keys, prompt, body)
        store = AnswerStore(questions.sparkSession, self.store, self.model, self.batch)
        return store.ask(questions, keys, prompt, body, lambda rows: self._asked(rows, ["answer_key"], prompt, "body"))

    def _asked(self, rows: DataFrame, keys: list[str], prompt: str, body: str) -> DataFrame:
        ship(rows.sparkSession)
        complete = with_retries(self.complete)

        def answer(text: str) -> tuple:
            try:
                said = complete(f"{prompt}\n\n{text}")
            except Exception as e:
                return None, None, None, str(e)[:400]
            return (*said, None) if isinstance(said, tuple) else (said, None, None, None)

        def run(batches: Iterator) -> Iterator:
            for pdf in batches:
                if pdf.empty:
                    continue
                out = [answer(t) for t in pdf[body]]
                names = ("response", "input_tokens", "output_tokens", "error")
                yield pdf[keys].assign(**{n: pd_column(c, n) for n, c in zip(names, zip(*out, strict=True), strict=True)})

        def pd_column(values: tuple, name: str):
            import pandas as pd

            return pd.Series(values, dtype="Int64" if name.endswith("tokens") else "object").values

        kept = rows.select(*keys, body)
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
        return kept.mapInPandas(run, f"{types}, response string, input_tokens bigint, output_tokens bigint, error string")

    def extract(self, windows: DataFrame) -> DataFrame:
        keys = ["video_id", "window_idx"]
        ask = lambda rows: self._ask(rows, keys, self.extraction_prompt, "body")
        if not self.in_order:
            return ask(windows.select(*keys, segment_question().alias("body")))
        if self.store is None:
            raise ValueError("windows in order need a store for their answers")
        return in_order(windows, ask, f"{self.store}/in_order/{uuid.uuid4().hex}")

    def verify(self, packets: DataFrame) -> DataFrame | None:
        if self.verify_prompt is None:
            return None
        return self._ask(packets, ["video_id", "lot_number"], self.verify_prompt, "packet").select("video_id", "lot_number", "response")

    def metadata(self, contexts: DataFrame) -> DataFrame:
        """One call a video; a failed one knows nothing."""
        if self.metadata_prompt is None:
            return _nothing_known(contexts)
        return self._ask(contexts, ["video_id"], self.metadata_prompt, "context").select("video_id", "response")


# The wording of a window's question.
PRIOR_LOTS, NO_PRIOR_LOTS, SEGMENT = "Lotes já encontrados (não repetir): ", "nenhum ainda", "Segmento ["


def segment_question() -> Column:
    """What is asked of a window, by its label and text."""
    return F.concat(F.lit(SEGMENT), "label", F.lit("]:\n\n"), "combined_text")


def prior_question(prior: Column) -> Column:
    """What a window's question says of the lots found before it: an ascending array of numbers, null or empty for none."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(prior, lambda n: n.cast("string")), ", "), F.lit("]"))
    return F.concat(F.lit(PRIOR_LOTS), F.when(F.size(prior) > 0, listed).otherwise(NO_PRIOR_LOTS))


def in_order(windows: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(video_id, window_idx, response, input_tokens, output_tokens, error): each window's question tells the lots found before it.

    All videos go through their windows side by side: round i asks window i of each, reads the
    answers by the same rules as the extraction, and adds the lots that the burst guard lets through
    to what later windows are told. A failed call adds nothing. ask gets (video_id, window_idx, body);
    where it keeps answers by their question, a second run after a failure repeats the rounds
    without asking, up to the first window whose question has changed or has no answer. Each round's
    answers and lots are written under folder, so plans stay short.
    """
    spark = windows.sparkSession
    cut = windows.select("video_id", "window_idx", "label", "combined_text")
    cut.write.partitionBy("window_idx").parquet(f"{folder}/windows")
    kept = spark.createDataFrame([], "video_id string, lot_number bigint")
    rounds = sorted(int(n.removeprefix("window_idx=")) for n in names_in(spark, f"{folder}/windows") if n.startswith("window_idx="))
    for i in rounds:
        here = spark.read.schema("video_id string, label string, combined_text string").parquet(f"{folder}/windows/window_idx={i}").withColumn("window_idx", F.lit(i))
        told = kept.groupBy("video_id").agg(F.sort_array(F.collect_set("lot_number")).alias("prior"))  # the lots of one video
        asked = here.join(told, "video_id", "left")
        body = F.concat(prior_question(F.col("prior")), F.lit("\n\n"), segment_question())
        ask(asked.select("video_id", "window_idx", body.alias("body"))).write.parquet(f"{folder}/answers/round={i}")
        answers = spark.read.parquet(f"{folder}/answers/round={i}")
        valid = parsing.valid(parsing.read_lots(answers.select("video_id", "window_idx", "response")))
        known = kept.withColumn("known", F.lit(True))
        found = L.with_support(valid, here).join(known, ["video_id", "lot_number"], "left")
        crowded = F.count("*").over(Window.partitionBy("video_id")) > L.BURST
        through = found.withColumn("crowded", crowded).where(~F.col("crowded") | F.col("supported") | F.col("known"))
        through.where("known is null").select("video_id", "lot_number").distinct().write.parquet(f"{folder}/lots/round={i}")
        kept = spark.read.parquet(f"{folder}/lots/*")
    if not rounds:
        return spark.createDataFrame([], schemas.RESPONSES)
    return spark.read.schema(schemas.RESPONSES).parquet(f"{folder}/answers/*")


#: LOTE | farm | VALORPORANIMAL | lot | R$ | price | NCATEGORY-AGEM-BREED
_OVERLAY = r"LOTE \| ([^|\n]*) \| VALORPORANIMAL \| 0*([0-9]+) \| R\$ \| ([0-9.,]+) \| ([0-9]+)([A-ZÇÃÊÉÍÓ ]+?)-([0-9]+)M-([^|\n]+)"


@dataclass
class Overlay:
    """An offline extractor of our own: reads the on-screen overlay, so plans run without any model."""

    def extract(self, windows: DataFrame) -> DataFrame:
        groups = [F.regexp_extract_all("combined_text", F.lit(_OVERLAY), F.lit(i)) for i in range(1, 8)]
        at = lambda a, i: F.get(a, i)
        female = lambda c: F.when(F.rlike(F.lower(c), F.lit("^(bezerra|novilha|vaca)")), "fêmea").otherwise("macho")
        lot = lambda i: F.struct(
            at(groups[1], i).cast("bigint").alias("lot_number"),
            female(at(groups[4], i)).alias("sex"),
            F.lower(at(groups[4], i)).alias("category"),
            at(groups[3], i).cast("bigint").alias("num_animals"),
            F.trim(at(groups[6], i)).alias("breed"),
            at(groups[5], i).cast("bigint").alias("age_months"),
            at(groups[2], i).alias("unit_price"),
        )
        found = F.transform(F.when(F.size(groups[1]) > 0, F.sequence(F.lit(0), F.size(groups[1]) - 1)).otherwise(F.array().cast("array<int>")), lot)
        zero = F.lit(0).cast("bigint")
        return windows.select("video_id", "window_idx", F.to_json(found).alias("response"), zero.alias("input_tokens"), zero.alias("output_tokens"), F.lit(None).cast("string").alias("error"))

    def verify(self, packets: DataFrame) -> DataFrame | None:
        return None

    def metadata(self, contexts: DataFrame) -> DataFrame:
        return _nothing_known(contexts)


def screen_text(frames: DataFrame, detect: Callable[[bytes], list[tuple[str, float]]], least: float = 0.4) -> DataFrame:
    """(video_id, ocr_idx, ts, tokens) of frames (video_id, frame_idx, ts, content); no image: no tokens."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            found = [[{"text": t, "confidence": float(c)} for t, c in detect(x)] if x is not None else [] for x in pdf["content"]]
            yield pdf[["video_id", "frame_idx", "ts"]].assign(detections=found)

    schema = "video_id string, frame_idx int, ts string, detections array<struct<text:string,confidence:double>>"
    read = frames.select("video_id", "frame_idx", "ts", "content").mapInPandas(run, schema)
    return read.select("video_id", F.col("frame_idx").alias("ocr_idx"), "ts", confident_text("detections", least).alias("tokens"))


ASR_BACKENDS = ("mlx", "cpp", "groq")


def transcript(rows: DataFrame, backend: str) -> DataFrame:
    """Segments from a backend's own rows, trimmed, in seconds; an unknown backend is an error."""
    from sparkyard.functions.scalars import comma_seconds
    from sparkyard.operators.timeline import shift_chunks, whole_segments

    if backend == "mlx":
        return whole_segments(rows, "start", "end", "text", "idx")
    if backend == "cpp":
        return whole_segments(rows, comma_seconds("from"), comma_seconds("to"), "text", "idx")
    if backend == "groq":
        from pyspark.sql import Window

        numbered = shift_chunks(rows, "chunk_idx").withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("chunk_idx", "idx")) - 1)
        return whole_segments(numbered, "start", "end", "text", "n")
    raise ValueError(f"unknown backend: {backend}; known: {', '.join(ASR_BACKENDS)}")


