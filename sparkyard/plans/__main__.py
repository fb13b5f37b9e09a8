"""Command line: python -m sparkyard.plans COMMAND ...

run       stage documents of a folder (transcript_<id>.json, ocr_results_<id>.json, video_info_<id>.json) to
          lots_<id>.json, metadata_<id>.json and result_<id>.json, and a batch report where there are several URLs
extract   the same as far as the lots
batch     lots and metadata documents of a folder to a batch report (JSON and markdown)
evaluate  lots documents of a folder against reference lots; with --models, those of folders of several models

Answers come from a model (--call), from recorded ones (--responses, JSON lines), or else from the overlay
extractor. A video that fails is told with its reason, and the others go on; the exit code is 1 then.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard import schemas
from sparkyard.operators import evaluation, reports, summaries
from sparkyard.sources import readers, writers

from . import auctions, endpoint, providers, runs


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkyard", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    default = auctions.Settings
    for name in ("run", "extract", "batch", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("folder", help="folder of stage documents")
        c.add_argument("output", help="folder to write to")
        if name in ("run", "extract"):
            c.add_argument("--window-size", type=int, default=default.window_size)
            c.add_argument("--overlap", type=int, default=default.overlap)
            c.add_argument("--provider", choices=sorted(providers.DEFAULT_MODELS), default=default.provider, help="who is called, or whose answers the recorded ones are")
            c.add_argument("--transcriber", choices=providers.ASR_BACKENDS, default=default.transcriber)
            c.add_argument("--screenshot-interval", type=int, default=default.frame_interval)
            c.add_argument("--ocr-video-height", type=int, choices=(480, 720), default=default.video_height)
            c.add_argument("--confidence", type=float, default=default.confidence)
            c.add_argument("--responses", help="recorded answers, JSON lines")
            c.add_argument("--verdicts", help="recorded verdicts, JSON lines")
            c.add_argument("--facts", help="recorded metadata answers, JSON lines")
            c.add_argument("--call", action="store_true", help="call the provider's model; its key is read from the environment of the workers")
            c.add_argument("--model", help="instead of the provider's default model")
            c.add_argument("--endpoint", help="instead of the provider's address")
            c.add_argument("--prompt", help="file with the extraction prompt")
            c.add_argument("--verify-prompt", help="file with the prompt that re-examines outliers")
            c.add_argument("--metadata-prompt", help="file with the metadata prompt")
            c.add_argument("--in-order", action=argparse.BooleanOptionalAction, default=True, help="windows of a video one after another, each told the lots before it")
            c.add_argument("--no-resume", action="store_true", help="make results anew that are there already")
        if name in ("run", "extract", "batch"):
            c.add_argument("urls", nargs="*")
            c.add_argument("--batch-file")
            c.add_argument("--lookup", help="JSON lines of url and video_id, for URLs that hold no id")
            c.add_argument("--batch-name")
            c.add_argument("--stop-on-error", action="store_true")
        if name == "run":
            for what in ("metadata", "summary", "table"):
                c.add_argument(f"--show-{what}", action=argparse.BooleanOptionalAction, default=what != "table")
        if name == "evaluate":
            c.add_argument("reference", help="folder of reference lots")
            c.add_argument("--models", nargs="+", help="folders of models under the folder, each with its lots")
            c.add_argument("--runs", help="JSON lines of runs: video_id, model, status, elapsed_seconds, lot_count, llm_calls, input_tokens, output_tokens")
            c.add_argument("--prices", help="JSON lines of model, input_price, output_price by a million tokens")
    return p


def _provider(spark: SparkSession, a: argparse.Namespace) -> providers.Provider:
    if a.call:
        read = lambda path: readers.prompt(spark, path) if path else None
        said = endpoint.endpoint(a.provider, a.model, a.endpoint)
        return providers.Called(said, read(a.prompt) or "", read(a.verify_prompt), read(a.metadata_prompt), a.in_order, f"{a.output}/_stages/answers", said.model)
    if a.responses is None and a.facts is None:
        return providers.Overlay()
    table = lambda path, schema: spark.read.schema(schema).json(path) if path else None
    responses = table(a.responses, schemas.RESPONSES) if a.responses else spark.createDataFrame([], schemas.RESPONSES)
    return providers.Recorded(responses, table(a.verdicts, schemas.VERDICTS), table(a.facts, "video_id string, response string"))


def _urls(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """(ordinal, url, video_id) of the URLs given; None without any."""
    if not a.urls and not a.batch_file:
        return None
    listed = readers.batch_urls(spark, a.urls, a.batch_file)
    return runs.resolved(spark, listed, spark.read.schema("url string, video_id string").json(a.lookup) if a.lookup else None)


def _told(failures: DataFrame) -> int:
    """Print what failed; the exit code."""
    failed = failures.orderBy("ordinal").collect()  # a row a URL at most
    for r in failed:
        print(f"failed ({r.ordinal}): {r.error}", file=sys.stderr)
    return int(bool(failed))


def _report(spark: SparkSession, outcome: runs.Outcome, path: str, name: str | None, settings: auctions.Settings) -> DataFrame:
    """Write the report of a batch, show its views and return it."""
    folder = spark.range(1).select(reports.report_folder(name, path)).first()[0]
    report, text = outcome.report(folder.rsplit("/", 1)[1], settings)
    with auctions.stage(spark, "Write the batch report"):
        writers.write_report(report, text, folder)
    print(f"report: {folder}")
    # shown as it was written
    kept = spark.read.text(f"{folder}/batch_summary").select(F.from_json("value", report.schema).alias("r")).select("r.*")
    items = kept.select(F.inline("items"))
    reports.batch_view(items).show(truncate=False)
    top = kept.select("top_price_categories").first()[0]
    if top:
        reports.price_view(items.withColumn("category_prices", F.map_from_entries("category_prices")), top).show(truncate=False)
    return kept


def evaluate(spark: SparkSession, folder: str, reference: str, output: str, models: list[str] | None = None, runs_: DataFrame | None = None, prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """Views of the evaluation, each also written under output: agreement by video (and model), and with models
    price statistics, the outcome of every run, totals with costs, and measures side by side.

    Of lots with one number the last counts. Lots that can't be read are left out, and named in `unreadable`.
    """
    wanted = readers.checked_lots(readers.stage_documents(spark, reference, "lots"))
    if models is None:
        found = readers.checked_lots(readers.stage_documents(spark, folder, "lots"))
        views = {"evaluation": evaluation.agreement(wanted.rows, found.rows, ["video_id", "lot_number"], ["video_id"], order="pos"), "unreadable": found.failures.union(wanted.failures)}
    else:
        lots, unreadable = runs.models(spark, folder, models)
        names = spark.createDataFrame([(m,) for m in models], "model string")
        expected = wanted.rows.crossJoin(F.broadcast(names))  # the reference once a model: a list of names
        agreed = evaluation.agreement(expected, lots.join(wanted.rows.select("video_id").distinct(), "video_id", "left_semi"), ["video_id", "model", "lot_number"], ["video_id", "model"], order="pos")
        sources = lots.unionByName(wanted.rows.withColumn("model", F.lit("reference")))
        views = {"evaluation": agreed, "prices": summaries.price_statistics(sources, ["model", "video_id"]), "unreadable": unreadable.unionByName(wanted.failures.withColumn("model", F.lit("reference")))}
        overall = agreed.groupBy("model").agg(F.avg("coverage").alias("coverage"), F.avg("category_match").alias("category_match"), F.avg("sex_match").alias("sex_match"), F.avg("qty_match").alias("qty_match"), F.avg("mape").alias("mape"))
        if runs_ is not None:
            videos = runs_.select("video_id").distinct()
            views["runs"] = evaluation.grid(videos, names, runs_, ["video_id", "model"])
            if prices is not None:
                total = evaluation.totals(runs_, prices, videos.count())
                views["totals"] = total
                overall = overall.join(total, "model", "left")
        views["side_by_side"] = evaluation.by_metric(overall, "model", [c for c in overall.columns if c != "model"], models)
    for name, view in views.items():
        view.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{output}/{name}")
        views[name] = spark.read.schema(view.schema).json(f"{output}/{name}")
    return views


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    named = {"window_size": "window_size", "overlap": "overlap", "provider": "provider", "transcriber": "transcriber", "screenshot_interval": "frame_interval", "ocr_video_height": "video_height", "confidence": "confidence", "stop_on_error": "stop_on_error", "output": "output"}
    settings = auctions.Settings(**{to: getattr(a, of) for of, to in named.items() if hasattr(a, of)})
    spark = SparkSession.builder.appName(f"sparkyard {a.command}").getOrCreate()
    if a.command == "evaluate":
        read = lambda path, schema: spark.read.schema(schema).json(path) if path else None
        for name, view in evaluate(spark, a.folder, a.reference, a.output, a.models, read(a.runs, schemas.RUNS), read(a.prices, schemas.PRICES)).items():
            print(name)
            view.show(truncate=False)
        return 0
    urls = _urls(spark, a)
    if a.command == "batch":
        if urls is None:
            print("give at least one URL or --batch-file", file=sys.stderr)
            return 2
        outcome = runs.batch(spark, a.folder, urls, a.stop_on_error)
        _report(spark, outcome, a.output, a.batch_name, settings)
        return _told(outcome.failures)
    lots_only = a.command == "extract"
    outcome = runs.run(spark, a.folder, a.output, settings, _provider(spark, a), urls, not a.no_resume, lots_only)
    try:
        return _shown(spark, a, outcome, settings, lots_only)
    finally:
        outcome.release()


def _shown(spark: SparkSession, a: argparse.Namespace, outcome: runs.Outcome, settings: auctions.Settings, lots_only: bool) -> int:
    if lots_only:
        outcome.lots.groupBy("video_id").count().show(truncate=False)
        return _told(outcome.failures)
    if a.show_metadata:
        outcome.auctions.show(truncate=False)
    if a.show_summary:
        reports.summary_view(summaries.auction_summary(outcome.lots)).show(truncate=False)
    if a.show_table:
        reports.lots_view(outcome.lots).show(truncate=False)
    if a.batch_file or len(a.urls) > 1:
        _report(spark, outcome, a.output, a.batch_name, settings)
    return _told(outcome.failures)


if __name__ == "__main__":
    sys.exit(main())
