"""Evaluation runs: every model over all videos, several at a time, each failure on its own."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions.scalars import model_folder
from sparkyard.session import delete, hadoop_path

RUN = "model string, status string, error string, elapsed_seconds double"

#: Rows of a run that has not ended; readers pass over names that begin with _.
_STAGED = "_run-"


def _place(spark: SparkSession, source: str, target: str) -> None:
    """Put a run's folder in the place of the model's earlier one."""
    delete(spark, target)
    fs, p = hadoop_path(spark, source)
    if not fs.rename(p, hadoop_path(spark, target)[1]):
        raise OSError(f"could not put the rows in {target}")


def run_all(
    spark: SparkSession,
    runs: Mapping[str, Callable[[SparkSession], DataFrame]],
    path: str,
    parallel: int = 4,
    timeout: float = 1800.0,
    settings: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """(model, status, error, elapsed_seconds); each run's rows go to a folder of the model's under path.

    Runs are few and named; their rows stay distributed. Each gets a session of its own, with the
    `settings` of its model, temporary views and functions of its own, so that what a run sets
    changes no other. Its jobs bear a tag and share a scheduler pool of the run's name, which a cluster
    with spark.scheduler.mode=FAIR serves side by side. A run that fails or takes longer than `timeout`
    seconds ends alone: its jobs are cancelled, its rows never come under path, and what an earlier
    run has left there stays. A run that goes on after its time, in code that is no Spark job, finds
    its place taken and leaves nothing.
    """
    context = spark.sparkContext

    def one(model: str) -> tuple:
        tag, began, problem, lock = f"run-{uuid.uuid4().hex}", time.monotonic(), [], threading.Lock()
        staged, ended = f"{path}/{_STAGED}{tag}", threading.Event()

        def work() -> None:
            try:
                own = spark.newSession()
                for key, value in (settings or {}).get(model, {}).items():
                    own.conf.set(key, value)
                context.addJobTag(tag)
                context.setInterruptOnCancel(True)
                context.setLocalProperty("spark.scheduler.pool", f"run of {model}")
                context.setJobDescription(f"run of {model}")
                folder = own.range(1).select(model_folder(F.lit(model))).first()[0]
                runs[model](own).write.parquet(staged)
                with lock:
                    if not ended.is_set():
                        _place(own, staged, f"{path}/model_dir={folder}")
                        ended.set()
            except Exception as e:
                problem.append(str(e)[:400])
            finally:
                delete(spark, staged)

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(timeout)
        with lock:  # either its rows are in place by now, or they never will be
            late = thread.is_alive() and not ended.is_set()
            ended.set()
        if late:
            context.cancelJobsWithTag(tag)
            return model, "timeout", f"over {timeout:g} s", time.monotonic() - began
        thread.join()
        return model, "failed" if problem else "ok", problem[0] if problem else None, time.monotonic() - began

    with ThreadPoolExecutor(parallel) as pool:
        return spark.createDataFrame(list(pool.map(one, runs)), RUN)


def report(runs: DataFrame, lots: DataFrame, calls: DataFrame, videos: DataFrame) -> DataFrame:
    """Every (video, model) pair with its run's outcome, lots and calls; zeros where a run has left nothing."""
    from sparkyard.operators.evaluation import grid
    from sparkyard.operators.summaries import run_summary

    keys = ["video_id", "model"]
    pairs = grid(videos.select("video_id"), runs, run_summary(lots, calls, keys), keys)
    return pairs.na.fill(0, ["lot_count", "lots_with_price", "lots_without_price", "llm_calls", "input_tokens", "output_tokens"])
