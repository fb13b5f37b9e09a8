"""What the operators of this subpackage share: table access, Arrow plumbing, checkpoints."""

from __future__ import annotations

import gc
import json
import os
import re
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that an Arrow function works on at once; bounds a Python worker's memory.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Read and hand over rows in portions fit for long texts.

    The Parquet reader's default of 4096 rows makes arrays of tens of megabytes for columns of
    documents, which fragment an executor's heap; batches for Python are bounded by bytes too. These
    settings stay with the session, since plans run after the operators that make them return.
    """
    _ship(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))


def _ship(spark: SparkSession) -> None:
    """Send the package to the Python workers where neither PYTHONPATH nor the folder gives it to them."""
    root, sc = Path(__file__).parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root or root.name == "site-packages" or getattr(sc, "_sparkyard_shipped", False):
        return
    with_code = shutil.make_archive(f"{tempfile.mkdtemp(prefix='sparkyard-')}/sparkyard", "zip", root, "sparkyard")
    sc.addPyFile(with_code)
    sc._sparkyard_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, in a place of this session's own.

    A folder of our own is used only where the session names none and runs in one process, as in
    tests; a cluster that names none is an error, since its executors share no local folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkyard-"))
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def apart(totals: DataFrame, key: str) -> DataFrame:
    """totals, a row a key, dealt otherwise than by key: a join to it shuffles both sides, so that AQE can split a hot key's rows.

    Joined to an aggregation as it stands, the other side would share its shuffle, which is never split.
    """
    return totals.repartition(F.xxhash64(key))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's memory is collected, which may be long after their last use. The
    second round collects what the first one has let go, once Spark's cleaner has had a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of files that df reads, by the optimizer's estimate; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def known_array(values: list, element: str) -> Column:
    """An array of values as one expression, however long; the optimizer turns it into a constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{element}>")


def cuts_below(key: Column, cuts: list, element: str = "bigint") -> Column:
    """How many of the ascending cuts (of type element) are at or below key, by binary search."""
    if not cuts:
        return F.lit(0)
    n, known = len(cuts), known_array(cuts, element)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    at = lambda p: F.element_at(known, F.least(p, F.lit(n)))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (at(p + s) <= key), p + s).otherwise(p))


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of texts, each of at most limit UTF-8 bytes or a single text."""
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    keep: list[str],
    schema: T.StructType,
    work: Callable[[list[str]], dict[str, list]],
    text: str = "text",
) -> DataFrame:
    """Columns `keep` of df with the columns of `schema` that `work` makes from the whole texts.

    work gets texts in portions of about BATCH_BYTES (null: empty) and returns a list for each
    field of schema. Rows are neither added nor dropped; clashing names in `keep` lose to schema.
    """
    small_batches(df.sparkSession)
    keep = [c for c in keep if c not in schema.names]
    source = df.select(*keep, F.col(text).alias("__text"))
    out = T.StructType([*source.select(*keep).schema.fields, *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, b in by_bytes(texts):
                made = work(texts[a:b])
                arrow = arrow or arrow_types(schema)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], *(pa.array(made[f.name], arrow[f.name]) for f in schema.fields)],
                    names=[*keep, *schema.names],
                )

    return source.mapInArrow(run, out)


def _edit_batches(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, list[str | None], int], pa.RecordBatch]) -> DataFrame:
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in by_bytes([t or "" for t in texts]):
                yield work(batch.slice(a, b - a), texts[a:b], at)

    return df.mapInArrow(run, df.schema)


def filter_texts(df: DataFrame, good: Callable[[list[str]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of df whose whole texts (null: empty) `good` accepts, with all their columns."""
    return _edit_batches(df, text, lambda batch, texts, at: batch.filter(pa.array([bool(x) for x in good([t or "" for t in texts])])))


def replace_texts(df: DataFrame, new: Callable[[str], str], text: str = "text") -> DataFrame:
    """df with `new` applied to every whole text; null stays null."""

    def work(batch: pa.RecordBatch, texts: list[str | None], at: int) -> pa.RecordBatch:
        changed = pa.array([None if t is None else new(t) for t in texts], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*batch.columns[:at], changed, *batch.columns[at + 1 :]], schema=batch.schema)

    return _edit_batches(df, text, work)


def arrow_types(schema: T.StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema.fields}


def fields(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)
