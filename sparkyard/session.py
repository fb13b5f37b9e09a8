"""What any plan needs of its session: the package on the workers, folders wherever Spark can reach them."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers where neither PYTHONPATH nor the folder gives it to them."""
    root, context = Path(__file__).parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root or root.name == "site-packages" or getattr(context, "_package_sent", False):
        return
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='sparkyard-')}/sparkyard", "zip", root, "sparkyard"))
    context._package_sent = True


@contextmanager
def settings_for(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs inside, as they were before afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none without the folder."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Put a file in another's place in one step; False where the source is gone already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, p = hadoop_path(spark, source)
    if not fs.exists(p):
        return False
    if fs.getScheme() == "file":
        # without the checksum beside it, which would forbid other programs to change the file
        here, there = (jvm.org.apache.hadoop.fs.Path(x).toUri().getPath() for x in (source, target))
        Path(there).parent.joinpath(f".{Path(there).name}.crc").unlink(missing_ok=True)
        os.replace(here, there)
        return True
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(p, jvm.org.apache.hadoop.fs.Path(target), options)
    return True
