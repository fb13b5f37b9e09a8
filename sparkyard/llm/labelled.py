"""Bounded samples of labelled rows, and held-out folds by crc32 of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null: the empty text)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds).cast("int")


def sample(labels: DataFrame, label: str, learn: Column, per_class: tuple[int, int], id_col: str = "doc_id") -> tuple[DataFrame, list[float]]:
    """(id, y, part) of at most per_class[y] labelled ids of each class, and how many rows each stands for.

    Only ids for which `learn` holds. An id with several labels counts once, by their mean; null
    ids and labels are left out. The ids with the smallest digests are taken, so the sample is a
    function of the table. part (0 to 3) splits it for fitting (1 to 3) and calibration (0).
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn)
    rows = rows.groupBy(id_col).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    rows = rows.select(id_col, "y", F.xxhash64(id_col).alias("d"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    taken = [rows.where(F.col("y") == y).orderBy("d", id_col).limit(per_class[y]) for y in (0, 1)]
    chosen = taken[0].union(taken[1]).select(id_col, "y", F.pmod(F.col("d"), F.lit(4)).cast("int").alias("part"))
    return chosen, [counts.get(y, 0) / max(1, min(per_class[y], counts.get(y, 0))) for y in (0, 1)]


def with_texts(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, part, d, text) of the sampled ids, a row each: of an id's several texts that with the least digest.

    chosen is bounded by its per_class, so it is broadcast. d is the digest that ids are taken by.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id")
    return rows.groupBy("id", "y", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "part", F.xxhash64("id").alias("d"), "text")


def within_bytes(rows: DataFrame, stands_for: list[float], most_bytes: int) -> tuple[DataFrame, list[float]]:
    """The rows of with_texts, by digest, whose texts come to at most most_bytes / 2 a class, and how many each stands for.

    Only digests and sizes of the sample reach the driver. A class keeps one text at least, if that fits most_bytes.
    """
    sizes = sorted((r.d, r.y, r.n) for r in rows.select("d", "y", F.octet_length("text").alias("n")).collect())
    out, weights = None, list(stands_for)
    for y in (0, 1):
        own, held, last, kept = [(d, n) for d, k, n in sizes if k == y], 0, None, 0
        for d, n in own:
            held += n
            if held > (most_bytes / 2 if kept else most_bytes):
                break
            last, kept = d, kept + 1
        if kept < len(own):
            weights[y] *= len(own) / max(1, kept)
        part = rows.where((F.col("y") == y) & (F.col("d") <= F.lit(last).cast("bigint")))
        out = part if out is None else out.union(part)
    return out, weights
