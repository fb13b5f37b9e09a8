"""Exact duplicates against a persistent index of digests, bucketed and sorted by digest.

The index is a table of files that Spark knows as bucketed: a lot of new data is reduced to one row
a digest, dealt to the index's buckets, and joined to it by sort-merge anti-join, for which the
index itself is not shuffled. What it does not know is appended. A lot's digests are written first,
so that a lot that is put in once more, after a crash too, changes nothing and gets the same answer.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: Distinct digests of a bucket when an index is made, and the number of its buckets.
ROWS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 8, 16_384
#: Digests that hold more than one in so many rows are sent to all tasks: there are fewer than HOT of them, of some 100 bytes.
HOT = 20_000


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest) of every row: SHA-256 of the text with every run of blanks (space, \\t to \\r) as one space; null: empty."""
    small_batches(docs.sparkSession)
    form = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(form, 256)).alias("digest"))


class DigestIndex:
    """An index under `path`, a folder that driver and executors share; made with its first lot.

    path/index holds a row a distinct text (digest, keep_id, lot, row), path/lots a row a document of
    each lot, path/groups a row a digest of each lot. A lot may be empty; ids are of one type.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _open(self, id_type: str, rows: int) -> None:
        """Make the index or tell this session of it; the number of buckets is the index's for good."""
        if not self._there("made/_SUCCESS"):
            buckets = self.buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, rows // ROWS_A_BUCKET))
            text = json.dumps({"buckets": buckets, "id": id_type})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/made")
        made = json.loads(self.spark.read.text(f"{self.path}/made").first()[0])
        self.buckets = made["buckets"]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {made['id']}, lot STRING, row BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/index'"
        )

    def entries(self) -> DataFrame:
        """(digest, keep_id, lot, row): the document of each text that stays."""
        if not self._there("made/_SUCCESS"):
            raise ValueError(f"no index at {self.path}")
        self._open("", 0)
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, lot: str, id_col: str = "doc_id", text: str = "text") -> None:
        """Put a lot of documents in; of texts that are new, the smallest id stays (null: after all others).

        Of rows with both in common one stays. Null texts count as empty, whole texts count, and other
        columns are not read.
        """
        self.add_digests(digests(docs, id_col, text), lot)

    def add_digests(self, rows: DataFrame, lot: str) -> None:
        """`add` for rows (id, digest)."""
        if not lot.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a lot's name is made of letters, digits, - and _")
        if not self._there(f"lots/{lot}/_SUCCESS"):
            rows.select(F.monotonically_increasing_id().alias("row"), "id", "digest").write.mode("overwrite").parquet(f"{self.path}/lots/{lot}")
        if not self._there(f"groups/{lot}/_SUCCESS"):
            least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
            groups = self.spark.read.parquet(f"{self.path}/lots/{lot}").groupBy("digest").agg(least, F.count("*").alias("n"))
            groups.select("digest", F.col("least.id").alias("id"), F.col("least.row").alias("row"), "n").write.mode("overwrite").parquet(f"{self.path}/groups/{lot}")
        groups = self.spark.read.parquet(f"{self.path}/groups/{lot}")
        self._open(groups.schema["id"].dataType.simpleString(), groups.count())
        self._fresh(groups, lot).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def _fresh(self, groups: DataFrame, lot: str) -> DataFrame:
        """What the index does not know, dealt to its buckets; the index is read where it lies."""
        dealt = groups.repartition(self.buckets, "digest").hint("merge")
        fresh = dealt.join(self.entries().select("digest"), "digest", "left_anti")
        return fresh.select("digest", F.col("id").alias("keep_id"), F.lit(lot).alias("lot"), "row")

    def placed(self, lots: Sequence[str]) -> DataFrame:
        """(id, digest, keep_id, group_size, kept) of every row of these lots; sizes count their rows.

        A text that holds a large share of all rows reaches its rows by broadcast, the others by a
        shuffle of ids and digests.
        """
        read = lambda of: [self.spark.read.parquet(f"{self.path}/{of}/{x}").withColumn("__lot", F.lit(x)) for x in lots]
        rows, groups = _union(read("lots")), _union(read("groups"))
        sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
        known = checkpointed(sizes.join(self.entries(), "digest"))
        total = known.agg(F.sum("group_size")).first()[0] or 0
        is_hot = F.col("group_size") * HOT > total
        hot = F.broadcast(known.where(is_hot))  # fewer than HOT rows: together they hold at most all of them
        rest = rows.join(hot.select("digest"), "digest", "left_anti").join(known.where(~is_hot).hint("merge"), "digest")
        found = rows.join(hot, "digest").unionByName(rest)
        kept = (F.col("lot") == F.col("__lot")) & (F.col("__row") == F.col("row"))
        return found.select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].withColumnRenamed("row", "__row")
    for p in parts[1:]:
        out = out.unionByName(p.withColumnRenamed("row", "__row"))
    return out


def dedup_in_lots(docs: DataFrame, path: str, lots: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`placed` for all of docs, put into an index at path in lots of ascending ids, as if they had come one after another.

    Ids are numbers. Null ids come in the last lot; an empty table gives no rows.
    """
    rows = checkpointed(digests(docs, id_col, text))
    cuts = rows.agg(F.percentile_approx("id", [i / lots for i in range(1, lots)], 10_000)).first()[0] or [] if lots > 1 else []
    index, names = DigestIndex(docs.sparkSession, path), []
    number = sum((F.when(F.col("id") <= c, 0).otherwise(1) for c in sorted(set(cuts))), F.lit(0))
    for i in range(len(set(cuts)) + 1):
        names.append(f"lot{i}")
        index.add_digests(rows.where(number == i), names[-1])
    return index.placed(names)
