"""A training-data pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents, further ones of the input included. In all stages null texts count
as empty and stay null, whole texts count, however long, null ids stay, repeated rows are treated
alike (near duplicates keep one), and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkyard.llm import byte_bpe, decontamination, near_duplicates, pii, quality
from sparkyard.llm.common import delete, filter_texts, replace_texts, shared_folder, table
from sparkyard.llm.labelled import fold


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the folds that op10 learns from.

    Without a usable label every document scores 0.5 and stays.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return filter_texts(docs, lambda texts: model.score(texts) >= 0.3)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more in five-word shingles: that of the smallest id.

    Texts without words are one group. Ties of one id go by the text's digest.
    """
    return near_duplicates.drop_near_duplicates(docs, width=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget; an empty benchmark removes none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    model = pii.fit_pii()
    out = replace_texts(docs, lambda t: pii.redacted(t, pii.all_spans(t, model)[1]))
    if "n_chars" not in docs.columns:
        return out
    from pyspark.sql import functions as F

    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers as P

    return byte_bpe.bpe_digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("simhash_near_dedup", near_deduplicated),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("byte_bpe", encoded),
]

#: Classifiers, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written as Parquet to the shared folder and read again.

    A stage's folder goes when the next one has been written; the last one stays for the result.
    """
    import uuid

    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
