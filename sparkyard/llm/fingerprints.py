"""Document fingerprints: canonical exact digests, in DataFrame operations only.

The canonical form of a text is its Unicode NFC with full case folding, composed again, and with
runs of white space folded to a space (none at the ends). Its digest is two XXH64 of 64 bits
each and the canonical length. Rows of equal digest form a bucket; the canonical bytes inside a
bucket are compared by grouping on them, and texts that differ in spite of an equal digest get
distinct fingerprints by a number behind the digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, cuts_below, known_array, small_batches

#: Buckets of neighbouring ids, a task each, in which the next document is looked up: at least, and one more for
#: so many rows, up to MOST_BUCKETS.
BUCKETS, ROWS_A_BUCKET, MOST_BUCKETS = 32, 2_000, 20_000
_LARGEST = (1 << 63) - 1


def _fold(c: Column, compatible: bool) -> Column:
    """NFC (or NFKC) of the case-folded text, by the ICU library that Spark ships with."""
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(compatible))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(c), F.lit(True)))
    # ASCII is its own normal form, and lower() is its case folding
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(folded)


def canonical(c: Column, compatible: bool = False) -> Column:
    """The canonical form; null counts as empty."""
    folded = _fold(F.coalesce(c, F.lit("")), compatible)
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}\x1C-\x1F]+", " "))


def wide_digest(form: Column) -> Column:
    """128 bits of XXH64 over the canonical form and over its length and itself, and the length."""
    hex16 = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    size = F.octet_length(form)
    return F.concat(hex16(F.xxhash64(form)), hex16(F.xxhash64(F.lit("second"), size, form)), F.lit("-"), F.lower(F.hex(size.cast("bigint"))))


def _with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text) with `after`: the text of the next row by descending id, after the last the first.

    Ids are dealt to buckets at quantiles of all ids; each bucket also gets the rows that come
    next after it, so that every row finds its successor inside its bucket. One shuffle.
    """
    order_id = F.coalesce(F.col("id"), F.lit(-(1 << 63)))  # null: after all others
    docs = docs.select("*", order_id.alias("o"))
    wanted = min(MOST_BUCKETS, max(BUCKETS, docs.count() // ROWS_A_BUCKET))
    cuts = docs.select("o").agg(F.percentile_approx("o", known_array([i / wanted for i in range(1, wanted)], "double"), 10 * wanted)).first()[0]
    cuts = sorted(set(cuts or []))
    bucket = cuts_below(F.col("o"), cuts)
    tops = dict(docs.select(bucket.alias("b"), "o").groupBy("b").agg(F.max("o")).collect())  # a row a bucket
    if not tops:
        return docs.select("*", F.lit("").alias("after"), F.lit(0).alias("b"))
    used = sorted(tops)
    # the row with the top id of bucket b also closes the next bucket above; the very top one closes the lowest
    closes = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    of = lambda m: F.element_at(known_array([m.get(i, -1) for i in range(len(cuts) + 1)], "bigint"), F.col("b") + 1)
    rows = docs.withColumn("b", bucket)
    here = F.struct(F.col("b").cast("bigint").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(of(closes).alias("b"), F.lit(True).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("o") == of(tops), F.array(here, guest)).otherwise(F.array(here)))).drop("b").select("*", "to.b", "to.guest").drop("to")
    rows = rows.repartition(len(cuts) + 1, "b")
    order = Window.partitionBy("b").orderBy("guest", F.desc("o"), F.desc(F.xxhash64("text")), F.desc("text"))
    return rows.withColumn("after", F.lead("text").over(order)).where(~F.col("guest"))


def _tag(form: Column) -> Column:
    """A second, independent digest that names a form inside its bucket."""
    return F.unhex(F.sha2(form, 256))


def fingerprints(docs: DataFrame, compatible: bool = False, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep and `fingerprint` for every row: equal exactly where canonical texts are equal.

    Null texts count as empty, and whole texts count, however long. Ties and repeated rows share a
    fingerprint. Other columns of docs, clashing names among them, are not read; an empty table
    gives no rows.
    """
    rows = docs.select(*keep, canonical(F.col(text), compatible).alias("__form"))
    forms = docs.select(canonical(F.col(text), compatible).alias("form"))
    found = rows.select(*keep, wide_digest(F.col("__form")).alias("fingerprint"), _tag(F.col("__form")).alias("__tag"))
    return _told_apart(found, _collisions(forms), {"fingerprint": "__tag"}).drop("__tag")


def _collisions(forms: DataFrame, digest: Callable[[Column], Column] = wide_digest, others: DataFrame | None = None) -> DataFrame:
    """(digest, tag, number): the forms whose bytes differ from another's of equal digest.

    Grouping on digest and form compares bytes; copies meet in the partial aggregation, so that a
    group of any size costs a row a task. With 128 bits there is as good as never a row. others:
    (digest, tag) of further forms, told apart by their tags.
    """
    classes = forms.select(digest(F.col("form")).alias("digest"), "form").groupBy("digest", "form").agg(F.count("*").alias("n"))
    tagged = classes.select("digest", _tag(F.col("form")).alias("tag"))
    if others is not None:
        tagged = tagged.unionByName(others)
    several = tagged.groupBy("digest").agg(F.collect_set("tag").alias("tags")).where(F.size("tags") > 1)
    return several.select("digest", F.posexplode(F.sort_array("tags")).alias("number", "tag"))


def _told_apart(rows: DataFrame, collisions: DataFrame, tags: dict[str, str]) -> DataFrame:
    """rows with a number behind the fingerprints whose bucket holds other bytes; tags: column of each fingerprint's tag."""
    twice = checkpointed(collisions)
    if twice.isEmpty():
        return rows
    names = rows.columns
    for name, tag in tags.items():
        rows = rows.join(twice, (rows[name] == twice["digest"]) & (rows[tag] == twice["tag"]), "left")
        number = F.coalesce("number", F.lit(0))
        marked = F.when(number == 0, F.col(name)).otherwise(F.concat(name, F.lit("~"), number.cast("string")))
        rows = rows.withColumn(name, marked).select(*names)
    return rows


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = wide_digest) -> DataFrame:
    """For every row: n_chars, the fingerprint, that of the edited text, and what they share.

    The edited text ends in the start of the next text (descending id) instead of its own last
    half. near_edited and near_next are 1 where the canonical bytes are equal, else 0. Fingerprints
    of both kinds are equal exactly where canonical texts are. Whole texts count, however long. Ids
    are integers, or text that reads as one. Rows of equal id are taken by descending text digest;
    null ids come last; a single row is its own next one; an empty table gives no rows; other
    columns, clashing names among them, are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with_next(rows)
    rows = rows.select(
        "id",
        "text",
        "after",
        F.length("text").cast("bigint").alias("n_chars"),
        F.expr("concat(left(text, length(text) - int(length(text) div 2)), left(after, int(length(text) div 2)))").alias("edited"),
    )
    rows = rows.select("*", canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), canonical(F.col("after")).alias("after_form"))
    found = checkpointed(
        rows.select(
            F.col("id").alias(id_col),
            "n_chars",
            F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
            digest(F.col("form")).alias("fingerprint"),
            digest(F.col("edited_form")).alias("edited_fingerprint"),
            (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"),
            (F.col("form") == F.col("after_form")).cast("double").alias("near_next"),
            _tag(F.col("form")).alias("__tag"),
            _tag(F.col("edited_form")).alias("__edited_tag"),
        )
    )
    edited = found.select(F.col("edited_fingerprint").alias("digest"), F.col("__edited_tag").alias("tag"))
    collisions = _collisions(docs.select(canonical(F.col(text)).alias("form")), digest, edited)
    told = _told_apart(found, collisions, {"fingerprint": "__tag", "edited_fingerprint": "__edited_tag"})
    return told.withColumn("edited_sha256", F.lower(F.hex("edited_sha256"))).drop("__tag", "__edited_tag")
