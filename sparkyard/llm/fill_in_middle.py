"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders, and put in another order.

A unit is a run of ASCII letters or any other single character. Whether one begins at a character
depends on that character and the one before, so a text falls apart into chunks that overlap by one
character: each chunk's units are counted on their own, the counts' running sums tell which chunk
owns a cut, and only that chunk is scanned again for its place. Chunks of a portion of texts are
counted at once; those of very long texts are rows that all tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checkpointed, small_batches

#: Characters of a chunk.
CHUNK = 1 << 16
#: Bytes of a text whose chunks become rows of their own.
LONG = 4 << 20

_CUTS = "n bigint, first bigint, second bigint"


def _letters(points: np.ndarray) -> np.ndarray:
    return ((points | 32) - 97).astype(np.uint32) < 26


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _begins(points: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each character; before: the character in front of each (a blank at a text's start)."""
    return ~(_letters(points) & _letters(before))


def _cuts(texts: list[str], one: np.ndarray, two: np.ndarray, chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    """(units, characters before the first cut, before the second) of texts, cut behind one % (units + 1) and two % (units + 1) units."""
    points = _points("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(points)
    before[1:] = points[:-1]
    before[starts[sizes > 0]] = 32
    begins = _begins(points, before)
    # chunks of all texts one after another, and the units that begin in each
    pieces = -(-sizes // chunk)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * chunk
    counts = np.add.reduceat(begins, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    sums = np.append(0, np.cumsum(counts))
    units = sums[first + pieces] - sums[first]

    def place(i: int, rank: int) -> int:
        if rank == units[i]:
            return int(sizes[i])
        rank += int(sums[first[i]])
        c = int(np.searchsorted(sums, rank, "right")) - 1
        inside = np.flatnonzero(begins[at[c] : at[c] + chunk])
        return int(at[c] + inside[rank - sums[c]] - starts[i])

    ranks = np.sort(np.stack([one % (units + 1), two % (units + 1)]), axis=0)
    return [(int(units[i]), place(i, int(ranks[0, i])), place(i, int(ranks[1, i]))) for i in range(len(texts))]


def _cut_columns(text: Column, one: Column, two: Column) -> Column:
    @F.pandas_udf(_CUTS)
    def cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, a, b in parts:
            texts, a, b = t.tolist(), a.to_numpy(np.int64), b.to_numpy(np.int64)
            rows = [r for x, y in by_bytes(texts) for r in _cuts(texts[x:y], a[x:y], b[x:y])]
            yield pd.DataFrame(rows, columns=["n", "first", "second"], dtype="int64")

    return cuts(text, one, two)


def _long_cuts(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (__text, __1, __2, ...) of very long texts with __cut, their chunks counted as rows that all tasks share."""
    rows = checkpointed(rows.withColumn("__row", F.monotonically_increasing_id()))
    last = F.expr(f"(length(__text) - 1) div {chunk}")
    # a chunk and the character in front of it
    overlapped = lambda c: F.when(c == 0, F.concat(F.lit(" "), F.substring("__text", F.lit(1), F.lit(chunk)))).otherwise(F.substring("__text", c * chunk, F.lit(chunk + 1)))
    chunks = rows.select("__row", "__text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("c")).select("__row", "c", overlapped(F.col("c").cast("int")).alias("piece"))

    @F.pandas_udf("bigint")
    def units(pieces: pd.Series) -> pd.Series:
        return pd.Series([int(_begins(p[1:], p[:-1]).sum()) for p in map(_points, pieces)], dtype="int64")

    @F.pandas_udf("bigint")
    def place(pieces: pd.Series, ranks: pd.Series) -> pd.Series:
        found = []
        for t, r in zip(pieces, ranks, strict=True):
            p = _points(t)
            found.append(int(np.flatnonzero(_begins(p[1:], p[:-1]))[r]))
        return pd.Series(found, dtype="int64")

    dealt = chunks.repartition(F.col("__row"), F.col("c"))
    counted = dealt.select("__row", "c", units("piece").alias("k"))
    # a number a chunk: running sums are short lists beside their text
    listed = counted.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "k"))), lambda x: x["k"]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x)
    ranks = listed.join(rows.select("__row", "__1", "__2"), "__row").select("__row", "counts", total.alias("n"), "__1", "__2")
    a, b = F.col("__1") % (F.col("n") + 1), F.col("__2") % (F.col("n") + 1)
    ranks = ranks.select("__row", "counts", "n", F.posexplode(F.array(F.least(a, b), F.greatest(a, b))).alias("cut", "rank"))
    state = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("sum"), F.lit(False).alias("found"))
    owner = F.aggregate(
        "counts",
        state,
        lambda s, x: F.when(s["found"] | (s["sum"] + x > F.col("rank")), F.struct(s["c"].alias("c"), s["sum"].alias("sum"), F.lit(True).alias("found"))).otherwise(
            F.struct((s["c"] + 1).alias("c"), (s["sum"] + x).alias("sum"), F.lit(False).alias("found"))
        ),
    )
    owned = checkpointed(ranks.select("__row", "n", "cut", "rank", owner.alias("o")))
    scanned = owned.where("o.found").join(rows.select("__row", "__text"), "__row")
    scanned = scanned.select("__row", "cut", (F.col("o.c") * F.lit(chunk).cast("bigint") + place(overlapped(F.col("o.c")), F.col("rank") - F.col("o.sum"))).alias("at"))
    cuts = owned.join(scanned, ["__row", "cut"], "left").groupBy("__row").agg(F.first("n").alias("n"), F.max(F.when(F.col("cut") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("cut") == 1, F.col("at"))).alias("b"))
    end = F.length("__text").cast("bigint")  # a cut that no chunk owns lies behind the last unit
    cut = F.struct("n", F.coalesce("a", end).alias("first"), F.coalesce("b", end).alias("second"))
    return rows.join(cuts, "__row").withColumn("__cut", cut).drop("__row", "n", "a", "b")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1", plain: int = 10, spm: int = 20, chunk: int = CHUNK, long: int = LONG
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of docs; n: units of the text.

    The SHA-256 of `seed:id` gives four numbers: two cuts (behind their remainders by n + 1 units),
    whether the text stays plain (`plain` of 100) and whether the suffix comes first (`spm` of 100).
    Empty texts, null ones and those that hold a marker stay plain. A null id counts as an empty
    text; whole texts count, however long; repeated rows get the same result; an empty table gives no
    rows; other columns, clashing names among them, are not read.
    """
    small_batches(docs.sparkSession)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("bigint")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("__text"), name.alias("__h")).select(id_col, "__text", *(number(i).alias(f"__{i + 1}") for i in range(4)))
    short, very = F.octet_length("__text") <= long, F.octet_length("__text") > long
    cut = rows.where(short).withColumn("__cut", _cut_columns(F.col("__text"), F.col("__1"), F.col("__2")))
    cut = cut.unionByName(_long_cuts(rows.where(very), chunk).select(*cut.columns))
    marked = F.col("__text").contains("<P>") | F.col("__text").contains("<S>") | F.col("__text").contains("<M>")
    form = F.when((F.col("__text") == "") | marked | (F.col("__3") % 100 >= 100 - plain), "plain").when(F.col("__4") % 100 < spm, "spm").otherwise("psm")
    first, second = F.col("__cut.first").cast("int"), F.col("__cut.second").cast("int")
    prefix, middle = F.substring("__text", F.lit(1), first), F.substring("__text", first + 1, second - first)
    suffix = F.substring("__text", second + 1, F.length("__text"))
    moved = F.when(F.col("form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
    moved = moved.when(F.col("form") == "spm", F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)).otherwise(F.col("__text"))
    whole = F.col("form") == "plain"
    return cut.withColumn("form", form).select(
        id_col,
        F.col("__cut.n").alias("n"),
        "form",
        F.when(~whole, F.col("__cut.first")).alias("prefix_chars"),
        F.when(~whole, F.col("__cut.second") - F.col("__cut.first")).alias("middle_chars"),
        moved.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: markers stand in a moved text only where they were put."""
    part = F.split(output, "<P>|<S>|<M>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
