"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into BLOCKS blocks. Two that differ in at most d bits agree on at least
BLOCKS - d blocks, so every close pair meets in at least one of the tables keyed by a choice of
BLOCKS - d blocks. With 64 bits, d = 3 and 6 blocks that is 20 tables with keys of about 32 bits,
which keeps buckets small as the corpus grows. Buckets are searched in Arrow functions, which
return a star per group of linked fingerprints rather than all pairs. In a bucket above HOT tiles the
pigeonhole is applied again: its rows agree on some bits, the others are cut into d + 1 parts, and
close rows agree on one of these, so a row goes to d + 1 smaller buckets, whatever the bucket's size.
What is above TILE then is cut into tiles, and each pair of tiles is a task of its own, so that no
bucket has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpointed, fields, known_array, map_texts, small_batches
from .components import connected_components

BITS, BLOCKS, TILE = 64, 6, 2048
#: Tiles of a bucket from which on it is cut by further bits, and how often that is done.
HOT, LEVELS = 8, 3
#: Bits of each byte value, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of `width` words of the ASCII-lower-cased text, repeats included; fewer words: one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return [line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=False)]


def packed_majority(h: np.ndarray) -> int:
    """64 bits; each is 1 if it is set in over half of h (little-endian uint64); none: 0."""
    lanes = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int) -> int:
    """The majority bits of the XXH64 (seed 42) of the text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return packed_majority(np.array([digest(g, 42) for g in shingles(text, width)], dtype="<u8"))


def fingerprints(docs: DataFrame, width: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep and fp (the 64 bits as a signed long); null and empty texts have fingerprint 0."""

    def work(texts: list[str]) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(docs, list(keep), fields("fp bigint"), work, text)


def _bounds() -> list[tuple[int, int]]:
    cuts = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def stars(rows: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of each linked row but the first of its group, and of that first one.

    near(rest, row) tells which of the rows `rest` link to `row`. Every row is held against those
    not yet reached, so groups come out whole without a list of pairs.
    """
    left, member, root = np.arange(len(rows)), [], []
    while len(left) > 1:
        first, rest = left[0], left[1:]
        frontier = np.array([first])
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            for f in frontier:
                hit |= near(rows[rest], rows[f])
            frontier, rest = rest[hit], rest[~hit]
            member.append(frontier)
            root.append(np.full(len(frontier), first))
        left = rest
    none = np.empty(0, np.int64)
    return np.concatenate([none, *member]), np.concatenate([none, *root])


def bucket_search(near: Callable[[np.ndarray, np.ndarray], np.ndarray], content: Callable[[pa.Array], np.ndarray], pairwise: bool = True) -> Callable:
    """Arrow function from rows (bucket in 3 columns, node, content) sorted by bucket to links (a, b).

    content makes an array of a column; near takes two arrays of pairs as well, if pairwise. A
    bucket may run over several batches.
    """

    def flush(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        node, data = rows[3], rows[4]
        two = starts[(sizes == 2) & pairwise]
        close = near(data[two], data[two + 1]) if len(two) else np.empty(0, bool)
        found = [(node[two][close], node[two + 1][close])]
        many = sizes > (2 if pairwise else 1)
        for s, n in zip(starts[many], sizes[many], strict=True):
            member, root = stars(data[s : s + n], near)
            found.append((node[s + member], node[s + root]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the bucket that the last batch ended in
        joined = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (*(batch.column(i).to_numpy() for i in range(4)), content(batch.column(4)))
            if held and any(x[0] != y[-1] for x, y in zip(rows[:3], held[-1][:3], strict=True)):
                yield flush(joined())
                held = []
            same = np.all([x == x[-1] for x in rows[:3]], axis=0)
            if same.all():
                held.append(rows)
                continue
            last = len(same) - int(np.argmin(same[::-1]))
            held.append(tuple(x[:last] for x in rows))
            yield flush(joined())
            held = [tuple(x[last:] for x in rows)]
        if held:
            yield flush(joined())

    return run


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def in_tiles(keyed: DataFrame, tile: int, size: str | None = None, tile_bytes: int = 64 << 20) -> DataFrame:
    """(key, t, u, node) of the buckets with several nodes; a bucket above `tile` in pairs of tiles.

    size: a column with the bytes of each node's content; then tiles hold about tile_bytes at most.
    """
    held = F.sum(size) if size else F.lit(0)
    full = keyed.groupBy("key").agg(F.count("*").alias("n"), held.alias("held")).where("n > 1")
    met = keyed.join(apart(full, "key"), "key").select("key", "node", F.expr(f"int(least(n, greatest(ceil(n / {tile}), ceil(held / {tile_bytes}))))").alias("g"))
    met = met.withColumn("t", F.expr("int(pmod(xxhash64(node), g))"))
    met = met.select("key", "node", "t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("u"))
    return met.select("key", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "node")


def searched(met: DataFrame, near: Callable, content: Callable[[pa.Array], np.ndarray] = longs, pairwise: bool = True) -> DataFrame:
    """Links in rows (key, t, u, node, content)."""
    small_batches(met.sparkSession)
    met = met.select("key", "t", "u", "node", "content").repartition("key", "t", "u").sortWithinPartitions("key", "t", "u")
    return met.mapInArrow(bucket_search(near, content, pairwise), "a bigint, b bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(distance: int) -> list[int]:
    """The bits that each table is keyed by."""
    return [sum(((1 << (b - a)) - 1) << a for a, b in chosen) for chosen in combinations(_bounds(), BLOCKS - distance)]


def tables(fp: Column, distance: int) -> Column:
    """The keys of a fingerprint, one a table: the table's number and the bits of its blocks."""
    return F.array(*(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(mask)))) for number, mask in enumerate(_masks(distance))))


def finer(masks: list[int], distance: int) -> list[int]:
    """distance + 1 masks for each one, side by side: its bits and a part of all others; rows within distance agree on one of them."""
    out = []
    for mask in masks:
        others = [i for i in range(BITS) if not mask >> i & 1]
        cuts = [len(others) * i // (distance + 1) for i in range(distance + 2)]
        out += [mask | sum(1 << i for i in others[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def blocked(fps: DataFrame, distance: int, hot: int) -> DataFrame:
    """(node, key): the buckets of all tables; those above `hot` rows are cut by further bits, up to LEVELS times.

    A fingerprint enters a bucket once, so a table of no more than `hot` fingerprints is not counted.
    """
    masks = _masks(distance)
    keyed = fps.select(F.col("fp").alias("node"), F.posexplode(tables(F.col("fp"), distance)).alias("number", "key"))
    if fps.limit(hot + 1).count() <= hot:
        return keyed.select("node", "key")
    done = []
    for level in range(1, LEVELS + 1):
        full = checkpointed(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"))
        if full.isEmpty():
            break
        done.append(keyed.join(apart(full, "key"), "key", "left_anti").select("node", "key"))
        masks = finer(masks, distance)
        part = F.explode(F.sequence(F.col("number") * (distance + 1), F.col("number") * (distance + 1) + distance)).alias("number")
        keyed = keyed.join(apart(full, "key"), "key", "left_semi").select("node", part)
        bits = F.col("node").bitwiseAND(F.element_at(known_array([_signed(m) for m in masks], "bigint"), F.col("number") + 1))
        keyed = keyed.withColumn("key", F.xxhash64(F.lit(level), "number", bits))
    for cold in done:
        keyed = keyed.select("node", "key").unionByName(cold)
    return keyed.select("node", "key")


def close_links(fps: DataFrame, distance: int = 3, tile: int = TILE, hot: int | None = None) -> DataFrame:
    """(a, b): links that join all fingerprints within `distance` bits, stars in place of all pairs.

    fps: one distinct fingerprint a row, column fp. hot: rows of a bucket from which on it is cut (HOT tiles).
    """
    met = in_tiles(blocked(fps, distance, hot or HOT * tile), tile).withColumn("content", F.col("node"))
    return searched(met, lambda rest, one: np.bitwise_count(rest ^ one) <= distance)


def simhash_components(docs: DataFrame, width: int = 5, distance: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp and component_id (the smallest id that links reach) for every row of docs.

    Rows link when their fingerprints differ in at most `distance` bits. Null and empty texts have
    fingerprint 0 and link like any other. A null id gets a component but never names one, unless
    all ids of the component are null. Whole texts count, however long, each in one task. Repeated
    rows give repeated results; an empty table gives none; other columns, clashing names among
    them, are not read.
    """
    own = checkpointed(fingerprints(docs.select(id_col, text), width, (id_col,), text))
    classes = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(close_links(classes.select("fp"), distance))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(apart(component, "root"), "root").select("fp", "component_id")
    return own.join(of, "fp").select(id_col, "fp", "component_id")
