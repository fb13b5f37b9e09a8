"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by a key (digest of the text, id), so that equal texts lie together. A
size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them;
ranges that turn out overfull are subdivided by a denser sample of their own. Exact running
sizes inside each range, on top of the exact sizes of the ranges before it, then place every
record, so the shards depend on the data alone and never on the sample. Records too large to be
fitted by a cut (over a small share of a shard, so a bounded number of them) are spread first,
largest first, and the ranges fill the room that they leave.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, cuts_below, known_array, small_batches

#: Ranges aimed at, at least, and one more for so many rows, up to MOST_RANGES; keys sampled for each.
RANGES, ROWS_A_RANGE, MOST_RANGES, SAMPLES_A_RANGE = 256, 500_000, 4096, 16
#: A record of over 1 / LARGE of a shard is spread first: at most shards * LARGE records.
LARGE = 256
#: A range of over OVERFULL times its share is subdivided, up to DEPTH times.
OVERFULL, DEPTH = 1.5, 4


def _sample(rows: DataFrame, wanted: float, total: int, salt: int) -> list[tuple[int, int, int]]:
    """Keys drawn with probability wanted * size / total each: about `wanted`, sure at size >= total / wanted."""
    draw = F.pmod(F.xxhash64("h", "id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    hit = rows.where(draw < F.col("size") * (wanted / max(total, 1)))
    return sorted((r.h, r.id, r.size) for r in hit.select("h", "id", "size").collect())


def _quantiles(keys: Sequence[tuple], parts: int, step: float) -> list[tuple[int, int]]:
    """Up to parts - 1 boundaries at equal sampled weight; a key above `step` counts by its size."""
    weights = [max(k[2], step) for k in keys]
    total, run, out = sum(weights), 0.0, []
    for k, w in zip(keys, weights, strict=True):
        if run > 0 and len(out) < parts - 1 and run >= (len(out) + 1) * total / parts:
            out.append((k[0], k[1]))
        run += w
    return sorted(set(out))


def _range(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the key."""
    return cuts_below(F.struct("h", "id"), [{"h": h, "id": i} for h, i in splitters], "struct<h:bigint,id:bigint>")


def _splitters(rows: DataFrame, total: int, count: int) -> list[tuple[int, int]]:
    """Boundaries of ranges of about equal bytes, overfull ranges subdivided."""
    ranges = min(MOST_RANGES, max(RANGES, count // ROWS_A_RANGE))
    wanted = ranges * SAMPLES_A_RANGE
    splitters = _quantiles(_sample(rows, wanted, total, 1), ranges, total / wanted)
    share = total / ranges
    for depth in range(1, DEPTH):
        sizes = {r.r: r.s for r in rows.groupBy(_range(splitters).alias("r")).agg(F.sum("size").alias("s")).collect()}
        over = {r: s for r, s in sizes.items() if s > OVERFULL * share}
        if not over:
            break
        dense = _sample(rows.where(_range(splitters).isin(list(over))), wanted * 2**depth * sum(over.values()) / total, sum(over.values()), depth + 1)
        more = set(splitters)
        for r, s in over.items():
            own = [k for k in dense if bisect.bisect_right(splitters, k[:2]) == r]
            more |= set(_quantiles(own, round(s / share) + 1, share / SAMPLES_A_RANGE / 2**depth))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    return splitters


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot for every row: shards of near equal bytes.

    size is the UTF-8 bytes of the text (null: none) plus 1. Shard sizes differ by less than
    2 / LARGE of a shard, beyond a single record that is larger than a shard. slot numbers a
    shard's rows from 0 without gaps. Very long texts are records of their size, spread first. Ids
    are integers, or text that reads as one; other text raises an error under ANSI rules. Null ids
    are placed like any other (and returned as null); fully repeated rows are interchangeable, and
    lie in one range; an empty table gives no rows; other columns, clashing names among them, are
    not read.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
    )
    rows = checkpointed(rows)
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cut = total / shards / LARGE
    # at most shards * LARGE records are as large as that
    large = sorted(rows.where(F.col("size") > cut).groupBy("size").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.size) if count else []
    filled, held = [0] * shards, [0] * shards
    heap, given = [(0, s) for s in range(shards)], {}
    for r in large:
        for _ in range(r.n):
            f, s = heapq.heappop(heap)
            given.setdefault(r.size, []).append(s)
            held[s] += 1
            filled[s] = f + r.size
            heapq.heappush(heap, (filled[s], s))
    # room that the large records leave, as ends of running sizes
    even, small_total = total / shards, total - sum(filled)
    room = [max(0.0, even - f) for f in filled]
    scale, ends, run = small_total / (sum(room) or 1.0), [], 0.0
    for x in room:
        run += x * scale
        ends.append(run)
    small = rows.where(F.col("size") <= cut)
    splitters = _splitters(small, small_total, count) if small_total else []
    ranged = small.withColumn("r", _range(splitters))  # on 4096 splitters, 13 comparisons a row
    before_b, before_n, b, n = {}, {}, 0, 0
    for r in sorted(ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect(), key=lambda x: x.r):
        before_b[r.r], before_n[r.r], b, n = b, n, b + r.b, n + r.n
    at = lambda of: F.element_at(known_array([of.get(i, 0) for i in range(len(splitters) + 1)], "bigint"), F.col("r") + 1)
    order = Window.partitionBy("r").orderBy("h", "id", "size")
    middle = at(before_b) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2.0
    inner = F.array(*(F.lit(float(x)) for x in ends[:-1]))
    placed = ranged.withColumns({"rank": at(before_n) + F.row_number().over(order) - 1, "shard": F.size(F.filter(inner, lambda x: x <= middle)) if shards > 1 else F.lit(0)})
    first = {r.shard: r.f for r in placed.groupBy("shard").agg(F.min("rank").alias("f")).collect()}
    slot0 = F.array(*(F.lit(held[s] - first.get(s, 0)).cast("bigint") for s in range(shards)))
    out = placed.select(id_col, "size", "text_crc32", "shard", (F.col("rank") + F.element_at(slot0, F.col("shard") + 1)).alias("slot"))
    if not large:
        return out
    # the large ones: by size, the i-th of a size goes where the i-th of that size was put
    numbers, slots = [0] * shards, {}
    for size, to in given.items():
        for s in to:
            slots.setdefault(size, []).append((s, numbers[s]))
            numbers[s] += 1
    plan = docs.sparkSession.createDataFrame([(size, i, s, k) for size, x in slots.items() for i, (s, k) in enumerate(x)], "size bigint, i int, shard int, slot bigint")
    nth = F.row_number().over(Window.partitionBy("size").orderBy("h", "id")) - 1
    big = rows.where(F.col("size") > cut).withColumn("i", nth).join(F.broadcast(plan), ["size", "i"])
    return out.unionByName(big.select(id_col, "size", "text_crc32", "shard", "slot"))
