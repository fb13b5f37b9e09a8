"""Periodic runs of words: stretches that repeat with some period at least twice, by the method of Gusfield and Stoye.

The words of a portion of texts become one sequence of numbers, a document's own for every document.
Only words inside repeated half-runs stay in it (no run reaches outside of them). Its sorted
suffixes with their common prefix lengths stand for the suffix tree: a string's place is the range
of suffixes that begin with it, and the suffix link of suffix i leads to suffix i + 1.

1. Lempel-Ziv blocks; around each block's borders the extensions to both sides give the
   leftmost-covering squares, one a border and period.
2. From a square's place, suffix links lead through its rotations as long as they are squares too:
   that completes the vocabulary of squares with primitive roots.
3. The suffixes in each word's range locate all of its occurrences; those of a period that start
   side by side merge into a run.

Numpy does the steps for all blocks, squares and occurrences at once. Common extensions take a
logarithm's number of look-ups in names of substrings of 1, 2, 4, ... words, so the whole takes
O(w log w) time and some 200 bytes a word of repeated passages, w words in number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, arrow_types, fields, small_batches

#: Words of the shortest run.
LEAST = 12

_MADE = "n_words bigint, kept string, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def _repeated(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a passage of `width` words that comes again in the same document.

    A run of at least 2 * width words and twice its period is the union of two such passages'
    stretches, so all runs lie inside. Passages are compared by a 64-bit sum: chance hits only add words.
    """
    import pandas as pd

    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    mixed = (ids.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += mixed[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    at = at[pd.Series(total[at]).duplicated(keep=False).to_numpy()]
    edge = np.zeros(len(ids) + 1, np.int32)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:-1]) > 0


class _Suffixes:
    """Sorted suffixes of a sequence whose last element is unique, names of its substrings, common extensions."""

    def __init__(self, sequence: np.ndarray):
        m = self.size = len(sequence)
        names = [np.unique(sequence, return_inverse=True)[1].astype(np.int64)]
        while names[-1].max() < m - 1:
            h = 1 << (len(names) - 1)
            second = np.full(m, -1, np.int64)
            second[: m - h] = names[-1][h:]
            names.append(np.unique(names[-1] * (m + 1) + second + 1, return_inverse=True)[1].astype(np.int64))
        self.rank = names.pop()
        self.order = np.argsort(self.rank)
        self.names = [x.astype(np.int32) for x in names]
        self.common = np.zeros(m, np.int64)
        if m > 1:
            self.common[1:] = self.ahead(self.order[:-1], self.order[1:])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal elements from i and j on (i and j differ)."""
        found, last = np.zeros(len(i), np.int64), self.size - 1
        for t in reversed(range(len(self.names))):
            name = self.names[t]
            found += (name[np.minimum(i + found, last)] == name[np.minimum(j + found, last)]).astype(np.int64) << t
        return found

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal elements from i and j backwards, both included."""
        found = np.zeros(len(i), np.int64)
        for t in reversed(range(len(self.names))):
            name, a, b = self.names[t], i - found - (1 << t) + 1, j - found - (1 << t) + 1
            same = (a >= 0) & (b >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])
            found += same.astype(np.int64) << t
        return found

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest match of an earlier start, or one element."""
        order, common = self.order.tolist(), self.common.tolist()
        longest, stack = [0] * self.size, []
        # a suffix's longest earlier match is its nearest neighbour of smaller start on either side
        for at, shared in zip(order, common, strict=True):
            while stack and stack[-1][0] > at:
                gone, above = stack.pop()
                longest[gone] = max(above, shared)
                shared = min(shared, above)
            stack.append((at, shared))
        for gone, above in stack:
            longest[gone] = above
        heads, i = [], 0
        while i < self.size:
            heads.append(i)
            i += longest[i] or 1
        return np.array(heads, np.int64)

    def ranges(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share `length` elements with suffix i."""
        least = [self.common.astype(np.int32)]
        while 2 << (len(least) - 1) <= self.size:
            h = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-h], least[-1][h:]))
        low, high, size = self.rank[i].copy(), self.rank[i].copy(), self.size
        for t in reversed(range(len(least))):
            h, below = 1 << t, least[t]
            a = low - h
            low = np.where((a >= 0) & (below[np.clip(a + 1, 0, len(below) - 1)] >= length), a, low)
            b = high + h
            high = np.where((b < size) & (below[np.clip(high + 1, 0, len(below) - 1)] >= length), b, high)
        return low, high


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n of lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _covering(s: _Suffixes, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, among them a leftmost-covering one of every square's rotations."""
    heads = s.blocks()
    ends = np.append(heads[1:], s.size)
    second = np.append(ends[1:], s.size)
    starts, periods = [], []
    # squares that begin in a block and reach into the next one, then those around its head
    for border, reach, sign in ((ends[:-1], (ends - heads)[:-1], -1), (heads[1:], (second - heads)[1:], 1)):
        at, k = np.repeat(border, reach), _counted(reach) + 1
        other = at + sign * k
        fits = (other >= 0) & (other < s.size)
        at, k, other = at[fits], k[fits], other[fits]
        hit = sequence[at] == sequence[other]
        at, k, other = at[hit], k[hit], other[hit]
        forward, backward = s.ahead(at, other), s.back(at - 1, other - 1)
        square = forward + backward >= k
        first = np.minimum(at, other)
        starts.append((first - np.minimum(backward, k - 1))[square])
        periods.append(k[square])
    return np.concatenate(starts), np.concatenate(periods)


def _runs(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence whose last element is unique, by period and start."""
    none = np.zeros(0, np.int64)
    s = _Suffixes(sequence)
    start, k = _covering(s, sequence)
    if not len(start):
        return none, none, none
    # stretches around the squares; of one stretch's periods the smallest has the primitive root
    left = start - s.back(start - 1, start + k - 1)
    right = start + k + s.ahead(start, start + k)
    order = np.lexsort((k, right, left))
    left, right, k = left[order], right[order], k[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    left, right, k = left[new], right[new], k[new]
    # suffix links lead through the rotations
    rotations = np.minimum(k, right - left - 2 * k + 1)
    at, period = np.repeat(left, rotations) + _counted(rotations), np.repeat(k, rotations)
    low, high = s.ranges(at, 2 * period)
    _, once = np.unique(period * (s.size + 1) + low, return_index=True)
    low, count, period = low[once], high[once] - low[once] + 1, period[once]
    # all occurrences, merged where they start side by side
    start, k = s.order[np.repeat(low, count) + _counted(count)], np.repeat(period, count)
    order = np.lexsort((start, k))
    start, k = start[order], k[order]
    first = np.append(True, (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1))
    last = np.append(first[1:], True)
    return start[first], start[last] + 2 * k[last], k[first]


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least `least` words in ids, words of documents `doc` one after another."""
    inside = np.flatnonzero(_repeated(ids, doc, -(-least // 2)))
    if not len(inside):
        return inside, inside, inside
    ends = np.append((inside[1:] != inside[:-1] + 1) | (doc[inside[1:]] != doc[inside[:-1]]), True)
    # an element of its own behind every stretch
    place = np.arange(len(inside)) + np.cumsum(np.append(0, ends[:-1]))
    own = np.unique((doc[inside].astype(np.int64) << 32) + ids[inside], return_inverse=True)[1]
    sequence = np.full(place[-1] + 2, -1, np.int64)
    sequence[place] = own
    gaps = np.flatnonzero(sequence < 0)
    sequence[gaps] = len(inside) + np.arange(len(gaps))
    origin = np.full(len(sequence), -1, np.int64)
    origin[place] = inside
    start, end, period = _runs(sequence)
    long = end - start >= least
    return origin[start[long]], (end - start)[long], period[long]


def _portion(words: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    start, length, period = runs_of(ids, doc, least)
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    before = np.cumsum(sizes) - sizes
    order = np.lexsort((period, start))
    for at, n, q in zip(start[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        d = int(doc[at])
        found[d].append((at - int(before[d]), n, q))
    return found


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for at, n, q in runs:
        edge[at + q] += 1
        edge[at + n] -= 1
    stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in stays.tolist()])


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, n_words, kept, runs) for every row of docs: runs (start, length, period) by start and period, and the
    text without what repeats.

    Words are what stands between blanks (space, \\t to \\r). A run is a stretch of at least `least`
    words and at least two of its smallest periods that no neighbouring word extends. kept: the words
    that no run holds behind its first period, joined by one space. edit(id, words) may change a
    document's words before the search. Null texts have no words; whole texts count, however long
    (a text is one task's work); repeated rows and null ids are rows like others; an empty table
    gives no rows; other columns, clashing names among them, are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    schema = T.StructType([docs.schema[id_col], *fields(_MADE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_types(schema)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _portions([len(t) for t in texts]):
                words = [t.split() for t in texts[a:b]]
                if edit is not None:
                    words = [edit(i, w) for i, w in zip(ids[a:b], words, strict=True)]
                found = _portion(words, least)
                kept = [_collapsed(w, r) for w, r in zip(words, found, strict=True)]
                runs = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in found]
                columns = (pa.array([len(w) for w in words], types["n_words"]), pa.array(kept, pa.binary()).cast(types["kept"]), pa.array(runs, types["runs"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _portions(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most limit bytes, or of one text."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
