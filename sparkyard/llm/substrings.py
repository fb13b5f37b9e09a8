"""Substring dedup by compacting a de Bruijn graph of token k-mers.

The edges of the graph are the windows of K consecutive words. Sending every edge over the
network is what costs, so paths are compacted before it: the edges of a document that follow
each other and share an anchor (the least hash of the short word runs inside a window, a
function of the window's words alone) travel as one path, keyed by the anchor. Equal edges have
equal anchors, so they meet in one task. Copies inside a portion of a task are settled there and
only the copy of the smallest id travels, so an edge of any frequency costs a row a portion.

Each task finds the edges that a document with a smaller id also has, with the source's
coordinates (id, digest of the text, word). Edges that advance in step with their source are a
nonbranching repeated path; a path leaves the task as one span. Spans of a document that continue
each other, there and in the source, are compacted across tasks.

Hashes only propose. Every compacted span is verified: the words at its own coordinates and those
at the source's are read from the documents again and digested by BLAKE2b; spans whose digests
differ (words with one hash) are given up, and their windows are looked up by their words. A last
join on the documents' keys removes the words under what is left. What a step has shuffled is
released before the next one, so that the two passes over the texts don't add to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, by_bytes, checkpointed, fields, plan_bytes, release, small_batches

#: Words of a window, and of the runs among which its anchor is found.
K, ANCHOR = 13, 5
#: Parts that a shuffle partition is settled in, one after the other; bytes of the input for a part, however many they are.
PARTS, PART_BYTES = 8, 32 << 20
#: Windows to be looked up by their words that travel to all tasks.
SENT = 10_000
#: Rank of a null id: after all others.
_LAST = (1 << 63) - 1
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def _rolled(words: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * factor + words[j : j + n]
    return _mix(h)


def words_of(text: str) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def _edges(texts: list[str], bits: int = 64) -> tuple[np.ndarray, ...]:
    """index of each window's first word among all words, its hash and anchor; text of each word; first word of each text."""
    import pandas as pd

    split = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(split)), counts)
    n = len(owner) - K + 1
    if n <= 0:
        none = np.empty(0, np.uint64)
        return none.astype(np.int64), none, none, owner, first
    flat = np.empty(len(owner), object)
    flat[:] = [w for ws in split for w in ws]
    hashes = pd.util.hash_array(flat, categorize=False)
    if bits < 64:
        hashes = hashes >> np.uint64(64 - bits)
    del flat, split
    runs = _rolled(hashes, ANCHOR, _P)
    anchor = runs[:n].copy()
    for j in range(1, K - ANCHOR + 1):
        np.minimum(anchor, runs[j : j + n], out=anchor)
    at = np.flatnonzero(owner[:n] == owner[K - 1 :])
    return at, _rolled(hashes, K, _Q)[at], anchor[at], owner, first


def _groups(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Starts of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _later_copies(edge: np.ndarray, anchor: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose edge also has a smaller rank, with a place of the smallest rank."""
    none = np.empty(0, np.int64)
    if not len(edge):
        return none, none
    order = np.argsort(edge)
    starts = _groups((edge[order],))  # of any anchor: the order is by edge alone
    sizes = np.diff(np.append(starts, len(order)))
    several = np.repeat(sizes > 1, sizes)
    order = order[several]
    if not len(order):
        return none, none
    order = order[np.lexsort((order, rank[order], anchor[order], edge[order]))]
    starts = _groups((edge[order], anchor[order]))
    source = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    later = rank[order] > rank[source]
    back = np.argsort(order[later])
    return order[later][back], source[later][back]


def _spans(row: np.ndarray, word: np.ndarray, source: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of spans, and the spans (start, edges, source rank, source start, source tag), of edges sorted by row and word.

    source: rank, word and tag of each edge's source.
    """
    rank, at, tag = source
    step = np.ones(len(row), bool)
    step[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1) | (rank[1:] != rank[:-1]) | (at[1:] != at[:-1] + 1) | (tag[1:] != tag[:-1])
    starts = np.flatnonzero(step)
    sizes = np.diff(np.append(starts, len(row)))
    return row[starts], np.stack([word[starts], sizes, rank[starts], at[starts], tag[starts]], axis=1).astype(np.int64)


def _by_row(rows: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, bytes]]:
    starts = _groups((rows,)) if len(rows) else np.empty(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=False):
        yield int(rows[a]), spans[a:b].tobytes()


def _pack(row: np.ndarray, word: np.ndarray, anchor: np.ndarray, edge: np.ndarray, rank: np.ndarray, tag: np.ndarray) -> bytes:
    """Edges, sorted by row and word, as paths; rank and tag by row."""
    step = np.ones(len(row), bool)
    step[1:] = (word[1:] != word[:-1] + 1) | (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    paths = np.flatnonzero(step)
    sizes = np.diff(np.append(paths, len(row)))
    own = row[paths]
    firsts = _groups((own,))
    used = own[firsts]
    small = b"".join(
        x.tobytes()
        for x in (
            np.diff(rank[used], prepend=0).astype("<i8"),
            np.diff(np.append(firsts, len(own))).astype("<i4"),
            tag[used].astype("<i8"),
            word[paths].astype("<i4"),
            sizes.astype("<i4"),
        )
    )
    squeezed = pa.compress(small, "zstd", asbytes=True)
    head = np.array([len(used), len(paths), len(row), len(small), len(squeezed)], "<i8").tobytes()
    return head + squeezed + anchor[paths].tobytes() + edge.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """rank and tag of each row; row, word, anchor and edge of each edge."""
    rows, paths, edges, plain, squeezed = (int(x) for x in np.frombuffer(blob, "<i8", 5))
    small, at = pa.decompress(blob[40 : 40 + squeezed], plain, "zstd", asbytes=True), 40 + squeezed
    rank = np.cumsum(np.frombuffer(small, "<i8", rows))
    counts = np.frombuffer(small, "<i4", rows, 8 * rows)
    tag = np.frombuffer(small, "<i8", rows, 12 * rows)
    word = np.frombuffer(small, "<i4", paths, 20 * rows).astype(np.int64)
    sizes = np.frombuffer(small, "<i4", paths, 20 * rows + 4 * paths)
    anchor = np.frombuffer(blob, "<u8", paths, at)
    wide = np.zeros((edges, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * edges, at + 8 * paths).reshape(-1, 6)
    within = np.arange(edges) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rank, tag, np.repeat(np.repeat(np.arange(rows), counts), sizes), np.repeat(word, sizes) + within, np.repeat(anchor, sizes), wide.view("<u8").ravel()


_SENT = "part int, rank bigint, tag bigint, payload binary"


def _send(parts: int, portion_bytes: int = BATCH_BYTES, bits: int = 64):
    """Rows (rank, tag, text) to packed paths by part, and spans settled here by (rank, tag)."""

    def portion(rank: np.ndarray, tag: np.ndarray, texts: list[str]) -> pa.RecordBatch:
        at, edge, anchor, owner, first = _edges(texts, bits)
        row, out = owner[at] if len(at) else at, []
        later, source = _later_copies(edge, anchor, rank[row])
        rows, spans = _spans(row[later], at[later] - first[row[later]], (rank[row[source]], at[source] - first[row[source]], tag[row[source]]))
        for r, blob in _by_row(rows, spans):
            out.append((r % parts, int(rank[r]), int(tag[r]), blob))
        stay = np.ones(len(at), bool)
        stay[later] = False
        part = ((anchor >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        stay = np.flatnonzero(stay)
        stay = stay[np.argsort(part[stay].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
        starts = _groups((part[stay],)) if len(stay) else stay
        word = at - first[row] if len(at) else at
        edge = edge & _LOW48
        for a, b in zip(starts, np.append(starts[1:], len(stay)), strict=False):
            s = stay[a:b]
            out.append((int(part[s[0]]), None, None, _pack(row[s], word[s], anchor[s], edge[s], rank, tag)))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "rank", "tag", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, tag = (batch.column(i).to_numpy() for i in (0, 1))
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in by_bytes(texts, portion_bytes):
                # by rank, so that ranks pack well
                order = a + np.argsort(rank[a:b], kind="stable")
                yield portion(rank[order], tag[order], [texts[i] for i in order])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed paths, sorted by part, to spans by (rank, tag)."""

    def emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        types = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rank", "tag", "spans"])

    def settled(blobs: list[bytes]) -> pa.RecordBatch:
        ranks, tags, rows, words, anchors, edges, n = [], [], [], [], [], [], 0
        for b in blobs:
            rank, tag, row, word, anchor, edge = _unpack(b)
            for x, y in zip((ranks, tags, rows, words, anchors, edges), (rank, tag, row + n, word, anchor, edge), strict=True):
                x.append(y)
            n += len(rank)
        blobs.clear()
        rank, tag, row, word, anchor, edge = (np.concatenate(x) for x in (ranks, tags, rows, words, anchors, edges))
        del ranks, tags, rows, words, anchors, edges
        later, source = _later_copies(_mix(edge ^ anchor), anchor, rank[row])
        # a mixed key of 64 bits gathers; the 48 bits of the edge under a 64-bit anchor decide
        true = edge[later] == edge[source]
        later, source = later[true], source[true]
        owner, spans = _spans(row[later], word[later], (rank[row[source]], word[source], tag[row[source]]))
        return emit([(int(rank[r]), int(tag[r]), blob) for r, blob in _by_row(owner, spans)])

    part, blobs = None, []
    for batch in batches:
        done = []
        for p, rank, tag, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rank is not None:
                done.append((rank, tag, payload))
                continue
            if p != part and blobs:
                yield settled(blobs)
            part = p
            blobs.append(payload)
        if done:
            yield emit(done)
    if blobs:
        yield settled(blobs)


def _keyed(docs: DataFrame, keep: tuple[str, ...], id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("__rank"), F.xxhash64(body).alias("__tag"), body.alias("__text"))


_SPANS = "array<struct<start:int,words:int,source:bigint,source_tag:bigint,source_start:int>>"


def compact(blobs: list[bytes]) -> np.ndarray:
    """A document's spans, sorted; those that continue each other here and in the source are one."""
    spans = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 5) for b in blobs])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, n, source, at, tag = spans.T
    on = np.zeros(len(spans), bool)
    on[1:] = (start[1:] == start[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + n[:-1]) & (tag[1:] == tag[:-1])
    heads = np.flatnonzero(~on)
    out = spans[heads]
    out[:, 1] = np.add.reduceat(n, heads)
    return out


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = []
        for blobs in batch.column(2).to_pylist():
            listed.append([{"start": s, "words": n + K - 1, "source": r, "source_tag": t, "source_start": w} for s, n, r, w, t in compact(blobs).tolist()])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_tag", pa.int64()), ("source_start", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(listed, kind)], names=["__rank", "__tag", "spans"])


def proposed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", portion_bytes: int = BATCH_BYTES, bits: int = 64) -> DataFrame:
    """(__rank, __tag, spans): compacted spans of windows whose hashes also start in a row of smaller id.

    __rank is the id (null: the largest), __tag a digest of the text: rows of one id with
    different texts are told apart; none of them is a source for another. bits: of the words'
    hashes; fewer make words collide, for tests.
    """
    small_batches(docs.sparkSession)
    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs, (), id_col, text)
    size = plan_bytes(docs)
    if size is None:  # no estimate: counted
        size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(PARTS * session, size // PART_BYTES)
    sent = rows.select("__rank", "__tag", "__text").mapInArrow(_send(parts, portion_bytes, bits), _SENT)
    met = sent.repartition(max(session, parts // PARTS), "part").sortWithinPartitions("part")
    spans = met.mapInArrow(_settle, "rank bigint, tag bigint, spans binary")
    by_text = spans.groupBy(F.col("rank").alias("__rank"), F.col("tag").alias("__tag")).agg(F.collect_list("spans").alias("spans"))
    return checkpointed(by_text.mapInArrow(_compacted, f"__rank bigint, __tag bigint, spans {_SPANS}"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("__rank", "__tag", F.inline("spans"))


_SOURCE = ("source", "source_tag", "source_start", "words")


def _digests(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, source_tag, source_start, words, d1, d2) for each range asked (__rank, __tag, start and these): a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in by_bytes(texts):
                out = []
                for body, ranges in zip(texts[a:b], batch.column(1)[a:b].to_pylist(), strict=True):
                    words = words_of(body)
                    for x in ranges:
                        digest = hashlib.blake2b(b" ".join(words[x["start"] : x["start"] + x["words"]]), digest_size=16).digest()
                        out.append((x["source"], x["source_tag"], x["source_start"], x["words"], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*out, strict=True) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=[*_SOURCE, "d1", "d2"])

    ranges = asked.groupBy("__rank", "__tag").agg(F.collect_list(F.struct("start", *_SOURCE)).alias("ranges"))
    joined = rows.join(ranges, ["__rank", "__tag"]).select("__text", "ranges")
    return joined.mapInArrow(run, "source bigint, source_tag bigint, source_start int, words int, d1 bigint, d2 bigint")


def false_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(__rank, __tag, start, words): the spans of found whose source range has other words than some span that names it.

    Digests of a source range and of all spans that name it meet by partial aggregation, so a range
    that a third of all documents repeat costs a row a task.
    """
    flat = _flat(found)
    own = flat.select(F.col("source").alias("__rank"), F.col("source_tag").alias("__tag"), F.col("source_start").alias("start"), *_SOURCE).distinct()
    digests = _digests(_keyed(docs, (), id_col, text), flat.select("__rank", "__tag", "start", *_SOURCE).unionByName(own))
    both = digests.groupBy(*_SOURCE).agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("d2").alias("c"), F.max("d2").alias("d"))
    differ = checkpointed(both.where("a <> b or c <> d").select(*_SOURCE))
    return flat.join(differ, list(_SOURCE), "left_semi").select("__rank", "__tag", "start", "words")


def _looked_up(docs: DataFrame, false: DataFrame, id_col: str, text: str) -> DataFrame:
    """Spans of one window each, found by their words, for the windows of false spans."""
    words = F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = _keyed(docs, (), id_col, text).select("__rank", "__tag", words.alias("w")).where(F.size("w") >= K)
    window = F.array_join(F.slice("w", F.col("at") + 1, K), " ").alias("g")
    own = rows.join(false, ["__rank", "__tag"]).select("__rank", "__tag", "w", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("words") - K)).alias("at"))
    own = checkpointed(own.select("__rank", "__tag", "at", window).distinct())
    wanted = own.select("g").distinct()
    wanted = F.broadcast(wanted) if own.count() <= SENT else wanted
    there = rows.select("__rank", "__tag", "w", F.explode(F.sequence(F.lit(0), F.size("w") - K)).alias("at")).select("__rank", "__tag", "at", window)
    first = there.join(wanted, "g").groupBy("g").agg(F.min(F.struct("__rank", "__tag", "at")).alias("s"))
    true = own.join(first, "g").where(F.col("s.__rank") < F.col("__rank"))
    span = F.struct(F.col("at").alias("start"), F.lit(K).alias("words"), F.col("s.__rank").alias("source"), F.col("s.__tag").alias("source_tag"), F.col("s.at").alias("source_start"))
    return true.select("__rank", "__tag", span.alias("x"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", portion_bytes: int = BATCH_BYTES, bits: int = 64) -> DataFrame:
    """(__rank, __tag, spans) as proposed_spans, each verified by the words at its source's coordinates."""
    found = proposed_spans(docs, id_col, text, portion_bytes, bits)
    release(docs.sparkSession)
    false = false_spans(docs, found, id_col, text)
    release(docs.sparkSession)
    if false.isEmpty():
        return found
    false = checkpointed(false)
    kept = _flat(found).join(false, ["__rank", "__tag", "start", "words"], "left_anti")
    kept = kept.select("__rank", "__tag", F.struct("start", "words", "source", "source_tag", "source_start").alias("x"))
    every = kept.unionByName(_looked_up(docs, false, id_col, text))
    return checkpointed(every.groupBy("__rank", "__tag").agg(F.sort_array(F.collect_list("x")).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", portion_bytes: int = BATCH_BYTES, bits: int = 64) -> DataFrame:
    """id, n_words, n_removed, kept (words joined by a space), spans for every row of docs.

    A word goes if a window of K words over it also starts in a row with a smaller id. spans are
    the repeated paths: start word, words, source id, source start word; a source is a row of
    smaller id that holds the span's words there. Whole texts count: a very long one is a portion
    of its own. Ids are integers, or text that reads as one. Null texts have no words; a null id is
    the largest and never a source; rows of equal id, repeated ones among them, don't affect each
    other; an empty table gives no rows; other columns, clashing names among them, are not read.
    """
    rows = _keyed(docs, (id_col,), id_col, text)
    joined = rows.join(repeated_spans(docs, id_col, text, portion_bytes, bits), ["__rank", "__tag"], "left")
    source = joined.select(F.col(id_col), "__text", "spans")
    span = "array<struct<start:int,words:int,source_id:bigint,source_start:int>>"
    schema = fields(f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string, spans {span}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_bytes(texts):
                total, gone, kept, paths = [], [], [], []
                for t, found in zip(texts[a:b], batch.column(2)[a:b].to_pylist(), strict=True):
                    words = words_of(t)
                    total.append(len(words))
                    depth = np.zeros(len(words) + 1, np.int64)
                    for x in found or ():
                        depth[x["start"]] += 1
                        depth[x["start"] + x["words"]] -= 1
                    stay = np.cumsum(depth[:-1]) == 0
                    gone.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)] if gone[-1] else words).decode("utf-8", "surrogatepass"))
                    paths.append([{"start": x["start"], "words": x["words"], "source_id": x["source"], "source_start": x["source_start"]} for x in found or ()])
                arrays = [batch.column(0)[a:b], *(pa.array(x, f.type) for x, f in zip((total, gone, kept, paths), list(out)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return source.mapInArrow(run, schema)
