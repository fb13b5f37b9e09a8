"""Byte-level BPE by overlapping chunks, and decoding by joining raw bytes.

A pre-token starts where the one before ends, and its end depends on no more than the next few
characters. So a chunk that starts anywhere finds the text's true boundaries from the first
boundary that it shares with them. Chunks overlap; each is pre-tokenised by itself; the
boundaries are stitched where neighbours agree, or, if an overlap holds no common boundary
(one very long pre-token), by carrying on from the last sure one. The text is then cut into
pieces at stitched boundaries and each piece is encoded by itself.

Texts of up to LONG characters are chunked inside a task. The chunks of longer ones are rows, so
that all tasks share a text: each finds where its reading and that of the next chunk first agree;
these cuts, a number a chunk, are joined to the chunks, which are encoded apart; the digests run
over the ids of a text in order, a chunk at a time. Where two chunks never agree, the text is read
in one task.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fields, map_texts

CHUNK = 1 << 15
OVERLAP = 512
#: Characters above which a text's chunks are rows, and of such a chunk.
LONG, ROW_CHUNK = 4 << 20, 1 << 20
#: Characters behind a pre-token on which its end may depend: contractions have up to three.
LOOK = 4


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The encoder, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    raw = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        raw[v] = k
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), raw


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    # the library's white space is the Unicode property
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def sure_ends(text: str, start: int, stop: int, pattern: str) -> list[int]:
    """Ends of the pre-tokens of text[start:stop], read from start, that what follows can't move."""
    ends = [m.end() for m in _pattern(pattern).finditer(text, start, stop)]
    if stop < len(text):
        while ends and ends[-1] > stop - LOOK:
            ends.pop()
    return ends


def stitched(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """All pre-token ends of text, from chunks read independently."""
    starts = range(0, max(1, len(text)), chunk)
    chunks = [sure_ends(text, s, min(len(text), s + chunk + overlap), pattern) for s in starts]
    ends: list[int] = []
    for k, own in enumerate(chunks):
        last = ends[-1] if ends else 0
        if k == 0:
            ends = own
            continue
        true = set(ends[-overlap - 1 :])
        meet = next((i for i, e in enumerate(own) if e in true), None)
        if meet is None:  # no common boundary: read on from the last sure one
            stop = min(len(text), starts[k] + chunk + overlap)
            ends += sure_ends(text, last, stop, pattern)
        else:
            ends += [e for e in own[meet + 1 :] if e > last]
    return ends


def pieces(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """text cut at stitched boundaries into parts of about chunk characters."""
    if len(text) <= chunk:
        return [text]
    cuts = [0]
    for e in stitched(text, pattern, chunk, overlap):
        far = e - cuts[-1]
        # behind white space a cut would move what a look-ahead leaves over; before white space any
        # version of the character tables has a boundary
        if far >= chunk and not text[e - 1].isspace() and (far >= 4 * chunk or text[e : e + 1] in (" ", "\n")):
            cuts.append(e)
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in pairwise(cuts)]


def encode(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of the whole text, as uint32."""
    encoder, _ = load(path, pattern)
    parts = [encoder.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, pattern, chunk, overlap)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    raw = load(path, pattern)[1]
    return b"".join([raw[i] for i in ids.tolist()])


def bpe_encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep and `ids` (array of int) for every row of docs; null and empty texts have no ids."""
    return map_texts(docs, list(keep), fields("ids array<int>"), lambda texts: {"ids": [encode(t, path, pattern).astype("<i4") for t in texts]}, text)


def bpe_decode(tokens: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep and `bytes`, the raw bytes of each row's ids joined; a null list gives empty bytes."""
    import pyarrow as pa
    from pyspark.sql import types as T

    source = tokens.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    out = T.StructType([*source.schema.fields[:-1], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        for b in batches:
            made = [decode(np.asarray(x), path, pattern) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=[*keep, "bytes"])

    return source.mapInArrow(run, out)


def common_cut(body: str, chunk: int, complete: bool, pattern: str) -> int | None:
    """Where a chunk's reading of body (from 0) and the next one's (from chunk) first share a boundary fit for a cut.

    complete: body reaches the text's end, else what follows could still move its last boundaries.
    """
    sure = len(body) if complete else len(body) - LOOK
    ends = lambda start: {e for e in sure_ends(body, start, len(body), pattern) if e <= sure}
    both = sorted(e for e in ends(0) & ends(chunk) if e > chunk and not body[e - 1].isspace())
    return next((e for e in both if body[e : e + 1] in (" ", "\n")), both[0] if both else None)


def _chunk_rows(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(tag, k, last, body): the chunks of the texts, with the overlap behind each; copies once."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                starts = range(0, len(text), chunk)
                for k, s in enumerate(starts):
                    row = [tag], [k], [k == len(starts) - 1], [text[s : s + chunk + overlap]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.binary(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["tag", "k", "last", "body"])

    rows = long.select("tag", "text").mapInArrow(run, "tag binary, k int, last boolean, body string")
    return rows.groupBy("tag", "k", "last").agg(F.first("body").alias("body"))


def _long_digests(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(tag, n_tokens, ids_sha256, decoded_sha256) of texts (tag, text) whose chunks are rows."""
    import pyarrow as pa

    chunks = checkpointed(_chunk_rows(long, chunk, overlap))

    def cuts(batches):
        for b in batches:
            pairs = zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)
            found = [0 if last else common_cut(body, chunk, len(body) < chunk + overlap, pattern) for body, last in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.int32())], names=["tag", "k", "last", "cut"])

    ends = checkpointed(chunks.mapInArrow(cuts, "tag binary, k int, last boolean, cut int"))
    unsure = ends.where("cut is null").select("tag").distinct()
    begins = ends.where("not last").select("tag", (F.col("k") + 1).alias("k"), (F.col("cut") - chunk).alias("begin"))
    ready = chunks.join(ends.drop("last"), ["tag", "k"]).join(begins, ["tag", "k"], "left").join(unsure, "tag", "left_anti")
    piece = F.expr("substring(body, coalesce(begin, 0) + 1, if(last, length(body), cut) - coalesce(begin, 0))")

    def ids(batches):
        for b in batches:
            made = [encode(t, path, pattern).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(made, pa.binary())], names=["tag", "k", "ids"])

    coded = ready.select("tag", "k", piece.alias("piece")).mapInArrow(ids, "tag binary, k int, ids binary")
    out = "tag binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def digests(batches):
        tag, n, a, d = None, 0, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([tag], pa.binary()), pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([d.hexdigest()])], names=["tag", "n_tokens", "ids_sha256", "decoded_sha256"])
        for b in batches:
            for t, made in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t != tag:
                    if tag is not None:
                        yield row()
                    tag, n, a, d = t, 0, hashlib.sha256(), hashlib.sha256()
                n += len(made) // 4
                a.update(made)
                d.update(decode(np.frombuffer(made, "<u4"), path, pattern))
        if tag is not None:
            yield row()

    whole = coded.repartition("tag").sortWithinPartitions("tag", "k").mapInArrow(digests, out)
    rest = long.join(unsure, "tag", "left_semi").dropDuplicates(["tag"])
    return whole.unionByName(_digested(rest, path, pattern, ["tag"], "text"))


def _digested(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str) -> DataFrame:
    def work(texts: list[str]) -> dict[str, list]:
        n, a, b = [], [], []
        for t in texts:
            ids = encode(t, path, pattern)
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_texts(docs, keep, fields("n_tokens bigint, ids_sha256 string, decoded_sha256 string"), work, text)


def bpe_digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", long_chars: int = LONG, chunk: int = ROW_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 for every row of docs.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded
    bytes. Null texts count as empty: no tokens, digests of nothing. A very long text is shared by
    many tasks, with the same result. Repeated rows each give a row, null ids stay; an empty table
    gives no rows; other columns of docs, clashing names among them, are not read.
    """
    is_long = F.coalesce(F.length(text) > long_chars, F.lit(False))
    # as good as never is a text as long, so the others are not sorted out
    long = docs.where(is_long).select(*keep, F.col(text).alias("text"), F.unhex(F.sha2(text, 256)).alias("tag"))
    if long.isEmpty():
        return _digested(docs, path, pattern, list(keep), text)
    found = _long_digests(long.select("tag", "text"), path, pattern, chunk, overlap)
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    others = _digested(docs.where(~is_long), path, pattern, list(keep), text)
    return others.unionByName(long.select(*(c for c in keep if c not in names), "tag").join(found, "tag").select(*others.columns))
