"""Near-duplicate documents at a similarity of word shingles: SimHash blocks and MinHash blocks.

Pairs at a Jaccard similarity of 0.8 or more have SimHash fingerprints 4 to 14 bits apart (of 64;
48 pairs in a corpus of 10,000), which no pigeonhole on fingerprints can reach: with the 3 bits of
`simhash` alone all of these would be lost. So rows are put into the buckets of the SimHash tables and, besides, into those of MinHash
bands, and every two rows of a bucket are judged by the share of equal values in signatures of
VALUES minima (8 bits of each), an estimate of the similarity with a standard error of 0.025.
Rows whose estimate is within MARGIN of the wanted similarity link loosely; the components of
loose links hold those of the true ones, and are searched again with the exact shingle sets.
Both searches work as in `simhash`: stars in place of all pairs, large groups in tiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fields, map_texts
from .components import connected_components
from .simhash import in_tiles, packed_majority, searched, shingles, tables

#: Minima of a signature, bands and minima of a band: at 0.8 a pair shares no band once in 20 million.
VALUES, BANDS, ROWS = 256, 32, 4
#: Over four standard errors of the estimate (at 0.8 it falls short 3 times in a million); rows of a tile in the search by signatures and in the exact one.
MARGIN, TILE, SETS = 0.12, 512, 256
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the shingles' hashes under VALUES hash functions."""
    short = np.unique((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32))
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 512):
        mixed = (short[a : a + 512, None] ^ _XOR) * _MUL
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def _described(texts: list[str], width: int) -> dict[str, list]:
    import xxhash

    out: dict[str, list] = {c: [] for c in ("words", "fp", "bands", "sig", "size")}
    for t in texts:
        digest = hashlib.blake2b(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest()
        grams = shingles(t, width)
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
        least = signature(h)
        bands = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
        out["words"].append(digest)
        out["fp"].append(np.uint64(packed_majority(h)).view(np.int64))
        out["bands"].append(np.array(bands, np.uint64).view(np.int64))
        out["size"].append(8 * len(h))
        # high bytes of mixed minima
        out["sig"].append(((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
    return out


def similar(least: float):
    """Whether signatures of 8-bit values speak for a similarity of at least `least`."""
    # unequal minima agree in 8 bits once in 256
    needed = VALUES * (least + (1 - least) / 256)

    def near(rest: np.ndarray, one: np.ndarray) -> np.ndarray:
        return (rest == one).sum(axis=-1) >= needed

    return near


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _sets(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = [np.frombuffer(x, "<u8") for x in column.to_pylist()]
    return out


def jaccard_at(least: float):
    """Which sets (sorted, distinct) have a Jaccard similarity of at least `least` with one; empty sets equal each other."""

    def near(rest: np.ndarray, one: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), bool)
        n = len(one)
        for i, other in enumerate(rest):
            m = len(other)
            if min(n, m) >= least * max(n, m):
                both = len(np.intersect1d(one, other, assume_unique=True))
                hit[i] = both >= least * (n + m - both)
        return hit

    return near


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, tag, content): the sorted distinct digests of each text's shingles."""
    import xxhash

    def work(texts: list[str]) -> dict[str, list]:
        sets = [np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in shingles(t, width)], "<u8")) for t in texts]
        return {"content": [x.tobytes() for x in sets]}

    return map_texts(docs, ["node"], fields("content binary"), work)


def _tag(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 3, id_col: str = "doc_id", text: str = "text", tile: int = TILE, sets: int = SETS) -> DataFrame:
    """(content_id, root, least): classes of equal word sequences, their group, their own first row.

    A class has a number of its own, not a hash; its rows have equal 128-bit digests of their words.
    least is the struct (last, id, tag) of the row that comes first: the smallest id (null: after
    all others) and the digest of its text (128 bits). Rows group when a chain of pairs at `similarity` or
    more joins them.
    """
    own = docs.select(F.col(id_col).alias("id"), _tag(text).alias("tag"), F.col(text).alias("text"))
    described = map_texts(own, ["id", "tag"], fields("words binary, fp bigint, bands array<bigint>, sig binary, size bigint"), lambda texts: _described(texts, width))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "tag")
    classes = described.groupBy("words").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    # numbers are fixed by the checkpoint that they are written to
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("content_id"), "least", "fp", "bands", "sig", "size"))
    keys = F.concat(F.col("bands"), tables(F.col("fp"), distance))
    met = in_tiles(classes.select(F.col("content_id").alias("node"), F.explode(keys).alias("key")), tile)
    met = met.join(classes.select(F.col("content_id").alias("node"), F.col("sig").alias("content")), "node")
    loose = checkpointed(connected_components(searched(met, similar(similarity - MARGIN), _bytes)))
    # the exact search, inside loose components: a row of each class with its shingles
    held = classes.join(loose, classes["content_id"] == loose["node"], "left_semi").select(F.col("content_id").alias("node"), F.col("least.id").alias("__id"), F.col("least.tag").alias("__tag"))
    texts = own.join(held, own["id"].eqNullSafe(held["__id"]) & (own["tag"] == held["__tag"])).select("node", "text")
    members = loose.select("node", F.col("root").alias("key")).join(classes.select(F.col("content_id").alias("node"), "size"), "node")
    close = in_tiles(members, sets, "size").join(_shingle_sets(texts, width), "node")
    roots = connected_components(searched(close, jaccard_at(similarity), _sets, pairwise=False))
    grouped = classes.select("content_id", "least").join(roots.withColumnRenamed("node", "content_id"), "content_id", "left")
    return grouped.select("content_id", F.coalesce("root", "content_id").alias("root"), "least")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with the columns of docs: that of the smallest id.

    Null and empty texts form one group; of rows with one id and text, that whose other columns have
    the least digest stays, of fully repeated rows one; rows of one id with different texts are told apart; whole texts count, however long, and large groups of long ones
    are searched in tiles bounded by bytes; further columns stay; an empty table gives no rows.
    """
    groups = near_duplicate_groups(docs, width, similarity, id_col=id_col, text=text)
    # a group's rows meet in the partial minima, whatever its size
    first = groups.groupBy("root").agg(F.min("least").alias("first"))
    stay = first.select(F.col("first.id").alias("__id"), F.col("first.tag").alias("__tag"))
    tag = _tag(text)
    kept = docs.join(stay, (docs[id_col].eqNullSafe(stay["__id"])) & (tag == stay["__tag"]), "left_semi")
    twice = docs.groupBy(F.col(id_col), tag).agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return kept
    whole = F.struct(*(F.col(c) for c in docs.columns))
    rows = kept.select(F.col(id_col).alias("id"), tag.alias("tag"), whole.alias("row"), F.md5(F.to_json(whole)).alias("digest"))
    return rows.groupBy("id", "tag").agg(F.min_by("row", "digest").alias("row")).select("row.*")
