"""Byte-level BPE and token counts against the libraries."""

import hashlib
import random
import time

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers as P  # noqa: E402

from sparkyard.llm import byte_bpe, token_counts  # noqa: E402
from sparkyard.llm.common import by_bytes  # noqa: E402

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "!", "日本", "don't", "'", "'re", "we'll've", "r", "aaaaaaaaaaaaaaa", "   \n\n  ", "%%%", "▁", "\xa0", "<s>", "<|endoftext|>", "🙂", "\x00", "\x1c", "\x85", "\n\n"]
EDGES = [(1, "plain text, twice"), (1, "plain text, twice"), (2, None), (3, ""), (None, "no id"), (4, "word " * 40000), (5, "x" * 50000), (6, " \n" * 30000)]


def texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (20, 8), (50, 1), (33, 0)])
def test_chunks_encode_as_the_library(chunk, overlap):
    encoder, _ = byte_bpe.load(RANKS, P.PATTERN)
    for t in texts(chunk, 600, 150):
        ids = byte_bpe.encode(t, RANKS, P.PATTERN, chunk, overlap)
        assert ids.tolist() == encoder.encode_ordinary(t), t
        assert byte_bpe.decode(ids, RANKS, P.PATTERN) == t.encode()
        assert byte_bpe.stitched(t, P.PATTERN, chunk, overlap) == byte_bpe.sure_ends(t, 0, len(t), P.PATTERN)


def test_long_pre_tokens_take_bounded_time():
    began = time.time()
    for t in ("a" * 400_000, " " * 400_000, "ab " * 200_000):
        ids = byte_bpe.encode(t, RANKS, P.PATTERN)
        assert byte_bpe.decode(ids, RANKS, P.PATTERN) == t.encode()
    assert time.time() - began < 60


@pytest.mark.parametrize("limit", [5, 23])
def test_counts_of_split_texts(limit):
    model, splits = token_counts.load(MODEL)
    assert splits
    for t in texts(limit, 1500, 150):
        assert token_counts.count_batch([t], MODEL, limit) == [len(model.encode(t))], t
        assert sum(map(len, token_counts.split_safe(t, limit))) <= len(t)


def test_batches_are_balanced():
    sizes = [10, 5, 300, 1, 1, 99, 1]
    parts = list(by_bytes(["x" * n for n in sizes], 100))
    assert parts == [(0, 2), (2, 3), (3, 5), (5, 7)] and list(by_bytes([])) == []
    # bytes of UTF-8, not characters
    assert list(by_bytes(["日本" * 10, "ab", "é" * 20], 60)) == [(0, 1), (1, 3)]


def frame(spark):
    return spark.createDataFrame([(d, t, "clash") for d, t in EDGES], "doc_id bigint, text string, n_tokens string")


def test_digests(spark):
    encoder, _ = byte_bpe.load(RANKS, P.PATTERN)
    rows = byte_bpe.bpe_digests(frame(spark), RANKS, P.PATTERN).collect()
    want = sorted((d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in EDGES for ids in [encoder.encode_ordinary(t or "")])
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert byte_bpe.bpe_digests(frame(spark).limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (300, 60)])
def test_chunks_as_rows(spark, chunk, overlap):
    """Long texts shared by tasks, some of them without a common boundary, copies and repeated ids among them."""
    encoder, _ = byte_bpe.load(RANKS, P.PATTERN)
    docs = [(i, t) for i, t in enumerate(texts(5, 150, 400))] + [(9, "x" * 2000), (9, "x" * 2000), (None, " \n" * 900), (200, "one two, three. " * 200), (201, "é" * 100 + " 日本 " * 90), (202, None), (203, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, tag int").repartition(3)
    rows = byte_bpe.bpe_digests(df, RANKS, P.PATTERN, long_chars=100, chunk=chunk, overlap=overlap).collect()
    want = sorted((-1 if d is None else d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs for ids in [encoder.encode_ordinary(t or "")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    cuts = [byte_bpe.common_cut(t[: chunk + overlap], chunk, len(t) < chunk + overlap, P.PATTERN) for _, t in docs if t and len(t) > chunk]
    assert None in cuts and sum(c is not None for c in cuts) > 20


def test_round_trip(spark):
    ids = byte_bpe.bpe_encode(frame(spark), RANKS, P.PATTERN)
    back = byte_bpe.bpe_decode(ids, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back) == sorted((d or 0, (t or "").encode()) for d, t in EDGES)


def test_counts(spark):
    model, _ = token_counts.load(MODEL)
    rows = token_counts.token_counts(frame(spark), MODEL, limit=100).collect()
    want = sorted((d or 0, len((t or "").encode()), n, n > 100) for d, t in EDGES for n in [len(model.encode(t or ""))])
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.token_counts(frame(spark).limit(0), MODEL).count() == 0
