"""Shards by bytes against what their law promises."""

import random
import zlib
from collections import Counter, defaultdict

from sparkyard.llm import sharding
from sparkyard.llm.sharding import shard_by_bytes


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, filled = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return [filled[s] for s in range(shards)]


def run(spark, docs, shards=16):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, size int")
    return check(shard_by_bytes(df, shards).collect(), docs, shards)


def test_near_equal_bytes(spark):
    rng = random.Random(1)
    docs = [(i, "x" * int(rng.paretovariate(1.1) * 30)) for i in range(4000)] + [(9000 + i, "copy of one text") for i in range(2000)]
    sizes = run(spark, docs)
    even = sum(sizes) / 16
    largest = max(len(t) for _, t in docs)
    assert max(sizes) - min(sizes) <= max(2.1 * even / sharding.LARGE, largest + 1)


def test_hot_key_is_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 8)
    monkeypatch.setattr(sharding, "SAMPLES_A_RANGE", 1)
    sizes = run(spark, [(i, "same") for i in range(3000)] + [(i, str(i)) for i in range(3000, 3500)], 7)
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 7


def test_same_shards_from_any_sample(spark, monkeypatch):
    docs = [(i, str(i) * (i % 50)) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    first = sorted(map(tuple, shard_by_bytes(df).collect()))
    monkeypatch.setattr(sharding, "RANGES", 3)
    monkeypatch.setattr(sharding, "SAMPLES_A_RANGE", 5)
    assert sorted(map(tuple, shard_by_bytes(df).collect())) == first


def test_edges(spark):
    assert run(spark, []) == [0] * 16
    run(spark, [(1, None)])
    run(spark, [(None, None), (None, "é"), (7, ""), (7, "twice"), (7, "twice"), (8, "long " * 50000)])
    assert run(spark, [(1, "a"), (2, "b")], 1) == [4]
