"""SimHash links and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkyard.llm.components import connected_components
from sparkyard.llm.simhash import blocked, close_links, fingerprint, in_tiles, simhash_components


def plain_fingerprint(text, width):
    words, lower = [], (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in " \t\n\v\f\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \n", "One", "One two", "a b c", "É A B c d e\x1fx f A b c", "w " * 500])
def test_fingerprint(text):
    assert fingerprint(text, 3) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("tile,hot", [(3, 1000), (3, 4), (2048, 2), (2048, None)])
def test_links_join_what_brute_force_joins(spark, tile, hot):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(8)):
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {7 ^ (1 << i) for i in range(64)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = [signed(x) for x in fps]
    want = plain_components(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    links = close_links(spark.createDataFrame([(x,) for x in nodes], "fp bigint"), 3, tile, hot)
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


def test_a_hot_bucket_is_cut_by_further_bits(spark):
    n = 60000
    fps = spark.range(n).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)).alias("fp")).distinct()
    whole = fps.count()
    met = in_tiles(blocked(fps, 3, 8 * 2048), 2048)
    # one table's bucket holds all rows: 4 rows for each in place of a row a tile
    assert met.count() <= (19 + 4) * whole
    assert met.groupBy("key", "t", "u").count().agg(F.max("count")).first()[0] <= 2 * 2048
    links = spark.createDataFrame([(1 << 40,), ((1 << 40) + 7,), ((1 << 40) + 15,)], "fp bigint").union(fps)
    got = close_links(links, 3)
    near = got.where(F.col("a").isin(1 << 40, (1 << 40) + 7, (1 << 40) + 15)).collect()
    assert {(1 << 40) + 7, (1 << 40) + 15} <= {x for r in near for x in r}


def test_a_bucket_with_a_third_of_all_rows_is_split(spark):
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.expr("id div 2"))
        met = in_tiles(spark.range(60000).select(F.col("id").alias("node"), key.cast("bigint").alias("key")), 2048).repartition("key", "t", "u")
        met.collect()
        assert "SortMergeJoin(skew=true)" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert connected_components(links.limit(0)).count() == 0


def test_documents(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "Delta", "é", "zeta"]
    docs = []
    for i in range(60):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(300)]
        docs.append((1000 - 3 * i, " ".join(base), "x"))
        base[5] = "changed"
        docs.append((3 * i + 1, " ".join(base), "y"))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, " \n", None), (5003, "word", "z"), (5003, "word", "z"), (None, "word", "z"), (5004, "w " * 50000, "z")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, fp string")
    got = simhash_components(df.select("doc_id", "text", "fp"), 3, 3).collect()
    assert len(got) == len(docs)
    fps = {(d, t): plain_fingerprint(t, 3) for d, t, _ in docs}
    roots = plain_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    want = sorted(((d if d is not None else -1), f, least[roots[f]]) for d, f in ((d, fps[d, t]) for d, t, _ in docs))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash_components(df.limit(0), 3, 3).count() == 0
