"""The pipeline's stages and the near-duplicate stage against brute force."""

import random

import pytest

from sparkyard.llm import near_duplicates as nd
from sparkyard.llm.near_duplicates import drop_near_duplicates


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus(seed):
    rng, docs = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    for g in range(40):
        base = [word() for _ in range(rng.randrange(80, 400))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            ws = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 6, 9, 60))):
                ws[rng.randrange(len(ws))] = word()
            docs.append(rng.choice((" ", "\n")).join(ws))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,tile", [(1, 2048), (2, 4)])
def test_near_duplicates(spark, seed, tile):
    texts = corpus(seed)
    docs = [(7 * i, t, 1) for i, t in enumerate(texts)] + [(9000, None, 1), (9001, "", 1), (9002, "one", 1), (9003, "One", 1), (None, "no id here", 1), (9004, "twice", 1), (9004, "twice", 1), (9005, "long " * 70000, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, id int").repartition(3)
    sets = [shingles(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            if s >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    kept = drop_near_duplicates(df) if tile == 2048 else None
    if kept is None:
        found = nd.near_duplicate_groups(df, tile=tile, sets=2)
        least = {}
        for r in found.collect():
            least[r.root] = min(least.get(r.root, (True, 0)), (r.least.last, r.least.id or 0))
        kept_ids = sorted(-1 if last else i for last, i in least.values())
    else:
        assert kept.columns == df.columns
        kept_ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    for members in groups.values():
        stay = [i for i in members if (-1 if docs[i][0] is None else docs[i][0]) in kept_ids]
        assert len({docs[i][0] for i in stay}) == 1
    assert len(kept_ids) == len(set(kept_ids))
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_and_text_keep_the_same_one(spark):
    rows = [(1, "the same words in every row", i) for i in range(50)] + [(2, "other words that stand alone", 3)]
    kept = [sorted(map(tuple, drop_near_duplicates(spark.createDataFrame(r, "doc_id bigint, text string, extra int").repartition(n)).collect())) for n, r in ((1, rows), (4, rows[::-1]), (3, rows[20:] + rows[:20]))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = nd.signature(x[:900]), nd.signature(x[100:])
    assert abs((a == b).mean() - 0.8) < 0.1


def test_pairs_right_at_the_similarity_are_seen():
    import numpy as np

    # 80 of 100 words in common, 10,000 pairs
    texts = [" ".join(f"{i}w{k}" for k in range(a, a + 90)) for i in range(10000) for a in (0, 10)]
    made = nd._described(texts, 1)
    sig = np.frombuffer(b"".join(made["sig"]), np.uint8).reshape(-1, 2, nd.VALUES)
    bands = np.array(made["bands"]).reshape(len(sig), 2, -1)
    near = nd.similar(0.8 - nd.MARGIN)
    assert all(near(s[:1], s[1]).all() for s in sig)
    assert (bands[:, 0] == bands[:, 1]).any(axis=1).all()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(500)]
    word = lambda: rng.choice(vocab)
    docs, labels = [], []
    item = " ".join(word() for _ in range(30))
    for i in range(400):
        ws, good = [word() for _ in range(rng.randrange(40, 200))], rng.random() < 0.7
        if i % 50 == 7:
            ws += item.split()
        if i % 50 == 8:
            ws += ["x@y.org"]
        docs.append((i, " ".join(w if good else w.upper() + "$$$" for w in ws), "en", "s", 0))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1], "en", "s", 0) for i in range(20)] + [(2000, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    current, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, folder)
        assert out.columns == current.columns
        out.write.parquet(f"{folder}/{name}")
        current = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in current.collect()}
    good = {i for i, q, _ in labels if q}
    assert len({i for i in seen["quality"] if i < 1000} ^ good) < 8
    assert seen["simhash_near_dedup"].keys() == {i for i in seen["quality"] if not (1000 <= i < 2000 and i - 1000 in seen["quality"])}
    assert seen["decontamination"].keys() == {i for i, t in seen["simhash_near_dedup"].items() if item not in (t or "")}
    assert all("x@y.org" not in (t or "") for t in seen["pii"].values()) and any("[EMAIL]" in (t or "") for t in seen["pii"].values())
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == seen["pii"].keys() and all(r.n_tokens > 0 for r in rows if seen["pii"][r.doc_id])


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and very long ones, repeated rows, further columns, empty tables."""
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, __tag string, __tag0 int"
    long = " ".join(f"w{i % 991}" for i in range(60000))
    rows = [(None, "no id here at all", "en", "s", 17, 0.5, "t", 1), (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 0.1, "t", 1), (3, "twice said and done", "en", "s", 19, 0.1, "t", 1), (3, "twice said and done", "en", "s", 19, 0.1, "t", 1), (4, long, "en", "s", len(long), 0.1, "t", 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, columns in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {"quality": 6, "simhash_near_dedup": 4, "decontamination": 6, "pii": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == kept[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 6
