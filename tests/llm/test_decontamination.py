"""Edit matching of benchmark items against brute force."""

import random

import pytest

from sparkyard.llm import decontamination as dc


def distance(pattern, text, anchored=False):
    """Least edits to a substring of text (a prefix if anchored), with the first end that has it."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [j if anchored else 0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], j), key=lambda x: x[0])
    return best


@pytest.mark.parametrize("anchored", [False, True])
def test_myers(anchored):
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        if rng.random() < 0.5:
            t += p[: rng.randrange(len(p) + 1)] + "x" + p[rng.randrange(len(p)) :]
        d, end = distance(p, t, anchored)
        got = dc.myers(p, t, len(p), anchored)
        assert got[0] == d and got[1] == (end if d < len(p) else 0)
        if d > 3:
            assert dc.myers(p, t, 3, anchored) == (4, 0)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(("the", "of", "an")) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.randrange(4, 40))) for i in range(25)] + [(100, "Short"), (101, ""), (102, None), (103, line(500))]
    items += [(110 + n, "".join(rng.choice("bcdfg") for _ in range(n))) for n in (1, 4, 9, 10, 15, 16)]
    docs = []
    for i in range(150):
        t = line(rng.randrange(60))
        if rng.random() < 0.6:
            p = list(rng.choice(items)[1] or "")
            for _ in range(int(len(p) * rng.choice((0, 0, 0.03, 0.09, 0.14)))):
                p[rng.randrange(len(p))] = rng.choice(("", "x", "qq"))
            t += "\n" + "".join(p).upper() + "  " + line(5)
        docs.append((i, t))
    return docs + [(900, None), (901, ""), (902, " short\n"), (903, "a short one"), (None, items[3][1]), (905, items[4][1]), (905, items[4][1]), (906, "the of " * 9000 + items[5][1])], items


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 900)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(dc, "BLOCK_CHARS", block)
    docs, items = made(seed)
    want = set()
    for d, t in docs:
        t = dc.normal(t or "")
        for i, x in items:
            x = dc.normal(x or "")
            if x and len(t) < 20000:
                n = distance(x, t)[0]
                if n <= int(dc.RATE * len(x)):
                    want.add((d, i, n))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = dc.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows if r.doc_id != 906} == want
    assert {i for _, i, n in want if n} & {120, 125, 126} and {i for _, i, _ in want} >= {100, 114, 119}
    assert (906, 5, 0) in {(r.doc_id, r.item_id, r.distance) for r in rows} and sum(r.doc_id == 905 and r.item_id == 4 for r in rows) == 2
    texts, by = {d: dc.normal(t or "") for d, t in docs}, dict(items)
    for r in rows:
        assert distance(dc.normal(by[r.item_id]), texts[r.doc_id][r.start : r.end])[0] <= r.distance
    hit = {r.doc_id for r in rows}
    left = dc.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in hit)


def test_empty(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contaminated(df, none).count() == 0 and dc.clean(df, none).count() == 1
    assert dc.contaminated(df.limit(0), none.union(spark.createDataFrame([(1, "an item of some length")], none.schema))).count() == 0
