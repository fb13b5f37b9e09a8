"""Removal of repeated windows against brute force."""

import random
import re

import pytest

from sparkyard.llm import substrings
from sparkyard.llm.substrings import K, remove_repeats


def plain(docs):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    rank = [float("inf") if d is None else d for d, _ in docs]
    least = {}
    for r, ws in zip(rank, split):
        for i in range(len(ws) - K + 1):
            key = tuple(ws[i : i + K])
            least[key] = min(r, least.get(key, r))
    out = []
    for (d, _), r, ws in zip(docs, rank, split):
        gone = set()
        for i in range(len(ws) - K + 1):
            if least[tuple(ws[i : i + K])] < r:
                gone |= set(range(i, i + K))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(6))
    passages = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    docs = []
    for i in rng.sample(range(1000), n):
        ws = []
        for _ in range(rng.randrange(5)):
            ws += [word() for _ in range(rng.randrange(30))] + rng.choice(passages) * rng.choice((1, 1, 3))
        if rng.random() < 0.3 and ws:
            ws[rng.randrange(len(ws))] = "edit"
        docs.append((i, rng.choice((" ", "\n", " \t")).join(ws)))
    docs += [(docs[0][0], docs[0][1]), (docs[1][0], docs[2][1]), (None, docs[3][1]), (None, "x " * 40), (5000, None), (5001, ""), (5002, "x " * 300), (5003, "é\xa0ü " * 20)]
    return docs


@pytest.mark.parametrize("seed,portion,bits", [(1, 300, 64), (2, 4000, 64), (3, 1 << 22, 64), (4, 700, 2), (5, 1 << 22, 3)])
def test_against_brute_force(spark, seed, portion, bits):
    """Portions of any size, and words whose hashes collide."""
    docs = made(seed) + [(6000, " ".join(f"w{i % 977}" for i in range(60000))), (6001, "w5 " + " ".join(f"w{i % 977}" for i in range(300)))]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id bigint, text string, spans string").repartition(3)
    rows = remove_repeats(df, portion_bytes=portion, bits=bits).collect()
    if bits < 64:
        assert substrings.false_spans(df, substrings.proposed_spans(df, bits=bits)).count() > 0
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=key) == sorted(plain(docs), key=key)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in rows:
        for s in r.spans:
            mine = [ws[s.start : s.start + s.words] for ws in texts[r.doc_id]]
            assert any(ws[s.source_start : s.source_start + s.words] in mine for ws in texts[s.source_id])
            assert r.doc_id is None or s.source_id < r.doc_id


def test_packing():
    rng = random.Random(0)
    import numpy as np

    row = np.sort(np.array([rng.randrange(5) for _ in range(60)]))
    word = np.concatenate([np.cumsum(np.array([rng.choice((1, 1, 4)) for _ in range((row == r).sum())], int)) for r in range(5)])
    anchor = np.array([rng.choice((3, 9)) for _ in range(60)], np.uint64)
    edge = np.array([rng.getrandbits(48) for _ in range(60)], np.uint64)
    rank, tag = np.array([-5, 3, 3, 8, 1 << 62]), np.array([1, -2, 3, 4, 5])
    got = substrings._unpack(substrings._pack(row, word, anchor, edge, rank, tag))
    assert (got[0][got[2]] == rank[row]).all() and (got[1][got[2]] == tag[row]).all()
    assert all((a == b).all() for a, b in zip(got[3:], (word, anchor, edge)))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_edges_under_two_anchors():
    import numpy as np

    edge, anchor = np.array([5, 5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 2, 1], np.uint64)
    later, source = substrings._later_copies(edge, anchor, np.array([1, 1, 2, 2, 9]))
    assert dict(zip(later.tolist(), source.tolist())) == {2: 0, 3: 1}


def test_a_table_without_an_estimate_is_counted(spark, monkeypatch):
    docs = made(9)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(substrings, "plan_bytes", lambda _: None)
    monkeypatch.setattr(substrings, "PART_BYTES", 1 << 10)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df).collect()), key=key) == sorted(plain(docs), key=key)
