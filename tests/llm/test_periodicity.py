"""Periodic runs against a brute-force search."""

import hashlib
import random

import numpy as np
import pytest

from sparkyard.llm import periodicity
from sparkyard.llm.queries import op11_periodic_runs, with_period


def brute(words, least=12):
    """Every period's stretches of equal words; of one stretch's periods the smallest is its own."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count):
    """Word lists full of repeats of all kinds: few letters, powers, Fibonacci words, repeats apart from each other."""
    r = random.Random(seed)
    for k in range(count):
        kind, n = k % 6, r.randint(0, 120)
        if kind == 0:
            out = r.choices("ab", k=n)
        elif kind == 1:
            out = r.choices("abc", weights=[8, 2, 1], k=n)
        elif kind == 2:
            unit = r.choices("abcdefg", k=r.randint(1, 20))
            out = r.choices("xyz", k=r.randint(0, 9)) + (unit * 9)[: r.randint(1, 90)] + r.choices("xyz", k=r.randint(0, 9))
        elif kind == 3:
            a, b = ["a"], ["a", "b"]
            while len(b) < n:
                a, b = b, b + a
            out = b
        elif kind == 4:
            piece = r.choices("abcd", k=r.randint(1, 8)) * r.randint(1, 4)
            out = sum((piece[r.randint(0, 3) :] + [f"u{i}"] * r.randint(0, 2) for i in range(r.randint(1, 12))), [])
        else:
            out = [str(i) for i in range(n)]
        yield [w.encode() for w in out]


@pytest.mark.parametrize("least", [2, 5, 12])
@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_brute_force(seed, least):
    words = list(texts(seed, 150))
    assert periodicity._portion(words, least) == [brute(w, least) for w in words]


def test_long_periodic_text():
    words = [b"a", b"b", b"c"] * 30_000
    assert periodicity._portion([words], 12) == [[(0, 90_000, 3)]]
    assert periodicity._collapsed(words, [(0, 90_000, 3)]) == b"a b c"


def test_chance_hits_of_passages_change_nothing(monkeypatch):
    monkeypatch.setattr(periodicity, "_repeated", lambda ids, doc, width: np.ones(len(ids), bool))
    words = list(texts(9, 60))
    assert periodicity._portion(words, 12) == [brute(w) for w in words]


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " \t".join(w.decode() for w in ws), "x") for i, ws in enumerate(texts(4, 60))]
    rows += [(7, rows[7][1], "y"), (None, "a b " * 20, "z"), (900, None, "z"), (901, "", "z"), (902, "\x0b\x0c\r", "z"), (903, "é\x1c\xa0 " * 30, "z"), (904, " ".join(r.choices("abcdefgh", k=30_000)), "z")]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        words = with_period(doc_id, (text or "").encode().split())
        runs = brute(words) if len(words) < 1000 else periodicity._portion([words], 12)[0]
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), collapsed(words, runs)))
        want.append((doc_id, len(runs), s, n, q, n and 1000 * n // q, *digests))
    assert got == sorted(want, key=repr)


def test_edit_of_the_contract():
    words = [b"%d" % i for i in range(100)]
    edited = next(e for i in range(100) if (e := with_period(i, words)) != words)
    assert len(edited) == 100 and brute(edited, 2)
    assert with_period(None, []) == []


def test_empty_table(spark):
    assert periodicity.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string, kept int")).collect() == []
