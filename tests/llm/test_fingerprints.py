"""Exact digests of canonical texts against brute force."""

import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from sparkyard.llm import fingerprints as fp
from sparkyard.llm.fingerprints import canonical, edited_fingerprints, fingerprints


def plain(t):
    nfc = lambda x: unicodedata.normalize("NFC", x)
    t = nfc(nfc(t or "").casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


TEXTS = ["", None, "A", "a ", "Straße", "STRASSE", "é É", "é é", "ﬁx", " x y\n", "x y", "İ", "ΑΣ ς", "日本", "🙂 Ａ", "a\x1fb", "a b", "\n"]


def test_canonical(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(canonical(F.col("t"))).collect()] == [plain(t) for t in TEXTS]


def expected(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited), float(plain(t) == plain(edited)), float(plain(t) == plain(after)))
    return out


def test_edited(spark, monkeypatch):
    for buckets in (3, 200):
        monkeypatch.setattr(fp, "BUCKETS", buckets)
        rng = random.Random(buckets)
        docs = [(i * 7 - 300, rng.choice(TEXTS)) for i in range(150)] + [(10**12, "long É " * 30000)]
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, fingerprint string").repartition(5)
        want, form_of = expected(docs), {}
        rows = edited_fingerprints(df).collect()
        assert len(rows) == len(docs)
        for r in rows:
            n, sha, form, edited, near, after = want[r.doc_id]
            assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near, after)
            assert form_of.setdefault(r.fingerprint, form) == form
            assert form_of.setdefault(r.edited_fingerprint, edited) == edited
        assert len(form_of) == len(set(form_of.values()))


def test_edges(spark):
    df = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (None, None)], "doc_id bigint, text string")
    assert edited_fingerprints(df).count() == 4
    assert edited_fingerprints(df.limit(0)).count() == 0
    assert [r.near_next for r in edited_fingerprints(df.where("doc_id = 3").limit(1)).collect()] == [1.0]


def test_equal_digests_are_told_apart(spark):
    weak = lambda form: F.substring(form, 1, 1)
    docs = [(i, t) for i, t in enumerate(TEXTS + ["ab cd", "ab ce", "ab cd", "abc", "xy", "ab  CE"])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want, form_of = expected(docs), {}
    for r in edited_fingerprints(df, digest=weak).collect():
        assert form_of.setdefault(r.fingerprint, want[r.doc_id][2]) == want[r.doc_id][2]
        assert form_of.setdefault(r.edited_fingerprint, want[r.doc_id][3]) == want[r.doc_id][3]
    assert len(form_of) == len(set(form_of.values())) and any("~" in f for f in form_of)


def test_cuts_below(spark):
    from sparkyard.llm.common import cuts_below

    rng = random.Random(4)
    for n in (0, 1, 2, 7, 8, 500):
        cuts = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)] + [5] * (n > 3)
        cuts.sort()
        keys = [*cuts, *(c + 1 for c in cuts), -(1 << 63), (1 << 63) - 1]
        df = spark.createDataFrame([(k,) for k in keys], "k bigint")
        assert [r[0] for r in df.select(cuts_below(F.col("k"), cuts)).collect()] == [sum(c <= k for c in cuts) for k in keys]


def test_fingerprints(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            assert (got[i] == got[j]) == (plain(a) == plain(b))
