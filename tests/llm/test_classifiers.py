"""Quality and toxicity: held-out accuracy, calibration, edges."""

import random
import zlib

import numpy as np
import pytest

from sparkyard.llm import quality as quality_module
from sparkyard.llm import toxicity as tox
from sparkyard.llm.labelled import fold, sample, with_texts, within_bytes
from sparkyard.llm.quality import QualityModel, isotonic, quality, statistics
from sparkyard.llm.toxicity import sentences, toxicity

EDGES = [(9001, None), (9002, ""), (9003, "word " * 60000), (9004, "\n \n"), (None, "no id"), (9005, "same"), (9005, "same")]


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice(("an", "er", "ing", "ou")) + rng.choice(("st", "nd", "")) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(2), [], []
    for i in range(900):
        ws = words(rng, rng.randrange(20, 120))
        for k in range(9, len(ws), 10):
            ws[k] += "."
        good, bad = rng.random() < 0.8, rng.random() < 0.25
        if bad:
            for _ in range(rng.randrange(1, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(("vile", "zorgh" + rng.choice("abcdefgh") * 2))
        if not good:
            ws = [w + rng.choice(("$$$", "%%%", "###")) for w in ws]
        docs.append((i, " ".join(ws), 0.5))
        labels.append((i, int(good), int(bad)))
    docs += [(d, t, 0.5) for d, t in EDGES]
    labels += [(5, None, None), (None, 1, 1), (777777, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, score double"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        {d: (q, t) for d, q, t in labels if d is not None and q is not None},
    )


@pytest.mark.parametrize("which,run,mod,held,least", [(0, quality, 5, 0, 0.97), (1, toxicity, 4, 2, 0.9)])
def test_held_out_accuracy(corpus, which, run, mod, held, least):
    docs, labels, truth = corpus
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % mod == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id][which])
    assert len(right) > 100 and np.mean(right) >= least


def test_offending_sentences(corpus):
    docs, labels, truth = corpus
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [r for r in toxicity(docs, labels).collect() if r.offending]
    assert len(found) > 50
    blamed = [texts[r.doc_id][s.start : s.end] for r in found for s in r.offending]
    assert np.mean([("vile" in b) or ("zorgh" in b) for b in blamed]) > 0.9


def test_no_labels(corpus):
    docs, labels, _ = corpus
    assert quality(docs, labels.limit(0)).count() == docs.count() == toxicity(docs, labels.limit(0)).count()
    assert quality(docs.limit(0), labels).count() == 0 == toxicity(docs.limit(0), labels).count()


def test_sample_is_bounded_and_repeatable(corpus):
    _, labels, truth = corpus
    chosen, weights = sample(labels, "toxic", fold("doc_id", 4) != 2, (40, 30))
    a, b = (sorted(map(tuple, chosen.collect())) for _ in range(2))
    assert a == b and len(a) == 70 and all(x > 1 for x in weights)
    assert all(truth.get(d, (1, 1))[1] == y and zlib.crc32(str(d).encode()) % 4 != 2 for d, y, _ in a)


def test_rows_of_the_kernel_width_are_a_parameter(corpus, monkeypatch):
    docs, labels, _ = corpus
    seen, moments = [], quality_module._moments
    monkeypatch.setattr(quality_module, "_moments", lambda *args: seen.append(moments(*args)) or seen[-1])
    for n in (quality_module.WIDTH_ROWS, 50):
        quality_module.fit_quality(docs, labels, fold("doc_id", 5) != 0, width_rows=n)
    assert [len(few) for _, _, few in seen] == [400, 50]


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    knots, values = isotonic(x, y, np.ones(5))
    assert values.tolist() == [0, 0.5, 1] and knots.tolist() == [1, 2.5, 4.5]


def test_sentences():
    text = "One two. É three!\nfour " + "w " * 150
    found = sentences(text)
    raw = text.encode().lower()
    assert [w for _, _, ws in found for w in ws] == raw.translate(tox._FOLD).split()
    assert all(raw[a:b].translate(tox._FOLD).split() == ws for a, b, ws in found)
    assert [len(ws) for _, _, ws in found] == [2, 2, 151]


def test_noisy_or_against_brute_force():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 5, 2])
    s, y, weight = rng.normal(size=counts.sum()) * 2, np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 0.5, 1, 3.0])

    def plain(s):
        total, at = 0.0, 0
        for n, label, k in zip(counts, y, weight, strict=True):
            clean = np.prod([1 - 1 / (1 + np.exp(-x)) for x in s[at : at + n]])
            total -= k * (np.log(1 - clean) if label else np.log(clean))
            at += n
        return total / weight.sum()

    loss, slope = tox.loss_and_slope(s, counts, y, weight)
    assert loss == pytest.approx(plain(s), abs=1e-6)
    for i in range(len(s)):
        step = np.eye(len(s))[i] * 1e-5
        assert slope[i] == pytest.approx((plain(s + step) - plain(s - step)) / 2e-5, abs=1e-6)


def test_scores_against_brute_force(spark):
    model = tox.ToxicityModel({b"=vile": 2.0, b"zor": 1.5, b"=fine": -1.0}, -3.0, 0.9, 0.2)
    texts = ["A vile day. Fine zorgh! all fine", "", None, "fine " * 500 + "vile " * 300 + ". zork", "no words known\nvile"]
    rows = tox.toxicity_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in rows:
        clean = 1.0
        for sentence in (texts[r.doc_id] or "").lower().replace("!", ".").replace("\n", ".").split("."):
            if ws := sentence.split():
                z = -3.0 + sum(2.0 * (w == "vile") + 1.5 * w.startswith("zor") - 1.0 * (w == "fine") for w in ws)
                clean *= 1 - 1 / (1 + np.exp(-z))
        x = np.clip(np.log(max(1 - clean, 1e-9)) - np.log(max(clean, 1e-300)), -20, 20)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(0.9 * x + 0.2))), abs=1e-6) and r.predicted == (r.score >= 0.3)


def test_ridge_weights_against_one_plain_solve(corpus):
    docs, labels, truth = corpus
    model = quality_module.fit_quality(docs, labels, fold("doc_id", 5) != 0, features=20)
    chosen, stands_for = sample(labels, "quality", fold("doc_id", 5) != 0, quality_module.PER_CLASS)
    rows = with_texts(docs, chosen).where("part > 0").collect()
    f, y = model.features(statistics([r.text for r in rows])), np.array([r.y for r in rows], float)
    w = np.where(y == 1, stands_for[1], stands_for[0])
    ridge = quality_module.RIDGE * max(w.sum(), 1) * np.eye(f.shape[1])
    assert np.allclose(model.weights, np.linalg.solve(f.T @ (f * w[:, None]) + ridge, f.T @ (w * y)), atol=1e-6)


def test_repeated_ids_count_once_and_bytes_are_bounded(corpus, spark):
    docs, labels, _ = corpus
    chosen, stands_for = sample(labels, "toxic", fold("doc_id", 4) != 2, (40, 30))
    n = chosen.join(docs, "doc_id").count()
    many = docs.union(docs).union(docs)
    rows = with_texts(many, chosen)
    assert rows.count() == n
    few, weights = within_bytes(rows, stands_for, 4000)
    kept = few.collect()
    assert 2 <= len(kept) < n and sum(len(r.text.encode()) for r in kept) <= 4000
    for y in (0, 1):
        assert weights[y] * sum(r.y == y for r in kept) == pytest.approx(stands_for[y] * sum(r.y == y for r in rows.collect()))
    assert within_bytes(rows, stands_for, 1 << 30)[0].count() == n and within_bytes(rows.limit(0), stands_for, 9)[0].count() == 0


def test_statistics_are_finite():
    assert np.isfinite(statistics(["", "a", "\n" * 9, "é" * 10000, "A1|!$ " * 50])).all()
    assert QualityModel.__dataclass_params__.frozen
