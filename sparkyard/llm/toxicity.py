"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or.

A document is a bag of sentences; a sentence's score is a logistic function of its words; the
document is toxic unless every sentence is clean: 1 - prod(1 - p). Weights are trained from
document labels alone, and then name the sentences that carry the blame.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fields, map_texts
from .labelled import fold, sample, with_texts, within_bytes

#: Most labelled rows of each class that a fit reads, bytes of their texts, words that a worker remembers.
PER_CLASS, MOST_BYTES, REMEMBERED = (2500, 2500), 48 << 20, 300_000
#: Bytes of the word beginnings that are features beside the word.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Letters, digits and bytes beyond ASCII stay; ends of sentences become line feeds, the rest spaces.
_FOLD = bytes(10 if b in b".!?\n" else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def sentences(text: str) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the sentences with words, in bytes of the UTF-8 text."""
    out, at = [], 0
    for line in text.encode("utf-8", "surrogatepass").lower().translate(_FOLD).split(b"\n"):
        if words := line.split():
            out.append((at, at + len(line), words))
        at += len(line) + 1
    return out


def word_features(word: bytes) -> list[bytes]:
    """The word, and its beginnings: unseen words of a known stem score as the stem."""
    return [b"=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, some of them empty."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class _Weights(dict):
    """Weight of each word met, worked out once."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        get = self.weights.get
        self[word] = w = sum(get(f, 0.0) for f in word_features(word))
        return w


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float
    slope: float
    offset: float

    def calibrated(self, clean: np.ndarray) -> np.ndarray:
        """Score from the log-probability that every sentence is clean."""
        return 1 / (1 + np.exp(-(self.slope * _logit(clean) + self.offset)))


def _logit(clean: np.ndarray) -> np.ndarray:
    clean = np.minimum(clean, -1e-9)
    return np.clip(np.log(-np.expm1(clean)) - clean, -20, 20)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _vocabulary(vocab: list[bytes], doc_words: np.ndarray, fit: np.ndarray, least_docs: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Features that at least `least_docs` fitting texts hold; (word, feature) pairs of the vocabulary.

    doc_words: distinct text * len(vocab) + word.
    """
    docs, words = np.divmod(doc_words, max(len(vocab), 1))
    uses = np.bincount(words[fit[docs]], minlength=len(vocab))
    place: dict[bytes, int] = {}
    rows, cols = array("q"), array("q")
    for i, word in enumerate(vocab):
        # a word that too few texts hold is no feature, though its beginnings may be
        for f in word_features(word)[int(uses[i] < least_docs) :]:
            rows.append(i)
            cols.append(place.setdefault(f, len(place)))
    rows, cols = np.frombuffer(rows, np.int64), np.frombuffer(cols, np.int64)
    often = np.bincount(cols, weights=uses[rows], minlength=len(place)) >= least_docs
    rows, cols = rows[often[cols]], cols[often[cols]]
    # texts that hold each feature, a few hundred texts at a time
    first = np.searchsorted(rows, np.arange(len(vocab)))
    many = np.searchsorted(rows, np.arange(len(vocab)), side="right") - first
    held = np.zeros(len(place), np.int64)
    for a in range(0, len(fit), 250):
        own = slice(*np.searchsorted(docs, [a, a + 250]))
        d, w = docs[own][fit[docs[own]]], words[own][fit[docs[own]]]
        n = many[w]
        at = np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(d, n) * len(place) + cols[at])
        held += np.bincount(pairs % max(len(place), 1), minlength=len(place))
    known = held >= least_docs
    names = list(place)
    keep = np.flatnonzero(known)
    new = np.full(len(place), -1)
    new[keep] = np.arange(len(keep))
    used = known[cols]
    return [names[i] for i in keep], rows[used], new[cols[used]]


def loss_and_slope(s: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted mean of the noisy-or's negative log-likelihood, and its slope in each sentence's score s.

    counts: sentences of each text; a text's chance to be clean is the product of its sentences'.
    """
    clean = np.minimum(-_sums(_softplus(s), counts), -1e-9)
    total = max(1.0, weight.sum())
    loss = -(weight * np.where(y == 1, np.log(-np.expm1(clean)), clean)).sum() / total
    blame = np.where(y == 1, -np.exp(clean) / -np.expm1(clean), 1.0) * weight
    return float(loss), np.repeat(blame, counts) / (1 + np.exp(-s)) / total


def train(words: np.ndarray, vocab: list[bytes], sizes: np.ndarray, counts: np.ndarray, y: np.ndarray, part: np.ndarray, stands_for: list[float], rounds: int = 150, least_docs: int = 8, l1: float = 2e-4, rate: float = 0.15) -> ToxicityModel:
    """Adam on the noisy-or likelihood of parts 1 to 3; Platt calibration on part 0."""
    doc = np.repeat(np.arange(len(counts)), counts)
    fit = part > 0
    known, rows, cols = _vocabulary(vocab, np.unique(np.repeat(doc, sizes) * len(vocab) + words), fit, least_docs)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    w, bias = np.zeros(len(known)), -4.0
    m, v, mb, vb = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    balance = np.where(y == 1, 1.0, max(y[fit].sum(), 1) / max((1 - y[fit]).sum(), 1)) * fit

    def scores(w: np.ndarray) -> np.ndarray:
        return _sums(np.bincount(rows, weights=w[cols], minlength=len(vocab))[words], sizes)

    for step in range(1, rounds + 1):
        s = bias + scores(w)
        g = loss_and_slope(s, counts, y, balance)[1]
        gw = np.bincount(cols, weights=np.bincount(words, weights=g[sentence], minlength=len(vocab))[rows], minlength=len(known))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        size = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        reach = size / (np.sqrt(v) + 1e-6)
        w = w - reach * m
        w = np.sign(w) * np.maximum(np.abs(w) - reach * l1, 0)
        bias -= size * mb / (np.sqrt(vb) + 1e-6)
    s = bias + scores(w)
    x = _logit(-_sums(_softplus(s), counts))
    held = part == 0 if (part == 0).any() else fit
    weight = np.where(y == 1, stands_for[1], stands_for[0]) * held
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton on a logistic curve with a little ridge
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * (slope - 1), (weight * (p - y)).sum() + 1e-2 * offset])
        r = weight * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 1e-2, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-2]])
        step2 = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(step2[0], -1, 1), offset - np.clip(step2[1], -1, 1)
    weights = {known[i]: float(w[i]) for i in np.flatnonzero(w)}
    return ToxicityModel(weights, float(bias), float(max(slope, 1e-3)), float(offset))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, per_class: tuple[int, int] = PER_CLASS, label: str = "toxic", most_bytes: int = MOST_BYTES) -> ToxicityModel:
    """A model trained on at most per_class labelled rows of each class for which `learn` holds.

    Their whole texts come to at most most_bytes, which bounds the words that the driver trains on.
    """
    chosen, stands_for = sample(labels, label, learn, per_class)
    texts, stands_for = within_bytes(checkpointed(with_texts(docs, chosen)), stands_for, most_bytes)

    def work(texts: list[str]) -> dict[str, list]:
        found = [sentences(t) for t in texts]
        return {"words": [[w for x in own for w in x[2]] for own in found], "sizes": [[len(x[2]) for x in own] for own in found]}

    rows = map_texts(texts, ["y", "part"], fields("words array<binary>, sizes array<int>"), work).toArrow()
    if not rows.num_rows:
        return ToxicityModel({}, -4.0, 1.0, 0.0)
    flat = lambda c: pa.chunked_array([x.flatten() for x in rows.column(c).chunks])
    counts = np.concatenate([np.diff(x.offsets.to_numpy()) for x in rows.column("sizes").chunks]).astype(np.int64)
    coded = flat("words").combine_chunks().dictionary_encode()
    words, vocab = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    y, part = (rows.column(c).to_numpy() for c in ("y", "part"))
    return train(words, vocab, flat("sizes").to_numpy().astype(np.int64), counts, y.astype(float), part, stands_for)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, blame: float = 0.5, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, score, predicted and offending for every row's whole text.

    offending: the sentences whose own score is at least `blame`, as start and end in code points
    and that score. A sentence of any length is one instance, and a text's sentences are all
    scored, however many. Null, empty and wordless texts get the score of a text without
    sentences; repeated rows score alike; an empty table gives no rows; other columns, clashing
    names among them, are not read.
    """
    memory: dict[int, _Weights] = {}  # filled on the worker

    def work(texts: list[str]) -> dict[str, list]:
        weights = memory.setdefault(0, _Weights(model.weights))
        parts = [sentences(t) for t in texts]
        flat = [w for own in parts for x in own for w in x[2]]
        sizes = np.array([len(x[2]) for own in parts for x in own], np.int64)
        s = model.bias + _sums(np.array(list(map(weights.__getitem__, flat)), float), sizes)
        score = model.calibrated(-_sums(_softplus(s), np.array([len(own) for own in parts], np.int64)))
        p, at, found = 1 / (1 + np.exp(-s)), 0, []
        for t, own in zip(texts, parts, strict=True):
            bad = [i for i in np.flatnonzero(p[at : at + len(own)] >= blame)]
            raw = t.encode("utf-8", "surrogatepass") if bad else b""
            place = lambda b, raw=raw: len(raw[:b].decode("utf-8", "surrogatepass"))
            found.append([{"start": place(own[i][0]), "end": place(own[i][1]), "score": float(p[at + i])} for i in bad])
            at += len(own)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32), "offending": found}

    return map_texts(docs, list(keep), fields("score double, predicted int, offending array<struct<start:int,end:int,score:double>>"), work, text)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, offending; learned from labels whose fold is not `held`."""
    model = fit_toxicity(docs, labels, fold("doc_id", folds) != held)
    return toxicity_scores(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted", "offending")
