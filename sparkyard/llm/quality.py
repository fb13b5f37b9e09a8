"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of a text (character classes, words, lines) are standardised and mapped to cosines and
sines at random frequencies, which approximates a Gaussian kernel. Partitions sum their normal
equations; the driver adds the sums up, solves for ridge weights and fits an isotonic curve from
raw scores to probabilities on rows that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fields, map_texts
from .labelled import fold, sample, with_texts

#: Most labelled rows of each class that a fit reads, features, ridge penalty per row.
PER_CLASS, FEATURES, RIDGE = (6000, 14000), 160, 1e-3
#: Most rows of the sample, chosen by digest, whose median distance is the kernel's width.
WIDTH_ROWS = 400
_CLASSES = (
    bytes(range(97, 123)),
    bytes(range(65, 91)),
    b"0123456789",
    b" ",
    b"\n\r",
    b"\t\v\f" + bytes([*range(9), *range(14, 32), 127]),
    b".,;:?'\"()-",
    b"!",
    b"|",
    b"$%&*#@^~=+<>{}[]\\/_`",
    bytes(range(0xC0, 0x100)),
)
_IN_CLASS = np.array([[b in c for c in _CLASSES] for b in range(256)], float)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of numbers for each text: shares of character classes, shape of words and lines."""
    hist, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), 8))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        hist[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n, k = len(words), len(lines)
        distinct = len(set(words))
        rest[i] = (
            np.log1p(len(raw)),
            np.log1p(n),
            min(30.0, len(raw) / (n + 1)),
            distinct / (n + 1),
            np.log1p(n) - np.log1p(distinct),
            (k - len(set(lines))) / (k + 1),
            np.log1p(len(raw) / (k + 1)),
            sum(map(len, set(lines))) / (len(raw) + 1),
        )
    size = hist.sum(1, keepdims=True)
    shares = hist @ _IN_CLASS / (size + 1)
    p = hist / np.maximum(size, 1)
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1, keepdims=True)
    letters = shares[:, :2].sum(1, keepdims=True)
    return np.hstack([np.sqrt(shares), shares[:, 1:2] / (letters + 0.01), entropy, rest])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6) @ self.frequencies
        return np.hstack([np.cos(z), np.sin(z), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        raw = self.raw(statistics(texts))
        # a slight slope keeps the order inside the curve's flat parts
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing curve that fits y by weighted least squares."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, sum of weighted x
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([c, b, c * a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            c2, b2, s2 = blocks.pop()
            c1, b1, s1 = blocks[-1]
            blocks[-1] = [c1 + c2, (c1 * b1 + c2 * b2) / (c1 + c2), s1 + s2]
    return np.array([s / c for c, _, s in blocks]), np.array([b for _, b, _ in blocks])


def _moments(stats: DataFrame, width: int, width_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols = [F.col("x")[i] for i in range(width)]
    row = stats.agg(*(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    few = stats.orderBy("d").limit(width_rows).select("x").collect()
    return np.array(row[:width], float), np.array(row[width:], float), np.array([r.x for r in few], float)


def fit_quality(docs: DataFrame, labels: DataFrame, learn, per_class: tuple[int, int] = PER_CLASS, features: int = FEATURES, seed: int = 7, label: str = "quality", width_rows: int = WIDTH_ROWS) -> QualityModel:
    """A model fitted on at most per_class labelled rows of each class for which `learn` holds.

    The kernel's width is the median distance of at most width_rows of them.
    """
    chosen, stands_for = sample(labels, label, learn, per_class)
    made = map_texts(with_texts(docs, chosen), ["y", "part"], fields("x array<double>"), lambda texts: {"x": list(statistics(texts))})
    stats = checkpointed(made.select("y", "part", "x", F.xxhash64("x").alias("d")))
    n = stats.count()
    width = statistics([""]).shape[1]
    if not n:
        return QualityModel(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(3), np.zeros(1), np.full(1, 0.5))
    mean, scale, few = _moments(stats, width, width_rows)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((few - mean) / scale, -6, 6)
    apart = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    reach = float(np.median(apart[apart > 0])) if (apart > 0).any() else 1.0
    rng = np.random.default_rng(seed)
    blank = QualityModel(mean, scale, rng.normal(size=(width, features)) / (0.7 * reach), np.zeros(2 * features + 1), np.zeros(1), np.zeros(1))
    size = 2 * features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, seen = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(0).to_numpy()
            f = blank.features(np.array(b.column(1).to_pylist(), float))
            w = np.where(y == 1, stands_for[1], stands_for[0])
            gram += f.T @ (f * w[:, None])
            right += f.T @ (w * y)
            seen += b.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], names=["gram", "right"])

    # eight sums at most reach the driver, whatever the number of rows
    sums = stats.where("part > 0").select("y", "x").coalesce(8).mapInArrow(equations, "gram binary, right binary").collect()
    gram = sum((np.frombuffer(r.gram).reshape(size, size) for r in sums), np.zeros((size, size)))
    right = sum((np.frombuffer(r.right) for r in sums), np.zeros(size))
    weights = np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1) * np.eye(size), right)
    fitted = QualityModel(mean, scale, blank.frequencies, weights, np.zeros(1), np.zeros(1))
    held = stats.where("part = 0").select("y", "x").collect()  # at most the sample
    if not held:
        return QualityModel(mean, scale, blank.frequencies, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    y = np.array([r.y for r in held], float)
    raw = fitted.raw(np.array([r.x for r in held], float))
    w = np.where(y == 1, stands_for[1], stands_for[0])
    knots, values = isotonic(raw, y, w)
    return QualityModel(mean, scale, blank.frequencies, weights, knots, values)


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, score (0 to 1) and predicted (1 if score >= threshold) for every row's whole text.

    Null and empty texts are scored as the empty text; whole texts count, however long; repeated
    rows score alike; an empty table gives no rows; other columns, clashing names among them, are
    not read.
    """

    def work(texts: list[str]) -> dict[str, list]:
        score = model.score(texts)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_texts(docs, list(keep), fields("score double, predicted int"), work, text)


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), folds: int = 5, held: int = 0) -> DataFrame:
    """keep, held_out, score and predicted; learned from labels whose fold is not `held`."""
    model = fit_quality(docs, labels, fold("doc_id", folds) != held)
    scored = quality_scores(docs, model, keep=tuple(dict.fromkeys((*keep, "doc_id"))))
    return scored.select(*keep, (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")
