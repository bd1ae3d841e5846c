"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into pieces of PIECE bytes (all of them, to its end) and every piece is compressed with both
dictionaries.  From the sums come the normalised difference d = (size under bad - size under good) / (size
under bad + size under good) and the compression rate; the smallest rate of a piece shows text that is good
word by word but repeats itself.  A logistic curve over these, fitted on labelled texts that are in neither
dictionary, makes the score a calibrated probability.  Pieces keep the measures comparable between short and
very long texts: a dictionary helps most at a text's start.

The fit uses a bounded sample of whole labelled rows (PER_CLASS texts and SAMPLE_CHARS characters a class:
documented bounds of the fit only; scoring reads all texts).  Edge cases: null counts as empty; empty texts get the average measures;
without labels of both classes every score is the smoothed share of the class there is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_texts

PER_CLASS, SAMPLE_CHARS, PIECE, DICT_BYTES, LEVEL = 1500, 12_000_000, 2048, 112_640, 3


MEASURES = 5


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the standardised measures, then the bias
    mean: tuple[float, ...] = (0.0,) * MEASURES
    scale: tuple[float, ...] = (1.0,) * MEASURES

    def measures(self, texts: list) -> np.ndarray:
        """One row a text; not-a-number for empty texts."""
        tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        return np.array([_measure(t, *tools) for t in texts]).reshape(-1, MEASURES)

    def scores(self, texts: list) -> list[float]:
        bias = self.weights[-1]
        if not self.good:
            return [1 / (1 + math.exp(-bias))] * len(texts)
        x = np.nan_to_num((self.measures(texts) - self.mean) / self.scale)
        return (1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + bias, -500, 500)))).tolist()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def _measure(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    """Normalised difference, logarithm of the rate and its square, the smallest rate of a piece and its square."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [math.nan] * MEASURES
    g = b = 0
    least = 1.0
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        one = len(good.compress(piece))
        g += one
        b += len(bad.compress(piece))
        if at == 0 or len(piece) >= PIECE // 4:  # a short rest says little about a rate
            least = min(least, one / len(piece))
    rate, least = math.log(g / len(data)), math.log(least)
    return [(b - g) / (b + g), rate, rate * rate, least, least * least]


def _trained(texts: list[str]) -> bytes:
    pieces = [p for t in texts for p in (t.encode("utf-8", "surrogatepass"),) if p]
    samples = [p[k : k + PIECE] for p in pieces for k in range(0, len(p), PIECE)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 4)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their plain content serves as dictionary
        return b"".join(samples)[:DICT_BYTES] or b"\n" * 64


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, then bias, by Newton's method, with Platt's smoothed targets and a weak ridge on the weights."""
    up, n = y.sum(), len(y)
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    x = np.concatenate([x, np.ones((n, 1))], 1)
    ridge = np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    w[-1] = math.log((up + 1) / (n - up + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - t) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_quality(sample: list[tuple], shares: tuple[int, int] | None = None) -> CompressionModel:
    """sample: (label, text, ...) rows.  Every other text of a class feeds its dictionary, the rest the curve.

    shares: counts of label 0 and 1 among all labelled rows, to undo the sample's balance.
    """
    by = {y: [r[1] for r in sample if r[0] == y] for y in (0, 1)}
    n0, n1 = shares or (len(by[0]), len(by[1]))
    prior = math.log((n1 + 1) / (n0 + 1))
    if len(by[0]) < 2 or len(by[1]) < 2:
        return CompressionModel(b"", b"", (prior,))
    raw = CompressionModel(_trained(by[1][::2]), _trained(by[0][::2]), ())
    rest = [(y, t) for y in (0, 1) for t in by[y][1::2]]
    x = raw.measures([t for _, t in rest])
    mean = np.nan_to_num(np.nanmean(x, 0)) if len(x) and not np.isnan(x).all() else np.zeros(MEASURES)
    scale = np.nan_to_num(np.nanstd(x, 0)) if len(x) and not np.isnan(x).all() else np.ones(MEASURES)
    scale[scale == 0] = 1.0
    y = np.array([y for y, _ in rest], float)
    w = _logistic(np.nan_to_num((x - mean) / scale), y)
    w[-1] += prior - math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return CompressionModel(raw.good, raw.bad, tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))


def train_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, per_class: int = PER_CLASS, label: str = "quality") -> CompressionModel:
    sample = labelled_sample(docs, labels, label, parts, held_out, per_class, SAMPLE_CHARS)
    counts = {r["y"]: r["n"] for r in labels.where(fold("doc_id", parts) != held_out).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).where("y in (0, 1)").collect()}
    return fit_quality(sample, (counts.get(0, 0), counts.get(1, 0)))


def score_quality(docs: DataFrame, model: CompressionModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", to: str = "score") -> DataFrame:
    """keep columns and the score, in a column named by to."""
    return map_texts(docs, text_col, keep, lambda texts: {to: model.scores(texts)}, f"{to} double")
