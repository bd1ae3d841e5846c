"""Toxicity by a factorization machine over hashed terms.

logit = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, with x_i = 1 if the text holds hashed term i.  Terms
are lower-cased words and their prefixes of 4, 5 and 6 letters (so that inflected insults share a term).
Of the 2**20 hashed terms, the machine keeps the WIDTH ones that a chi-square test ties most to the label in
the training texts; pairs of those carry what single weights miss, such as an insult beside a group's name.

Fitted on a bounded sample of whole labelled rows (PER_CLASS texts and SAMPLE_CHARS characters a class:
documented bounds of the fit only) with AdaGrad on numpy; scoring reads all texts.  The machine's own 0.5 is no
good place to cut, as a text of few known terms scores low.  So rows of the sample are scored by machines that
did not see them (FOLDS parts), the lowest logit with about the largest F1 there, each class weighed by its share of all labels, is
found, and all logits are moved so that it scores AT: a monotone map.

Edge cases: null counts as empty; texts without kept terms get the machine's base rate; with under FOLDS labels of
a class nothing is moved, and with none the base rate is the smoothed share of the other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_texts

PER_CLASS, SAMPLE_CHARS, BITS, WIDTH, FACTORS, EPOCHS = 4000, 24_000_000, 20, 2048, 4, 20
BATCH, RATE, L2 = 16, 0.3, 1e-4
#: Parts of the fit's sample that are scored by machines of the other parts, and the score that the best cut gets.
FOLDS, AT = 5, 0.7
#: F1 that the cut may give away for recall.
SLACK = 0.005
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
PREFIXES = (4, 5, 6)


def hashed_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-cased word: itself and its prefixes, each with its own salt."""
    mask = (1 << BITS) - 1
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask, *(zlib.crc32(f"{k}^{word[:k]}".encode("utf-8", "surrogatepass")) & mask for k in PREFIXES if len(word) >= k))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class FactorizationMachine:
    slots: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)

    def active(self, text: str | None) -> list[int]:
        got: set[int] = set()
        memo = self.memo
        if len(memo) > 400_000:  # words seen by this worker; starts anew rather than grow without bound
            memo.clear()
        for word in words_of(text):
            hit = memo.get(word)
            if hit is None:
                hit = memo[word] = tuple(s for t in hashed_terms(word) if (s := self.slots.get(t)) is not None)
            got.update(hit)
        return sorted(got)

    def logit(self, idx: list[int]) -> float:
        if not idx:
            return self.bias
        v = self.v[idx]
        s = v.sum(0)
        return float(self.bias + self.w[idx].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def scores(self, texts: list) -> list[float]:
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, self.logit(self.active(t)))))) for t in texts]


def _all_terms(texts: list) -> list[np.ndarray]:
    memo: dict[str, tuple[int, ...]] = {}
    found = []
    for text in texts:
        got: set[int] = set()
        for w in words_of(text):
            t = memo.get(w)
            if t is None:
                t = hashed_terms(w)
                if len(memo) < 200_000:
                    memo[w] = t
            got.update(t)
        found.append(np.fromiter(sorted(got), np.int32, len(got)))  # four bytes a term
    return found


def _learn(terms: list[np.ndarray], y: np.ndarray, width: int, seed: int) -> FactorizationMachine:
    """Chooses terms and fits their weights in batches of BATCH rows."""
    up, n = float(y.sum()), len(y)
    base = math.log((up + 1) / (n - up + 1))
    if up == 0 or up == n:
        return FactorizationMachine({}, base, np.zeros(0), np.zeros((0, FACTORS)))
    seen, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for ts, label in zip(terms, y):
        seen[ts] += 1
        if label:
            bad[ts] += 1
    e = seen * up / n
    signs = np.flatnonzero((seen >= 3) & (bad > e))  # signs of toxicity; those of its absence are the base rate's part
    scored = [((bad[t] - e[t]) ** 2 / e[t] * n / (n - up), int(t)) for t in signs.tolist()]
    scored = sorted(scored, key=lambda s: (-s[0], s[1]))[:width]
    slots = {t: i for i, (s, t) in enumerate(scored) if s > 6.63}
    m = len(slots)
    holds = np.zeros((n, m), np.uint8)
    for k, ts in enumerate(terms):
        holds[k, [slots[t] for t in ts.tolist() if t in slots]] = 1
    rng = np.random.default_rng(seed)
    bias, w, v = base, np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, FACTORS), 1e-6), 1e-6
    order = np.arange(n)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            used = np.flatnonzero(holds[rows].any(0))
            x, wu, vu = holds[np.ix_(rows, used)].astype(float), w[used], v[used]
            s = x @ vu
            z = bias + x @ wu + 0.5 * ((s * s).sum(1) - x @ (vu * vu).sum(1))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
            gb += g.sum() ** 2
            bias -= RATE * g.sum() / math.sqrt(gb)
            if not len(used):
                continue
            pull = x.T @ g
            d = pull + L2 * wu
            gw[used] += d * d
            w[used] = wu - RATE * d / np.sqrt(gw[used])
            d = x.T @ (g[:, None] * s) - pull[:, None] * vu + L2 * vu
            gv[used] += d * d
            v[used] = vu - 0.25 * RATE * d / np.sqrt(gv[used])
    return FactorizationMachine(slots, bias, w, v)


def _cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which on a row is called toxic: the lowest whose F1 is within SLACK of the largest.

    The curve is flat at its top, and where in it the largest lies is chance; a missed row costs more.
    """
    order = np.lexsort((y, -logits))
    z, hit, called = logits[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    last = np.append(z[1:] != z[:-1], True)  # equal logits are called together
    f1 = np.where(last, 2 * hit / (called + (weight * y).sum()), -1)
    at = int(np.flatnonzero(f1 >= f1.max() - SLACK)[-1])
    return float((z[at] + z[min(at + 1, len(z) - 1)]) / 2)


def fit_machine(sample: list[tuple], width: int = WIDTH, seed: int = 7, shares: tuple[float, float] = (1, 1)) -> FactorizationMachine:
    """sample: (label, text, ...) rows; shares: how many labelled rows stand behind one sampled row of class 0 and 1."""
    y = np.array([r[0] for r in sample], float)
    terms = _all_terms([r[1] for r in sample])
    machine = _learn(terms, y, width, seed)
    if min(y.sum(), len(y) - y.sum()) < FOLDS:
        return machine
    outside = np.zeros(len(y))
    part = np.zeros(len(y), int)
    for label in (0, 1):  # each part has its share of both classes
        part[y == label] = np.arange((y == label).sum()) % FOLDS
    for k in range(FOLDS):
        rest = np.flatnonzero(part != k)
        other = _learn([terms[i] for i in rest], y[rest], width, seed)
        for i in np.flatnonzero(part == k):
            outside[i] = other.logit([other.slots[t] for t in terms[i].tolist() if t in other.slots])
    weight = np.where(y == 1, shares[1], shares[0])
    machine.bias += math.log(AT / (1 - AT)) - _cut(outside, y, weight)
    return machine


def train_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, per_class: int = PER_CLASS, label: str = "toxic") -> FactorizationMachine:
    sample = labelled_sample(docs, labels, label, parts, held_out, per_class, SAMPLE_CHARS)
    known = labels.where(fold("doc_id", parts) != held_out).groupBy(F.col(label).cast("int").alias("y")).count()
    counts = {r["y"]: r["count"] for r in known.where("y in (0, 1)").collect()}
    taken = Counter(r[0] for r in sample)
    return fit_machine(sample, shares=tuple(counts.get(k, 0) / max(taken[k], 1) for k in (0, 1)))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return map_texts(docs, text_col, keep, lambda texts: {"score": machine.scores(texts)}, "score double")
