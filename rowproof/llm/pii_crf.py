"""Personal data by base patterns and a skip-chain conditional random field.

Base spans (e-mail, IP, card, phone) come from the contract's patterns, in linear time.  The field's nodes
are the tokens that hold a digit or '@'; their labels are the four kinds or none.  Potentials: token shape
and cue word (unary), next node at most NEAR characters away (chain), and earlier nodes that are the same or
similar, however distant (skip): equal digits or equal lower-cased token, equal last seven digits (a number
with and without its country code), one digit changed in a number of seven or more, equal local part of an
address.  Tokens in base spans are observed; loopy sum-product message passing spreads their labels to tokens
that the patterns miss, such as a telephone number written without its plus sign later on.  Similar tokens are
linked in order of occurrence, the next with the last of each key, not all with all: at most five skip edges
a node.

Weights are fitted here, from the base spans as labels, on a bounded sample of whole documents (SAMPLE of them
and SAMPLE_CHARS characters, documented bounds of the fit only): unary, chain and skip weights together, by
the field's pseudo-likelihood, without the features that define the patterns.

Edge cases: null and empty texts have no spans; overlapping base spans of different kinds all stay; the
field adds no span that overlaps a base span; offsets are code points; repeated rows come out as often as they
came in; columns other than the kept ones and the text, whatever their names, are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS, NEAR, ROUNDS, SURE = 1500, 12_000_000, 24, 12, 0.9
#: What the skip weights of agreeing labels are drawn to where the sample has little to tell.
AGREE = 6.0
# The base patterns of the contract, anchored where a match can start.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
ANY = re.compile(r"[0-9@]")
CUES = ("tel", "phone", "call", "fax", "mobil", "mail", "contact", "card", "visa", "ip", "host", "server", "addr")


def _emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        head = text[low:at]
        run = len(head) - len(head.rstrip(LOCAL))
        low = at + 1
        if run and (m := DOMAIN.match(text, at + 1)):
            out.append((at - run, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in order of kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not ANY.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _keys(token: str) -> list[str]:
    """Keys that the same and similar tokens share; those that begin with 'half' call for a test."""
    digits = "".join(c for c in token if c in "0123456789")
    n = len(digits)
    if n < 7:
        return [token.lower()] + (["local" + token.lower().partition("@")[0]] if "@" in token[1:] else [])
    return [digits, "tail" + digits[-7:], f"half{n}a" + digits[: n // 2], f"half{n}b" + digits[n // 2 :]]


def _one_changed(a: str, b: str) -> bool:
    """Whether two tokens' digits differ in at most one place."""
    x, y = ([c for c in t if c in "0123456789"] for t in (a, b))
    return len(x) == len(y) and sum(p != q for p, q in zip(x, y)) <= 1


def _features(token: str, cue: str) -> list[float]:
    """Shape without the very signs that the patterns look for (plus sign, checksum, ranges)."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    shape = [1.0, "@" in token, digits >= 4, digits >= 7, digits >= 9, digits >= 13, digits > 15, letters > 0, letters > digits, token.count(".") == 3, token.count(".") == 1, "-" in token, "(" in token]
    return [float(x) for x in shape] + [float(c in cue) for c in CUES]


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # features x labels (none, then KINDS)
    chain: np.ndarray  # labels x labels, logarithms
    skip: np.ndarray


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, int]]:
    """(start, end, token, cue, observed label or -1): every base span as a whole, and every other token with a digit or '@'."""
    out = []
    spans: list[tuple[int, int, int]] = []  # without those that overlap an earlier one
    for a, b, k in sorted((a, b, k) for k, a, b in base):
        if not spans or a >= spans[-1][1]:
            spans.append((a, b, k))
    cue = lambda at: text[max(0, at - 24) : at].lower()
    i = 0
    covered = 0  # the end of what base spans cover so far
    ends = sorted((a, b) for _, a, b in base)
    e = 0
    for m in TOKEN.finditer(text):
        token = m[0]
        end = m.end() - (len(token) - len(token.rstrip(".,;:!?)]}>\"'")))
        start = m.start() + len(token) - len(token.lstrip("([{<\"'"))
        while i < len(spans) and spans[i][0] < max(end, m.end()):
            a, b, k = spans[i]
            out.append((a, b, text[a:b], cue(a), k + 1))
            i += 1
        while e < len(ends) and ends[e][0] < end:
            covered = max(covered, ends[e][1])
            e += 1
        if start < end and covered <= start:
            out.append((start, end, text[start:end], cue(m.start()), -1))
    return out


def edges_of(nodes: list[tuple]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i][0] - nodes[i - 1][1] <= NEAR]
    last: dict[str, int] = {}
    skip = []
    for i, n in enumerate(nodes):
        for key in _keys(n[2]):
            j = last.get(key)
            if j is not None and (not key.startswith("half") or _one_changed(nodes[j][2], n[2])):
                skip.append((j, i))
            last[key] = i
    return chain, sorted(set(skip))


def marginals(nodes: list[tuple], field: Field) -> np.ndarray:
    """Beliefs by loopy belief propagation; observed nodes are held at their label."""
    n, labels = len(nodes), len(KINDS) + 1
    logits = np.array([_features(t, c) for _, _, t, c, _ in nodes]) @ field.unary
    seen = np.array([s for *_, s in nodes])
    held = seen >= 0
    logits[held] = -30.0
    logits[held, seen[held]] = 0.0
    chain, skip = edges_of(nodes)
    if chain or skip:
        pairs = np.array(chain + skip)
        pot = np.exp(np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)]))
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        m = len(pairs)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, labels))  # logarithms
        for _ in range(ROUNDS):
            total = logits.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            out -= out.max(1, keepdims=True)
            new = np.log(np.einsum("el,elk->ek", np.exp(out), pot) + 1e-300)
            new -= new.max(1, keepdims=True)
            new = 0.5 * msg + 0.5 * new
            change = np.abs(new - msg).max()
            msg = new
            if change < 1e-4:
                break
        np.add.at(logits, dst, msg)
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(1, keepdims=True)


def all_spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the field adds."""
    text = text or ""
    base = base_spans(text)
    if not ANY.search(text):
        return base, []
    nodes = nodes_of(text, base)
    if all(s >= 0 for *_, s in nodes):
        return base, []
    p = marginals(nodes, field)
    added = []
    for (a, b, _, _, seen), row in zip(nodes, p):
        k = int(row.argmax())
        if seen < 0 and k and row[k] >= SURE:
            added.append((k - 1, a, b))
    return base, added


def fit_field(texts: list[str], steps: int = 300) -> Field:
    """All weights by gradient ascent on the pseudo-likelihood: each node's label given its neighbours' labels."""
    labels = len(KINDS) + 1
    width = len(_features("", ""))
    x, y = [], []
    chains: list[tuple[int, int]] = []
    skips: list[tuple[int, int]] = []
    for text in texts:
        nodes = nodes_of(text, base_spans(text))
        ch, sk = edges_of(nodes)
        chains += [(a + len(x), b + len(x)) for a, b in ch]
        skips += [(a + len(x), b + len(x)) for a, b in sk]
        x += [_features(t, c) for _, _, t, c, _ in nodes]
        y += [max(0, s) for *_, s in nodes]
    unary, chain, skip = np.zeros((width, labels)), np.zeros((labels, labels)), AGREE * np.eye(labels)
    unary[0, 0] = 2.0  # without evidence: none; similar tokens lean to one label
    if not x:
        return Field(unary, chain, skip)
    xs, ys = np.array(x), np.eye(labels)[y]
    before, after, alike = np.zeros_like(ys), np.zeros_like(ys), np.zeros_like(ys)  # labels of a node's neighbours, counted
    for a, b in chains:
        before[b] += ys[a]
        after[a] += ys[b]
    for a, b in skips:
        alike[b] += ys[a]
        alike[a] += ys[b]
    n = len(xs)
    sums = [np.full_like(w, 1e-6) for w in (unary, chain, skip)]
    for _ in range(steps):  # AdaGrad, with a weak ridge that draws the skip weights to where they began
        z = xs @ unary + before @ chain + after @ chain.T + alike @ skip
        z = np.exp(z - z.max(1, keepdims=True))
        miss = z / z.sum(1, keepdims=True) - ys
        mutual = alike.T @ miss
        grads = (xs.T @ miss / n + 1e-3 * unary, (before.T @ miss + miss.T @ after) / n + 1e-3 * chain, (mutual + mutual.T) / (2 * n) + 1e-3 * (skip - AGREE * np.eye(labels)))
        for w, g, s in zip((unary, chain, skip), grads, sums):
            s += g * g
            w -= 0.3 * g / np.sqrt(s)
    return Field(unary, np.clip(chain, -2, 2), np.clip(skip, -8, 8))


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field:
    """Fits on the whole documents with the smallest md5 of their id among those with a digit or '@'.

    Rows are thinned by that hash to about 20 times the sample before they are put in order, narrow, so that
    what one task sorts does not grow with the corpus; texts follow for the chosen rows only.
    """
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    share = min(1.0, 20 * sample / max(1, docs.count()))
    rows = docs.select(order.alias("o"), text_or_empty(text_col).alias("t")).where(F.conv(F.substring("o", 1, 8), 16, 10).cast("long") < F.lit(int(share * (1 << 32))))
    rows = rows.where(F.col("t").rlike("[0-9@]"))
    picked, room = [], chars
    for r in rows.select("o", F.xxhash64("t").alias("h"), F.length("t").alias("n")).orderBy("o", "h").limit(sample).collect():  # sample narrow rows
        if r["n"] <= room:
            room -= r["n"]
            picked.append((r["o"], r["h"]))
    if not picked:
        return fit_field([])
    chosen = docs.sparkSession.createDataFrame(picked, "o string, h long").distinct()
    got = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["o", "h"]).dropDuplicates(["o", "h"])
    return fit_field([t for *_, t in sorted((r["o"], r["h"], r["t"]) for r in got.toLocalIterator())])  # bounded by chars


def find_personal_data(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns, base and added: arrays of (kind, start, stop), for every row."""

    def run(texts: list) -> dict[str, list]:
        got = [all_spans(t, field) for t in texts]
        named = lambda spans: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in spans]
        return {"base": [named(b) for b, _ in got], "added": [named(a) for _, a in got]}

    kind = "array<struct<kind:string,start:long,stop:long>>"
    return map_texts(docs, text_col, keep, run, f"base {kind}, added {kind}")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets (overlapping spans become one)."""
    text, out, at = text or "", [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)).encode()).hexdigest()
