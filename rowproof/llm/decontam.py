"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment by words.

1. Corpus frequency: one pass counts, for every word n-gram of the benchmark, the documents that hold it.
2. Seeds: every item keeps the rarest SEED_SHARE of its n-grams (rarity is relative to the item, so a passage
   that a third of all documents share keeps its seeds), a short item all of them.
3. A second pass finds seeds in every whole text, clusters those of one item, and aligns the item with the
   text around each cluster: match +2, mismatch and gap -1, scored against the item's best possible score.
Both passes are maps over documents.  What goes to the executors is the benchmark's own n-grams; a benchmark
of over BLOCK_WORDS words is taken in blocks of about that size, one after the other, so the size is bounded.

Edge cases: words are runs of ASCII letters and digits (any case) and non-ASCII characters; null and empty
texts and items hold no words and match nothing; an item shorter than an n-gram is one seed as a whole;
items with equal texts are all reported; repeated rows and ids are each judged; an empty table of either kind gives no leaks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

NGRAM, SEED_SHARE, LEAST_SEEDS, THRESHOLD, BLOCK_WORDS = 3, 0.75, 2, 0.5, 200_000
#: Items of fewer words keep all n-grams as seeds, and one of them is enough for an alignment.
SHORT_WORDS = 28
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Items:
    """Benchmark items as word numbers, and their n-grams."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = NGRAM):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.grams: dict[int, list[int]] = defaultdict(list)  # n-gram -> items, in order of item
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                self.items.append((item_id, ids))
        self.base = len(self.vocabulary) + 2
        assert self.base**n < 2**63, "block of items too large"
        for k, (_, ids) in enumerate(self.items):
            for g in dict.fromkeys(self._keys(ids).tolist() if len(ids) >= n else []):
                self.grams[g].append(k)
        self.short = [k for k, (_, ids) in enumerate(self.items) if len(ids) < n]
        self.sorted = np.array(sorted(self.grams), np.int64)
        self.n_seeds: dict[int, int] = {}  # distinct seeds of each item, once rare_seeds has chosen them

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        key = np.zeros(max(0, len(ids) - self.n + 1), np.int64)
        for k in range(self.n):
            key = key * self.base + ids[k : len(ids) - self.n + 1 + k]
        return key

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        ws = words_of(text)
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))

    def hits(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and n-grams of those in the sorted array among."""
        n = self.n
        if len(ids) < n or not len(among):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        ok = known[: len(ids) - n + 1].copy()
        for k in range(1, n):
            ok &= known[k : len(ids) - n + 1 + k]
        at = np.flatnonzero(ok)
        if not len(at):
            return at, at
        key = np.zeros(len(at), np.int64)
        for k in range(n):
            key = key * self.base + ids[at + k]
        where = np.searchsorted(among, key)
        hit = (where < len(among)) & (among[np.minimum(where, len(among) - 1)] == key)
        return at[hit], key[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score and the place in text where it ends (exclusive)."""
    steps = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, 2, -1))
        row = np.maximum.accumulate(new + steps) - steps
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def find_leaks(ids: np.ndarray, items: Items, seeds: np.ndarray, owners: dict[int, list[int]], threshold: float, least: int) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, last word) of the best alignment with each leaked item."""
    at, keys = items.hits(ids, seeds)
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, g in zip(at.tolist(), keys.tolist()):
        for k in owners[g]:
            by_item[k].append((p, g))
    for k in items.short:  # an item shorter than an n-gram must occur as a whole
        item = items.items[k][1]
        whole = np.ones(max(0, len(ids) - len(item) + 1), bool)
        for j, w in enumerate(item):
            whole &= ids[j : len(ids) - len(item) + 1 + j] == w
        by_item[k] += [(p, -1) for p in np.flatnonzero(whole).tolist()]
    out = []
    for k, places in by_item.items():
        item_id, item = items.items[k]
        size, best = len(item), (0, 0, 0)
        need = 1 if size < SHORT_WORDS else min(least, max(1, items.n_seeds.get(k, 1)))
        start = 0
        for i in range(1, len(places) + 1):
            if i < len(places) and places[i][0] - places[i - 1][0] <= size:
                continue
            cluster, start = places[start:i], i
            if len({g for _, g in cluster}) < need:
                continue
            lo, hi = max(0, cluster[0][0] - size), min(len(ids), cluster[-1][0] + items.n + size)
            score, end = align(item, ids[lo:hi])
            if score > best[0]:
                back, length = align(item[::-1], ids[lo : lo + end][::-1])
                best = (score, lo + end - length, lo + end - 1) if back == score else (score, lo, lo + end - 1)
        similarity = best[0] / (2 * size)
        if similarity >= threshold:
            out.append((item_id, round(similarity, 6), best[1], best[2]))
    return sorted(out)


def _frequencies(docs: DataFrame, text_col: str, items: Items) -> dict[int, int]:
    """Documents that hold each benchmark n-gram: at most one row per n-gram of the block comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(items.sorted), np.int64)
        for b in batches:
            for t in b.column(0):
                _, keys = items.hits(items.numbers(t.as_py()), items.sorted)
                totals[np.searchsorted(items.sorted, np.unique(keys))] += 1
        some = totals > 0
        yield pa.RecordBatch.from_arrays([pa.array(items.sorted[some]), pa.array(totals[some])], names=["gram", "n"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "gram long, n long")
    return {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()}


def rare_seeds(items: Items, frequency: dict[int, int], share: float = SEED_SHARE) -> dict[int, list[int]]:
    """n-gram -> items that have it among their rarest."""
    own: dict[int, list[int]] = defaultdict(list)
    for g, ks in items.grams.items():
        for k in ks:
            own[k].append(g)
    owners: dict[int, list[int]] = defaultdict(list)
    for k in sorted(own):
        ranked = sorted(own[k], key=lambda g: (frequency.get(g, 0), g))
        chosen = ranked if len(items.items[k][1]) < SHORT_WORDS else ranked[: max(1, round(share * len(ranked)))]
        items.n_seeds[k] = len(chosen)
        for g in chosen:
            owners[g].append(k)
    return dict(owners)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, share: float = SEED_SHARE, least: int = LEAST_SEEDS, to: str = "leaks") -> DataFrame:
    """keep columns and leaks (named by to): array of (item_id, score, first_word, last_word), for every row of docs.

    benchmark: item_id (of any type that has an order), text.  Other columns of either table, whatever their
    names, are never looked at.
    """
    leak = f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},score:double,first_word:long,last_word:long>>"
    sizes = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-int(sizes["chars"] or 0) // (6 * BLOCK_WORDS)))
    if not sizes["n"]:
        return docs.select(*keep, F.array().cast(leak).alias(to))
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_t"), F.array().cast(leak).alias("_leaks"))
    for block in range(blocks):
        mine = benchmark.where(F.crc32(F.coalesce(F.col("item_id").cast("string"), F.lit("")).cast("binary")) % blocks == block)
        items = Items(sorted(((r["item_id"], r["text"]) for r in mine.select("item_id", "text").toLocalIterator()), key=lambda r: (r[0] is None, r[0], r[1] or "")))
        owners = rare_seeds(items, _frequencies(docs, text_col, items), share)
        seeds = np.array(sorted(owners), np.int64)

        def run(texts: list, items: Items = items, seeds: np.ndarray = seeds, owners: dict = owners) -> dict[str, list]:
            return {"found": [find_leaks(items.numbers(t), items, seeds, owners, threshold, least) for t in texts]}

        rows = map_texts(rows, "_t", tuple(c for c in rows.columns if c != "_t") if block == blocks - 1 else tuple(rows.columns), run, f"found {leak}")
        rows = rows.withColumn("_leaks", F.concat("_leaks", "found")).drop("found")
    return rows.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_leaks").alias(to))
