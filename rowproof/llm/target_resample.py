"""Target-distribution importance resampling: documents that look like a target corpus are drawn without replacement.

Hashed features (runs of 1 to `longest` words) of the corpus and of the target are counted by bucket.  A
bucket's gain is the scaled logarithm of its target share over its corpus share; the gains of all buckets are
one array, and a document's weight is the sum of the array's entries at its features.  Gumbel noise from a
hash of seed and id is added, so that the largest scores are a draw in proportion to exp(weight / 1000).

The k-th key of (score descending, id, number of features, row) is found by radix selection: a histogram of
one digit of the key, at most 2^DIGIT counts, tells which digit holds the k-th row, and the next pass looks
only at rows with that digit.  So nothing is sorted but the rows drawn, which are range-sorted and numbered.

Counts cover all documents; the texts are read twice and never shuffled.  Narrow rows go to a table in the
shared folder, on which the passes run.

Edge cases: a null text has no words; a null id is hashed as empty text and is last among equal scores; rows
with one id are drawn one by one, those with fewer features first; an empty corpus, or a share that comes to
none, draws nothing; an empty target gives gains by corpus rarity alone.  Ids are integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.sources.numbering import with_row_number

from .common import map_texts, written

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bits of a key that one pass of the selection resolves: a pass brings at most 2^DIGIT counts to the driver.
DIGIT = 12

#: Bytes of a text as they count: A-Z lower-cased, other ASCII but letters and digits a space.
_FOLDED = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def text_features(text: str | None, longest: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of 1 to longest words joined by one space, as UTF-8."""
    words = (text or "").encode().translate(_FOLDED).split()
    longer = (b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1))
    return len(words), words if longest == 1 else [*words, *longer]


def _buckets(features: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """How many features of all texts fall into each bucket: a task sums its texts, `buckets` numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(_buckets(text_features(text.as_py(), longest)[1], buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["b", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "b long, n long")
    counts = [0] * buckets
    for r in parts.groupBy("b").agg(F.sum("n").alias("n")).collect():
        counts[r["b"]] = r["n"]
    return counts


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) of each bucket."""
    n, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus, target)]


def smallest(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """A condition that holds for exactly the k smallest rows by keys: longs, never null, unique together.

    rows should be a written table: each pass reads it.  A key column takes one pass for its range and one for
    each DIGIT bits in which the range varies; the search ends once a digit's rows are wanted as a whole.
    """
    if k <= 0:
        return F.lit(False)
    below, equal = F.lit(False), F.lit(True)  # rows known to be smaller; rows that agree with the k-th so far
    for key in keys:
        left = rows.where(equal)
        lo, hi, n = left.agg(F.min(key), F.max(key), F.count("*")).first()
        if n <= k:
            return below | equal
        top = 1 << 63  # a long with its sign bit turned sorts as an unsigned number
        unsigned = key.bitwiseXOR(F.lit(-top))
        shift = ((lo + top) ^ (hi + top)).bit_length()
        prefix, within = (lo + top) >> shift, equal
        while shift > 0:
            step = min(DIGIT, shift)
            shift -= step
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << step) - 1))
            for d, n in sorted(tuple(r) for r in rows.where(within).groupBy(digit.alias("d")).count().collect()):
                if n >= k:
                    break
                k -= n
            prefix = (prefix << step) | d
            first, last = F.lit((prefix << shift) - top), F.lit(((prefix + 1) << shift) - 1 - top)
            if n == k:  # all rows with this digit are wanted
                return below | equal & (key <= last)
            within = equal & key.between(first, last)
        below, equal = below | equal & (key < F.lit(prefix - top)), equal & (key == F.lit(prefix - top))
    return below | equal


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (1, 2, ... by falling score; null if not drawn).

    Of the documents with at least least_words words, floor(percent / 100 of them) are drawn.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    table = np.array(gains, np.int64)

    def weigh(texts: list) -> dict[str, list]:
        out = []
        for text in texts:
            n, features = text_features(text, longest)
            out.append((n >= least_words, len(features), int(table[_buckets(features, buckets)].sum())))
        return dict(zip(("drawable", "n_features", "weight"), map(list, zip(*out))))

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weighed = map_texts(slim, "text", ("id",), weigh, "drawable boolean, n_features long, weight long")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "resample")

    drawable = scored.where("drawable")
    keys = [F.bitwise_not("score"), F.col("id").isNull().cast("long"), F.coalesce(F.col("id").cast("long"), F.lit(0)), F.col("n_features"), F.col("row")]
    drawn = F.col("drawable") & smallest(drawable, keys, percent * drawable.count() // 100)
    out = ["id", "n_features", "weight", "score"]
    chosen = scored.where(drawn).select(*out, F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("key"))
    ranked = with_row_number(chosen, "key", "rank").select(*out, (F.col("rank") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
