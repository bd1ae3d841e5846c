"""Batch packing against the plain walk, with empty, tiny and oversize documents and many shards."""

import random
import re
import time

import pytest

from rowproof.operators import documents as D


def walk(texts, words, chars):
    out, n, a, b = [], 1, 0, 0
    for t in texts:
        w, c = len(re.findall(r"[一-龥]|[a-zA-Z]+", t or "")), len(t or "")
        if (a or b) and (a + w > words or b + c > chars):
            n, a, b = n + 1, 0, 0
        a, b = a + w, b + c
        out.append(n)
    return out


@pytest.mark.parametrize("seed,words,chars,shard", [(1, 5, 20, 3), (2, 3, 1000, 7), (3, 100, 12, 50), (4, 4, 16, 1)])
def test_equal_to_the_walk(spark, seed, words, chars, shard):
    rng = random.Random(seed)
    kinds = ["", "", "a", "bb cc", "x" * 40, "one two three four five six", "数据 ok", None, "."]
    texts = [rng.choice(kinds) for _ in range(60)] + [""] * 20 + [rng.choice(kinds) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["batch"] for r in D.batches(df, "id", "id", words=words, chars=chars, shard=shard).collect()}
    assert [got[i] for i in range(len(texts))] == walk(texts, words, chars)


def test_many_empty_texts_are_linear(spark):
    df = spark.range(300_000).selectExpr("id", "if(id % 100000 = 7, 'some text', '') AS text")
    start = time.monotonic()
    got = D.batches(df, "id", "id", words=4, chars=100).groupBy("batch").count().collect()
    assert sorted(r["batch"] for r in got) == [1, 2] and sum(r["count"] for r in got) == 300_000
    assert time.monotonic() - start < 120
