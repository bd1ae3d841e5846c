"""Greedy row matching against comparing all pairs of rows."""

import random

import pytest

from rowproof.operators import evaluate as E
from rowproof.operators import rowmatch as R

FIELDS = ["name", "city", "n", "day"]
SCHEMA = "_seq long, grp string, name string, city string, n string, day string"
WORDS = ["alpha", "works", "north", "delta", "gamma", "Ltd", "有限公司", "数据研究", "中心"]


def edited(rng, text):
    i = rng.randrange(len(text))
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text.upper(), text + " Ltd", text, text])


def tables(rng, n):
    gold, made = [], []
    for i in range(n):
        row = (" ".join(rng.sample(WORDS, 3)), rng.choice(["Oslo", "Rome", "Bergen"]), rng.choice([str(rng.randint(1, 30)), "1,000", "x", None]), rng.choice([f"2020-01-{i % 28 + 1:02d}", "true", "", None]))
        gold.append((i, rng.choice("ab"), *row))
        if rng.random() < 0.8:
            made.append((100 + i * 7 % n, gold[-1][1], edited(rng, row[0]), row[1], rng.choice([row[2], "5"]), rng.choice([row[3], "2020/01/01", "no"])))
    made += [(900 + i, "a", *gold[0][2:]) for i in range(6)]  # repeats of one row
    return gold, made


@pytest.mark.parametrize("seed,listed,depth,pairs", [(1, 3, 1, 0), (2, 64, 8, 20_000), (3, 5, 2, 9)])
def test_equal_to_all_pairs(spark, seed, listed, depth, pairs, monkeypatch):
    monkeypatch.setattr(R, "DEPTH", depth)
    monkeypatch.setattr(R, "PAIRS", pairs)
    monkeypatch.setattr(R, "GOLD_BLOCK", 9)
    monkeypatch.setattr(R, "MADE_BLOCK", 13)
    gold, made = (spark.createDataFrame(rows, SCHEMA) for rows in tables(random.Random(seed), 40))
    want = E.greedy_match(E.score_matrix(gold, made, FIELDS, group="grp")).collect()
    got = R.match_rows(gold, made, FIELDS, group="grp", listed=listed).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_empty_and_unlike_tables(spark):
    gold = spark.createDataFrame([(1, "a", "alpha", "x", "1", None)], SCHEMA)
    assert R.match_rows(gold, gold.limit(0), FIELDS).collect() == []
    assert R.match_rows(gold.limit(0), gold, FIELDS).collect() == []
    other = spark.createDataFrame([(1, "b", "zzz", "yy", "900", "2020-01-01")], SCHEMA)
    assert R.match_rows(gold, other, FIELDS).collect() == []
    with pytest.raises(ValueError):
        R.match_rows(gold, other, [])
