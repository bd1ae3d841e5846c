"""Segments meet the documents that hold them by blocks, not by comparing a group's pairs."""

import random

from rowproof.operators import documents as D


def test_equal_to_all_pairs(spark):
    rng = random.Random(6)
    bounds = [(g, str(i), s, s + n) for i in range(150) for g, s, n in [(rng.choice(["a", "b", None]), rng.randint(-50, 900), rng.choice([0, 1, 2, 3, 4, 17, 64, 65, 700]))]]
    bounds += [("a", "vast", -(2**40), 2**41), ("a", "back", 5, 3)]
    segments = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-60, 1000)])) for i in range(200)] * 2
    df = D.segment_source(spark.createDataFrame(segments, "seg long, g string, start int"), spark.createDataFrame(bounds, "g string, name string, start long, stop long"), "g")
    want = []
    for i, g, at in segments:
        hit = [n for h, n, s, e in bounds if g is not None and g == h and at is not None and s <= at < e]
        want += [(i, g, at, n) for n in hit or [None]]
    assert df.columns == ["seg", "g", "start", "source"] and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_no_bounds_and_no_products(spark):
    segments = spark.createDataFrame([(1, "a", 3)], "seg long, g string, start long")
    bounds = spark.createDataFrame([("a", "x", 0, 5)], "g string, name string, start long, stop long")
    assert [tuple(r) for r in D.segment_source(segments, bounds.limit(0), "g").collect()] == [(1, "a", 3, None)]
    # 40 000 starts of one group against 40 000 documents of it
    many = spark.range(40_000).selectExpr("'a' AS g", "CAST(id AS STRING) AS name", "id * 10 AS start", "id * 10 + 9 AS stop")
    got = D.segment_source(spark.range(40_000).selectExpr("id AS seg", "'a' AS g", "id * 10 + 3 AS start"), many, "g")
    assert got.where("source = CAST(seg AS STRING)").count() == 40_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(_s#" not in "".join(line for line in plan.splitlines() if "Join LeftOuter" in line)
