"""Cases that the standard tables do not hold: gaps of hours, spans in other spellings, entity groups, totals, hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from rowproof.operators import documents as D
from rowproof.operators import setchecks as S
from rowproof.operators import verify as R


def test_gaps_count_elapsed_days(spark):
    rows = [("a", 1, "2020-01-01 23:00:00"), ("b", 2, "2021-01-01 01:00:00"), ("c", 3, "2022-01-02 01:00:00"), ("c2", 4, "2022-01-02 01:00:00"), ("d", 5, "2022-01-02 20:00:00"), ("e", 6, None), ("f", 7, "soon"), ("g", 8, "2023-06-01")]
    df = spark.createDataFrame(rows, "tuple_id string, _seq long, t string")
    got = {r["tuple_id"]: r["description"].split()[0] for r in S.sequence_gaps(df, "x", "t").collect()}
    assert got == {"c": "366", "g": "514"}  # b comes 365 days and two hours after a
    assert S.sequence_gaps(df.limit(0), "x", "t").collect() == []


def test_gaps_over_many_partitions(spark):
    rng = random.Random(5)
    days = sorted(rng.randint(0, 200_000) for _ in range(400))
    df = spark.createDataFrame([(str(i), i, d) for i, d in enumerate(days)], "tuple_id string, _seq long, d int").select("tuple_id", "_seq", F.expr("cast(date_add(date'1700-01-01', d) as string)").alias("t"))
    want = {str(i): b - a for i, (a, b) in enumerate(zip(days, days[1:]), 1) if b - a > 365}
    assert {r["tuple_id"]: int(r["description"].split()[0]) for r in S.sequence_gaps(df, "x", "t").collect()} == want


@pytest.mark.parametrize("text,span,valid,place", [
    ("The  Quick brown Fox", "the quick brown", True, (0, 16)),
    ("x The\tQuick\n brown Fox", " QUICK BROWN ", True, (6, 18)),
    ("abc", "", False, (0, 3)),
    ("abc", " ", False, (0, 3)),
    ("abc", None, False, None),
    ("abc relevance_score", "relevance_score", False, (4, 19)),
    ("a (b) [c]+ d", "(B)  [C]+", True, (2, 10)),
    ("say \\Eok\\Q now", "SAY \\EOK", True, (0, 8)),
    ("w " * 80, "W  " * 60 + "zzz", True, (0, 160)),
    ("short text", "shorter", False, (0, 10)),
])
def test_spans(spark, text, span, valid, place):
    df = spark.createDataFrame([(text, span)], "text string, span string")
    r = df.select(D.span_valid(F.col("text"), F.col("span")).alias("v"), D.span_position(F.col("text"), F.col("span")).alias("p")).first()
    assert r["v"] is valid
    if place:
        assert tuple(r["p"]) == place


def greedy(values, similar):
    leader = {}
    for v in sorted(values):
        if v not in leader:
            leader[v] = v
            for w in values:
                if w not in leader and (v, w) in similar:
                    leader[w] = v
    return leader


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_entity_groups_are_greedy(spark, seed):
    rng = random.Random(seed)
    values = [f"v{i:02d}" for i in range(40)]
    some = {(a, b) for a in values for b in values if a < b and rng.random() < 0.08}
    some |= {(a, b) for a, b in zip(values[:12], values[1:12])}  # a path, where each waits for the one before
    both = some | {(b, a) for a, b in some}
    got = {r["value"]: r["leader"] for r in S.entity_groups(spark.createDataFrame(sorted(both), "a string, b string")).collect()}
    want = greedy(values, both)
    assert got == {v: want[v] for v in got} and set(got) == {a for a, _ in both}


def test_entity_groups_need_both_tables(spark):
    a = spark.createDataFrame([("1", "Alpha Works"), ("2", "Alpha Works North"), ("3", "Delta Corp."), ("4", None)], "tuple_id string, maker string")
    b = spark.createDataFrame([("9", "Delta"), ("8", "Omega Nine")], "tuple_id string, maker string")
    got = {(r["tbl"], r["tuple_id"], r["suggested_fix"]) for r in S.entity_consistency({"a": a, "b": b}, "maker").collect()}
    assert got == {("b", "9", "Delta Corp.")}
    assert S.entity_consistency({"a": a}, "maker").collect() == []


def test_totals_do_not_hang_on_the_order_of_rows(spark):
    rng = random.Random(9)
    cents = [rng.randint(1, 10**13) for _ in range(20_000)]
    rows = [(str(i), f"{c // 100}.{c % 100:02d}", "") for i, c in enumerate(cents)]
    total = sum(cents)
    for want, told in ((f"{total // 100}.{total % 100:02d}", 0), (f"{total // 100 + 1}.{total % 100:02d}", 1)):
        df = spark.createDataFrame([*rows, ("t", want, "Total")], "tuple_id string, n string, name string").repartition(7)
        got = S.summary_rows(df, "x", ["n", "name"]).collect()
        assert len(got) == told
    huge = spark.createDataFrame([("1", "1e300", ""), ("t", "1e300", "Total")], "tuple_id string, n string, name string")
    assert S.summary_rows(huge, "x", ["n", "name"]).collect() == []


def test_anchors_of_groups_too_large_to_list(spark, monkeypatch):
    monkeypatch.setattr(S, "LISTED", 4)
    rows = spark.createDataFrame([(str(i), g, i % 3) for i, g in enumerate(["big"] * 6 + ["small"] * 3 + ["one"])], "tuple_id string, grp string, owner long")
    owners = spark.createDataFrame([(k,) for k in range(4)], "id long")
    v = S.group_limit(rows, "x", "grp", 5)
    assert [r["affected_tuple_ids"] for r in v.collect()] == [None]
    assert {r["id"] for r in R.affected_anchors(v, rows, "owner", owners, "id").collect()} == {0, 1, 2}
    sums = S.join_limit(rows, "x", "grp", "owner", owners.withColumn("credits", F.lit(3.0)), "id", "credits", 10)
    assert {r["id"] for r in R.affected_anchors(sums, rows.where("owner = 1"), "owner", owners, "id").collect()} == {1}


def test_nearest_sets_equal_brute_force_with_few_comparisons(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789äöüßéèêçñåæø数据研究中心公司有限集团"
    names = sorted({"".join(rng.choices(letters, weights=[60 // (i + 1) + 1 for i in range(len(letters))], k=rng.randint(3, 14))) for _ in range(3000)})
    sets = sorted({"".join(sorted(set(n))) for n in names})
    y = spark.createDataFrame([(t, f"n-{t}") for t in sets], "y string, nearest string")
    asked = sorted({"".join(sorted(set(t) ^ set(rng.choices(letters, k=rng.randint(0, 2))))) for t in rng.sample(sets, 200)} - {""}) + ["!", "ab!"]
    got, compared = S.nearest_sets(spark.createDataFrame([(t,) for t in asked], "x string"), y)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {a: min((-jaccard(a, b), f"n-{b}") for b in sets) for a in asked}
    assert {r["x"]: (r["nearest"], round(r["score"], 9)) for r in got.collect()} == {a: (n, round(-s, 9)) for a, (s, n) in want.items() if s < 0}
    assert compared < len(asked) * len(sets) / 4
