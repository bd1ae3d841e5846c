"""The index of unused made rows: whole tables are matched by it, equal to comparing all pairs."""

import random

import pytest

from compare import connect, same
from rowproof.operators import evaluate as E
from rowproof.operators import rowmatch as R
from rowproof.operators.rowindex import Unused, rounded, similarity
from rowproof.queries import oracle_sql, queries

NUMBERS = [-3.0, -1.0, 0.0, 0.5, 1.0, 1.0, 2.0, 4.0, 7.25, 100.0, 1e4]


@pytest.mark.parametrize("seed", range(40))
def test_best_unused_row(seed):
    rng = random.Random(seed)
    few = {0: {(a, b): rng.choice([0.0, 0.25, 0.5, 1.0]) for a in "abc" for b in "xyz"}}
    text, number, none = 9, 2, 1  # 2 * kind + (1 if it is no number)
    draw = lambda: rng.choice(NUMBERS) if rng.random() < 0.5 else round(rng.uniform(-9, 9), 1)
    kinds = lambda: rng.choices([number, text, none], [8, 1, 1])[0]
    unused, rows = Unused(few, [1, 2], 1), {}
    for m in sorted(rng.sample(range(1000), 60)):
        rows[m] = (rng.choice("xyz"), kinds(), draw())
        unused.add(m, (rows[m][0],), (rows[m][1], text), rows[m][2] if rows[m][1] == number else float("nan"))
    for _ in range(70):
        a, kind, e = rng.choice("abc"), kinds(), draw()

        def near(k, v):
            if none in (k, kind):
                return float(k == kind)
            return similarity(e, v) if k == kind == number else 1.0 if k == kind else 0.0

        want = min(((-rounded((0.0 + few[0][a, b] + near(k, v) + 1.0) / 3), m) for m, (b, k, v) in rows.items()), default=(0.0, 0))
        got = unused.take((a,), (kind, text), e if kind == number else float("nan"), 0.3)
        assert got == ((-want[0], want[1]) if -want[0] >= 0.3 else None)
        if got:
            del rows[got[1]]


FIELDS = ["name", "city", "n"]
SCHEMA = "_seq long, grp string, name string, city string, n string"


@pytest.mark.parametrize("pairs", [100, 0])
def test_tables_without_lists(spark, pairs, monkeypatch):
    """All names match by their keyword: no lists of pairs are made, whatever is unlike and however late a row comes."""
    monkeypatch.setattr(R, "PAIRS", pairs)
    rng = random.Random(5)
    fields = FIELDS if pairs else ["name", "n"]
    n = lambda: rng.choice([None, "0", "-7", "1", "1.0", str(rng.randint(-900, 900)), f"{rng.randint(1, 9)},000.5"])
    gold = [(i, rng.choice("ab"), f"Customer#{i:09d}", rng.choice(["Oslo", "Rome", "Bergen"]), n()) for i in range(120)]
    made = [(i, g, name.upper() if i % 7 == 0 else name, rng.choice([city, "Rome", None]), rng.choice([x, "1", n()])) for i, g, name, city, x in gold if i % 13]
    gold, made = spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(made, SCHEMA)
    want = E.greedy_match(E.score_matrix(gold, made, fields, group="grp")).collect()
    monkeypatch.delattr(R, "_lists")
    got = R.match_rows(gold, made, fields, group="grp").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 90


def test_too_many_groups_and_odd_numbers_go_to_lists(spark, monkeypatch):
    rows = [(i, "a", "alpha works", f"c{i % 5}", x) for i, x in enumerate(["1", "2.5", "-1", "3", "4"] * 3)]
    gold = spark.createDataFrame(rows, SCHEMA)
    made = gold.where("_seq % 4 <> 1")
    want = E.greedy_match(E.score_matrix(gold, made, FIELDS)).collect()
    odd = gold.replace({"2.5": "1e999"}, subset=["n"])  # infinite: no number to sort by
    monkeypatch.setattr(R, "PAIRS", 30)
    mixed = R.match_rows(odd, made, FIELDS).collect()
    monkeypatch.setattr(R, "GROUPS", 2)
    assert sorted(map(tuple, R.match_rows(gold, made, FIELDS).collect())) == sorted(map(tuple, want))
    assert sorted(map(tuple, R.match_rows(odd, made, FIELDS).collect())) == sorted(map(tuple, mixed))


def test_eval_matched_cells_without_lists(spark, sf, monkeypatch):
    monkeypatch.delattr(R, "_lists")
    same(queries()["eval_matched_cells"](spark, sf), connect(sf), oracle_sql()["eval_matched_cells"])
