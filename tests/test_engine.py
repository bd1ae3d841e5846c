"""What the engine runs by itself, and joins, packings and sinks against brute force."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowproof.functions import values as V
from rowproof.operators import documents as D
from rowproof.operators import matching as J
from rowproof.operators import repair as P
from rowproof.operators import setchecks as S
from rowproof.operators import verify as R
from rowproof.plans import api
from rowproof.plans.routing import route
from rowproof.plans.schema import keyword_rules, parse_schema
from rowproof.sources import readers, writers
from rowproof.sources.numbering import with_row_number
from rowproof.sources.shared import shared_table


def codes(df):
    return sorted((r["tuple_id"], r["attr"], r["rule_code"]) for r in df.collect())


def test_verify_runs_gaps_totals_and_averages(spark):
    s = parse_schema({"table_name": "t", "columns": {"label": "string", "day": "date", "n": "INT"}})
    rows = [("1", 1, "a", "2001-01-01", "10"), ("2", 2, "b", "2003-01-01", "20"), ("3", 3, "total", "2003-01-02", "31"), ("4", 4, "average", "2003-01-03", "99")]
    got = codes(R.verify(spark.createDataFrame(rows, "tuple_id string, _seq long, label string, day string, n string"), s, "t"))
    assert ("2", "day", "TEMPORAL_GAP") in got and ("3", "n", "AGGREGATION_TOTAL_ROW") in got and ("4", "n", "AGGREGATION_AVERAGE_ROW") in got


def test_verify_runs_declared_limits_and_spellings(spark):
    s = parse_schema({
        "tables": [{"name": "offer", "attributes": {"student": "string", "course": "string", "teacher": "string"}}, {"name": "course", "attributes": {"course": "string", "credit": "INT", "teacher": "string"}}],
        "rules": [
            {"id": "agg_1", "type": "aggregation", "severity": "ERROR", "tables": ["offer", "course"], "validation_logic": {"aggregation_type": "sum", "group_by": "student", "aggregate_field": "credit", "join_field": "course", "max_value": 12}},
            {"id": "agg_2", "type": "aggregation", "tables": ["offer"], "validation_logic": {"aggregation_type": "count", "group_by": "course", "max_value": 2}},
        ],
    })
    offer = spark.createDataFrame([("1", 1, "x", "c1", "Acme Tools Ltd"), ("2", 2, "x", "c2", "Miller"), ("3", 3, "y", "c1", "Acme Tools Ltd"), ("4", 4, "z", "c1", "Brown")], "tuple_id string, _seq long, student string, course string, teacher string")
    course = spark.createDataFrame([("5", 1, "c1", "8", "Acme Tools Ltd."), ("6", 2, "c2", "5", "Miller")], "tuple_id string, _seq long, course string, credit string, teacher string")
    got = R.verify(offer, s, "offer", {"course": course}, families=["VALUE", "AGGREGATION"]).collect()
    by = {r["rule_code"]: r for r in got}
    assert by["AGGREGATION_JOIN_LIMIT"]["tuple_id"] == "GROUP_x" and by["AGGREGATION_JOIN_LIMIT"]["business_rule_id"] == "agg_1"
    assert by["AGGREGATION_GROUP_LIMIT"]["affected_tuple_ids"] == ["1", "3", "4"]
    assert {r["tuple_id"] for r in got if r["rule_code"] == "VALUE_ENTITY"} == {"1", "3"} and by["VALUE_ENTITY"]["suggested_fix"] == "Acme Tools Ltd."
    assert "VALUE_ENTITY" in {r["rule_code"] for r in R.verify_multi({"offer": offer, "course": course}, s).collect()}
    members = S.group_members(offer, R.verify(offer, s, "offer", {"course": course}, families=["AGGREGATION"]).where("rule_code = 'AGGREGATION_GROUP_LIMIT'"), "course")
    assert {tuple(r) for r in members.collect()} == {("AGGREGATION_c1", t) for t in "134"}


def test_verify_runs_rule_file_formats_and_suggests_references(spark):
    s = parse_schema({"tables": [{"name": "t", "attributes": {"code": "string", "ref": {"type": "string", "foreign_key": {"table": "r", "field": "k"}}}}, {"name": "r", "attributes": {"k": "string"}}]})
    formats = readers.config_rules(json.dumps({"format_rules": {"code": {"pattern": "[A-Z]\\d+"}}}))
    assert "FORMAT" in route(s, "t", formats) and "FORMAT" not in route(s, "t")
    rows = spark.createDataFrame([("1", 1, "A1", "abc"), ("2", 2, "bad", "abd")], "tuple_id string, _seq long, code string, ref string")
    ref = spark.createDataFrame([("abc",), ("xyz",)], "k string")
    got = R.verify(rows, s, "t", {"r": ref}, formats=formats)
    assert codes(got) == [("2", "code", "FORMAT_CONFIG"), ("2", "ref", "REFERENCE_FOREIGN_KEY")]
    fixed, left, fixes = P.repair_loop(rows, lambda r: R.verify(r, s, "t", {"r": ref}), ["code", "ref"], shared_table)
    assert {r["ref"] for r in fixed.collect()} == {"abc"} and left.count() == 0 and [r["fix_type"] for r in fixes.collect()] == ["nearest_reference"]


def test_repair_loop_normalises_deletes_and_remembers(spark):
    s = parse_schema({"table_name": "t", "columns": {"k": {"type": "string", "primary_key": True}, "quarter": {"type": "string", "pattern": "Q[1-4]$"}, "note": "string"}})
    rows = [("1", 1, "a", "first", "x"), ("2", 2, "a", "Q1", None), ("3", 3, "b", "Q2", "y"), ("4", 4, "a", "first", None), ("5", 5, "c", "odd", "z")]
    df = spark.createDataFrame(rows, "tuple_id string, _seq long, k string, quarter string, note string")
    normal = {"quarter": lambda c: V.normalise_quarter(c, {"first": "Q1"}, ())}
    fixed, left, fixes = P.repair_loop(df, lambda r: R.verify(r, s, "t"), ["k", "quarter", "note"], shared_table, normalisers=normal, key=["k"])
    assert sorted((r["tuple_id"], r["quarter"]) for r in fixed.collect()) == [("1", "Q1"), ("3", "Q2"), ("5", "odd")]
    kinds = {(r["tuple_id"], r["fix_type"]) for r in fixes.collect()}
    assert ("1", "format_normalisation") in kinds and ("4", "safe_delete") in kinds and ("2", "safe_delete") in kinds
    assert {r["tuple_id"] for r in left.collect()} == {"5"}
    logic = parse_schema({"table_name": "t", "columns": {"quarter": {"type": "string", "business_rules": [{"type": "pattern", "pattern": "Q"}]}}})
    seen = spark.createDataFrame([("1", "quarter")], "tuple_id string, attr string")
    _, _, tried = P.repair_loop(df, lambda r: R.verify(r, logic, "t"), ["quarter"], shared_table, normalisers=normal, history=seen)
    assert {r["tuple_id"] for r in tried.collect()} == {"4"}
    assert [r["tuple_id"] for r in P.safe_delete(df.where("k = 'a'"), ["k"], ["k", "quarter", "note"]).orderBy("_seq").collect()] == ["1", "2"]
    assert [r["id"] for r in P.first_fixes(fixes, 1).collect()] == [min((r["ord"], r["id"]) for r in fixes.collect())[1]]
    v = R.categorise(R.dedup(R.verify(df, s, "t")))
    assert api.fix_violations(df, v, ["k", "quarter", "note"])[1].count() == 5


@pytest.mark.parametrize("shard", [1, 3, 17, 1000])
def test_packing_is_the_sequential_one_at_every_shard_size(spark, shard):
    rng = random.Random(shard)
    rows = [(i, "word " * rng.choice((0, 1, 5, 20, 60, 130)), rng.random()) for i in range(150)]
    want, n, w, c = {}, 0, 0, 0
    for i, t, _ in rows:
        x, y = len(t.split()), len(t)
        if not n or ((w or c) and (w + x > 100 or c + y > 450)):
            n, w, c = n + 1, 0, 0
        w, c = w + x, c + y
        want[i] = n
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    got = {r["id"]: r["batch"] for r in D.batches(df.repartition(5), "id", "id", words=100, chars=450, shard=shard).collect()}
    assert got == want
    assert D.batches(df.limit(0), "id", "id").collect() == []


def test_boundaries_and_numbers_over_all_rows(spark):
    rows = [(f"d{i:04d}", "x" * (i * 7 % 23)) for i in range(500)]
    got = {r["name"]: (r["start"], r["stop"]) for r in D.boundaries(spark.createDataFrame(rows, "name string, text string").repartition(7), "name", "name").collect()}
    at = 0
    for name, text in rows:
        assert got[name] == (at, at + len(text))
        at += len(text) + 2
    same = spark.createDataFrame([("same",)] * 300 + [(None,)], "x string")
    assert sorted(r["_row"] for r in with_row_number(same, "x").collect()) == list(range(301))


def test_containment_and_few_edits_equal_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)} | {"report", "report2023.txt", "ü"})
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = {tuple(r) for r in J.containing(df, df).collect()}
    assert got == {(x, y) for x in words for y in words if y in x}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 34))) for _ in range(25)]
    names = set(base)
    for b in base:
        for _ in range(3):
            t = list(b)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice(([], [rng.choice("abcdefgh")], [t[k], "z"]))
            names.add("".join(t))
    names = sorted(names)
    df = spark.createDataFrame([(w,) for w in names], "value string")
    want = {(a, b) for a in names for b in names if a != b and min(len(a), len(b)) >= 5 and distance(a, b) / max(len(a), len(b)) < 0.1}
    assert {tuple(r) for r in J.few_edits(df, df).collect()} == want and len(want) > 20


def test_evidence_documents_are_found_both_ways(spark):
    evidence = spark.createDataFrame([("/a/report",), ("Report2023.txt page 2",), ("",), ("x",)], "evidence string")
    names = spark.createDataFrame([("report2023.txt",), ("docs/XY.md",), ("other",)], "name string")
    got = {tuple(r) for r in D.evidence_documents(evidence, names).collect()}
    assert got == {("/a/report", "report2023.txt"), ("Report2023.txt page 2", "report2023.txt"), ("x", "report2023.txt"), ("x", "docs/XY.md")}


def test_nearest_reference_equals_brute_force(spark):
    rng = random.Random(6)
    ref = sorted({"".join(rng.choice("abcdeXY") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    lost = sorted({"".join(rng.choice("abcdeXYz") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"???"})
    got = {r["value"]: (r["nearest"], r["score"]) for r in S.nearest_reference(spark.createDataFrame([(x,) for x in lost], "v string"), "v", spark.createDataFrame([(x,) for x in ref], "k string"), "k").collect()}
    for v in lost:
        score = lambda r: 2.0 if r.lower() == v.lower() else len(set(r.lower()) & set(v.lower())) / len(set(r.lower()) | set(v.lower()))  # noqa: B023, E731
        best = max(map(score, ref))
        assert got[v] == (min(r for r in ref if score(r) == best), pytest.approx(round(best, 6)))


def test_cache_expires_and_is_purged(spark, tmp_path):
    path = str(tmp_path / "cache")
    keys = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long")
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("out", F.col("n") * 10 + len(calls))

    assert sorted(r["out"] for r in writers.cached(spark, keys, compute, path, max_age_days=3).collect()) == [11, 21]
    assert sorted(r["out"] for r in writers.cached(spark, keys, compute, path, max_age_days=3).collect()) == [11, 21] and calls == [2, 0]
    old = spark.createDataFrame([("c", 3, 7)], "key string, n long, out long").withColumn("cached_on", F.date_sub(F.current_date(), 9))
    old.write.mode("append").partitionBy("cached_on").parquet(path)
    more = keys.union(spark.createDataFrame([("c", 3)], "key string, n long"))
    got = {r["key"]: r["out"] for r in writers.cached(spark, more, compute, path, max_age_days=3).collect()}
    assert got == {"a": 11, "b": 21, "c": 33} and spark.read.parquet(path).where("out = 7").count() == 0
    assert {r["key"]: r["out"] for r in writers.cached(spark, more, compute, path).collect()} == got


def test_broken_log_lines_fail_and_are_told(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"run_id":"r","table":"t","rows":[]}\n\n{"run_id": oops\n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_snapshots(spark, str(path)).collect()
    assert [r["line"].strip() for r in readers.broken_lines(spark, str(path)).collect()] == ['{"run_id": oops']


def test_history_views_and_rule_files(spark, tmp_path):
    (tmp_path / "violations.jsonl").write_text('{"run_id":"r1","id":"v-1","tbl":"t","severity":"error"}\n{"run_id":"r2","id":"v-2","tbl":"t","severity":"warn"}\n', encoding="utf-8")
    spark.createDataFrame([("r1", "f-1", "t")], "run_id string, id string, tbl string").write.parquet(str(tmp_path / "fixes"))
    assert readers.read_history(spark, str(tmp_path), "violations", run_id="r1").count() == 1 and readers.read_history(spark, str(tmp_path), "snapshots").count() == 0
    names = readers.history_views(spark, str(tmp_path), "h_")
    assert names == ["h_snapshots", "h_violations", "h_fixes", "h_run_summary"]
    assert [tuple(r) for r in spark.sql("SELECT run_id, n_violations, n_errors, n_fixes FROM h_run_summary ORDER BY run_id").collect()] == [("r1", 1, 1, 1), ("r2", 1, 0, 0)]
    rules = readers.aggregation_rules('{"aggregation_rules": {"agg_2": {"group_by": "g", "max": 3, "severity": "WARN"}}}')
    assert (rules[0].id, rules[0].severity, rules[0].logic) == ("agg_2", "warn", {"group_by": "g", "max": 3})


def test_sources_that_list_and_look_up(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("hi")
    (tmp_path / "a.md").write_text("text")
    (tmp_path / "c.bin").write_text("no")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.list_documents(spark, str(tmp_path)).collect()] == ["a.md", "x.txt"]
    (tmp_path / "ref.json").write_text('[{"k": "1", "v": "a"}, {"k": "2"}]')
    ref = readers.read_reference(spark, str(tmp_path / "ref.json"), ["k", "v"], view="ref_view")
    assert [tuple(r) for r in ref.orderBy("k").collect()] == [("ref-0", "1", "a"), ("ref-1", "2", None)] and spark.table("ref_view").count() == 2
    s = parse_schema({"tables": [{"name": "Offer", "attributes": {"CourseID": "string"}, "relation_extraction": {"enabled": True, "document_sources": ["d1"]}}, {"name": "Course", "attributes": {"k": "string"}}]})
    assert list(readers.entity_references(s, "Offer", {"Course": ref})) == ["CourseID"]
    assert readers.table_sources(s, "Offer", ["x"]) == ["d1"] and readers.table_sources(s, "Course", ["x"]) == ["x"]
    assert [r["id"] for r in keyword_rules([{"id": 1, "keywords": ["COURSE"]}, {"id": 2, "keywords": ["tax"]}], "t", ["CourseID"])] == [1]
    name = spark.range(1).select(V.safe_file_name(F.lit("a/b:c 1.5")).alias("n")).first()["n"]
    assert name == "a_b_c_1_5"


def test_injected_extractors_and_audits(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")

    def extract(parts):
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "n": p["text"].str.split().map(len)})

    assert sorted(map(tuple, D.map_extract(docs, extract, "id long, n long").collect())) == [(1, 2), (2, 1)]
    anchors = spark.createDataFrame([(i,) for i in range(45)], "k long")
    rel = D.map_relations(anchors, "k", lambda part: pd.DataFrame({"batch": part["batch"].iloc[:1], "first": part["k"].iloc[:1], "n": [len(part)]}), "batch long, first long, n long")
    assert sorted(map(tuple, rel.collect())) == [(1, 0, 20), (2, 20, 20), (3, 40, 5)]

    def ask(parts):
        for p in parts:
            yield pd.DataFrame({"tuple_id": p["id"].astype(str), "attr": "text", "constraint_type": "LOGIC", "severity": "warn", "description": "odd", "suggested_fix": None})

    assert {r["rule_code"] for r in S.audit(docs, ask, "t").collect()} == {"MODEL_AUDIT"}


def test_split_long_equals_a_plain_walk(spark):
    rng = random.Random(9)
    text = "\n\n".join("word " * rng.randint(5, 60) for _ in range(80))
    got = [r["text"] for r in D.split_long(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, text string"), "id", words=200, chars=1500).where("id = 1").orderBy("part").collect()]
    paragraphs = text.split("\n\n")
    assert all(p.split("\n\n")[-1] in paragraphs for p in got) and got[0].split("\n\n")[0] == paragraphs[0] and got[-1].split("\n\n")[-1] == paragraphs[-1]
    seen = [q for p in got for q in p.split("\n\n")]
    assert [q for i, q in enumerate(paragraphs) if q not in seen] == []
    assert all(len(p) <= 1500 and len(p.split()) <= 200 for p in got if "\n\n" in p)


def test_create_before_update(spark):
    s = parse_schema({"table_name": "t", "columns": {"create_time": "datetime", "update_time": "datetime"}})
    rows = spark.createDataFrame([("1", 1, "2020-01-02", "2020-01-01"), ("2", 2, "2020-01-01", "2020-01-02")], "tuple_id string, _seq long, create_time string, update_time string")
    got = [r for r in codes(R.verify(rows, s, "t", as_of=dt.date(2024, 1, 1))) if r[2] not in ("TEMPORAL_PARSE", "TEMPORAL_GAP")]
    assert {r[0] for r in got} == {"1"} and {r[2] for r in got} == {"TEMPORAL_CREATE_UPDATE"}


def test_missing_corpus_package_is_told_apart_from_missing_modules(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    code = "import sys; sys.path[:0] = [%r, %r]; import __spark_entry__" % (str(tmp_path), str(root))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert out.returncode and "no_such_module_at_all" in out.stderr
    (tmp_path / "corpus_pipeline.py").write_text("from rowproof.llm.nothing_here import x\n")
    assert not subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path).returncode
