"""Semantic edges of the engine's own operators, and invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowproof.functions import values as V
from rowproof.operators import checks as C
from rowproof.operators import documents as D
from rowproof.operators import evaluate as E
from rowproof.operators import merge as M
from rowproof.operators import repair as P
from rowproof.operators import setchecks as S
from rowproof.operators import verify as R
from rowproof.plans.routing import route, skipped
from rowproof.plans.schema import parse_schema
from rowproof.sources import readers, writers
from rowproof.sources.numbering import with_row_number
from rowproof.sources.shared import shared_table

AS_OF = dt.date(2024, 1, 1)


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column.alias("x")).first()["x"]


def table(**attrs):
    return parse_schema({"tables": [{"name": "t", "attributes": attrs}]}).tables[0]


def test_four_layouts():
    a = {"x": {"type": "INT", "constraints": {"nullable": False, "type": "TEXT"}}}
    layouts = [{"tables": [{"name": "t", "attributes": a}]}, {"tables": [{"name": "t", "fields": [{"name": "x", **a["x"]}]}]}, {"tables": {"t": {"attributes": a}}}, {"table_name": "t", "columns": a}]
    for s in map(parse_schema, layouts):
        t = s.table("T")
        assert t.name == "t" and t.attr("x").type == "INT" and t.attr("x").get("nullable") is False
    twice = parse_schema({"tables": [{"name": "t", "attributes": a}, {"name": "t", "attributes": a}, {"name": "u", "attributes": a}]})
    assert [t.name for t in twice.tables] == ["t_1", "t_2", "u"] and twice.shared_fields() == {"x": ["t_1", "t_2", "u"]}
    assert twice.targets("nope") == ["t_1", "t_2", "u"] and twice.targets("u") == ["u"]


def test_foreign_key_from_relations_and_routing():
    s = parse_schema({"tables": [{"name": "a", "attributes": {"b_id": {"type": "INT", "foreign_key": True}}}, {"name": "B", "attributes": {"id": {"type": "INT", "primary_key": True}}}], "relations": [{"type": "many-to-one", "from": {"table": "a", "field": "b_id"}, "to": {"table": "B", "field": "id"}}]})
    assert s.foreign_key("a", "b_id") == ("B", "id") and s.reference_of("b_id") == "B" and s.reference_of("BID") == "B"
    assert route(s, "a") == ["TYPE", "VALUE", "STRUCTURE", "REFERENCE"] and "LOGIC" in skipped(s, "a")


@pytest.mark.parametrize("text, kind, ok", [
    ("1_000", "integer", False), ("¥1,000", "integer", True), ("5d", "float", False), ("1e3", "float", True), ("-1.5", "decimal", False), ("1.5", "decimal", True),
    ("2024-1-5", "date", False), ("20240105", "date", True), ("2024-01-05 10:00", "datetime", True), ("是", "boolean", True), ("True ", "boolean", True), ("t", "boolean", False), ("  ", "integer", True), (None, "integer", True),
])
def test_types(spark, text, kind, ok):
    df = spark.createDataFrame([("1", text)], "tuple_id string, a string")
    assert R.apply_checks(df, "t", C.type_checks(table(a=kind))).count() == (0 if ok else 1)


def test_nearest_and_similarity(spark):
    assert one(spark, C.nearest(F.col("a"), ["F", "O", "P"]), a="o ") == "O"
    assert one(spark, V.char_jaccard(F.col("a"), F.col("b")), a="Abc", b="bcd") == 0.5
    assert one(spark, V.similar_entities(F.col("a"), F.col("b")), a="格力电器", b="格力电器股份有限公司") is True
    assert one(spark, V.similar_entities(F.col("a"), F.col("b")), a="same", b="same") is False
    assert one(spark, V.parse_date(F.col("a")).cast("string"), a="05/01/2024") == "2024-01-05 00:00:00"
    assert one(spark, V.suggest_date(F.col("a")), a="01/15/2024") == "2024-01-15"


def test_compare_follows_the_types(spark):
    c = lambda a, b: one(spark, E.compare(F.col("a"), F.col("b")), a=a, b=b)
    assert c(None, "")["match"] and not c(None, "x")["match"]
    assert c("1,000.50", "1000.5")["match_type"] == "exact_numeric" and not c("5", "five")["match"]
    assert c("100", "90")["similarity"] == pytest.approx(0.9) and c("2024/01/05", "2024-01-05")["match_type"] == "date_normalized"
    assert c("yes", "true")["match"] and c("Hello  World", "hello world")["match_type"] == "string_similar"


def test_string_bounds_and_not_null(spark):
    df = spark.createDataFrame([("1", "null", "5"), ("2", "x", "11")], "tuple_id string, a string, b string")
    t = table(a={"constraints": ["NOT NULL"], "type": "TEXT"}, b={"constraints": ["CHECK <= 10", "CHECK > 5"]})
    got = {(r["tuple_id"], r["rule_code"], r["suggested_fix"]) for r in R.apply_checks(df, "t", C.value_checks(t)).collect()}
    assert got == {("1", "VALUE_MISSING", "未知"), ("1", "VALUE_RANGE", "5.001"), ("2", "VALUE_RANGE", "10.0")}


def test_dedup_is_idempotent_and_order_free(spark):
    rows = [(str(i % 7), "a", "VALUE", c, d) for i, c, d in ((i, f"C{i % 3}", f"d{i % 5}") for i in range(60))]
    random.Random(3).shuffle(rows)
    v = R.with_ids(spark.createDataFrame(rows, "tuple_id string, attr string, constraint_type string, rule_code string, description string").withColumn("tbl", F.lit("t")))
    once = R.dedup(v)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.dedup(once.repartition(3)).collect())) and once.count() == 7


def test_repair_loop_leaves_nothing_tool_fixable(spark):
    s = parse_schema({"tables": [{"name": "t", "attributes": {"st": {"domain": ["F", "O"]}, "d": {"type": "date"}}}]})
    rows = spark.createDataFrame([("1", 1, "f", "2024/01/05"), ("2", 2, "O", "20240106"), ("3", 3, "oo", "never")], "tuple_id string, _seq long, st string, d string")
    fixed, left, fixes = P.repair_loop(rows, lambda r: R.verify(r, s, "t"), ["st", "d"], shared_table)
    assert {(r["tuple_id"], r["st"], r["d"]) for r in fixed.collect()} == {("1", "F", "2024/01/05"), ("2", "O", "20240106"), ("3", "O", "never")}
    assert {r["rule_code"] for r in left.collect()} <= {"TYPE_DATE", "TEMPORAL_PARSE"} and fixes.count() == 2


def test_subset_dominance_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(str(i), i, *(rng.choice([None, "", "null", "x", "y"]) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "tuple_id string, _seq long, a string, b string, c string")
    cells = {r[0]: frozenset((k, v) for k, v in zip("abc", r[2:]) if v not in (None, "", "null")) for r in rows}
    lost = {t for t, x in cells.items() if any((u != t) and ((x == y and int(u) < int(t)) or (x and x < y)) for u, y in cells.items())}
    assert {r["tuple_id"] for r in M.dedup_subset(df, ["a", "b", "c"]).collect()} == set(cells) - lost


def test_relation_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("1", None), ("2", "z"), ("3", "k")], "tuple_id string, f string")
    ref = spark.createDataFrame([("k",)], "k string")
    codes = lambda **o: sorted((r["tuple_id"], r["rule_code"]) for r in S.relation(df, "t", "f", ref, "k", **o).collect())
    assert codes() == [("2", "REFERENCE_RELATION")] and codes(nullable=False) == [("1", "REFERENCE_NULL"), ("2", "REFERENCE_RELATION")]
    assert S.foreign_key(df.limit(0), "t", "f", ref, "k").count() == 0 and S.foreign_key(df, "t", "f", ref.limit(0), "k").count() == 2


def test_chunks_cover_the_text():
    text = ("One sentence here. " * 40 + "\n\n") * 30
    bounds = D.chunk_bounds(text, 1000, 100)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(b[0] == a[1] - 100 for a, b in zip(bounds, bounds[1:])) and all(b - a <= 1000 for a, b in bounds)
    with pytest.raises(ValueError):
        D.chunk_bounds(text, 100, 50)
    assert D.chunk_bounds("", 10, 1) == [(0, 0)]
    parts = D.split_paragraphs("\n\n".join(["word " * 50] * 40), words=200, chars=10_000)
    assert len(parts) > 8


def test_batches_respect_both_limits(spark):
    rows = [(i, "word " * (i % 40 + 1)) for i in range(200)]
    got = D.batches(spark.createDataFrame(rows, "id long, text string"), "id", "id", words=100, chars=400).collect()
    size = {}
    for r in got:
        size.setdefault(r["batch"], []).append(rows[r["id"]])
    assert all(len(b) == 1 or (sum(len(t.split()) for _, t in b) <= 100 and sum(len(t) for _, t in b) <= 400) for b in size.values())


def test_row_numbers(spark):
    rows = [(x,) for x in [5.0, 1.0, 1.0, None, 100000.0] + [float(i) for i in range(500)]]
    got = sorted(r["_row"] for r in with_row_number(spark.createDataFrame(rows, "x double"), "x").collect())
    assert got == list(range(len(rows)))


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "answer.json").write_text('{"t": [{"a": "1"}, {"a": null, "b": "x"}]}', encoding="utf-8")
    gold = readers.wide(readers.read_gold(spark, str(tmp_path / "answer.json")), ["a", "b"])
    assert sorted((r["_seq"], r["a"], r["b"]) for r in gold.collect()) == [(0, "1", None), (1, None, "x")]
    (tmp_path / "log.jsonl").write_text('{"run_id":"r","table":"t","rows":[{"tuple_id":"1","cells":{"a":{"value":"v"},"b":{"best":{"value":"w"}}}}]}\n\n', encoding="utf-8")
    row = readers.read_snapshots(spark, str(tmp_path / "log.jsonl")).first()
    assert (row["tuple_id"], row["cells"]) == ("1", {"a": "v", "b": "w"})
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("héllo", encoding="utf-8")
    (docs / "b.txt").write_bytes("中文".encode("gbk"))
    (docs / "c.pdf").write_bytes(b"%PDF")
    assert [r["text"] for r in readers.read_documents(spark, str(docs)).orderBy("path").collect()] == ["héllo", "中文", ""]
    df = spark.createDataFrame([("x", None), ("__DELETED__", "y")], "b string, a string")
    assert [r["json"] for r in writers.result_rows(df, ["a", "b", "c"]).collect()] == ['{"a":"","b":"x","c":""}']
    writers.append_snapshot(df, str(tmp_path / "stages"), "r", "t", "final")
    assert spark.read.parquet(str(tmp_path / "stages")).where("stage = 'final'").count() == 2


def test_dataset_walks(spark, tmp_path):
    case = tmp_path / "db" / "case1"
    (case / "docs").mkdir(parents=True)
    for f in ("schema.json", "answer.json", "docs/a.txt"):
        (case / f).write_text("{}", encoding="utf-8")
    (tmp_path / "db" / "case2").mkdir()
    (tmp_path / "db" / "case2" / "schema.json").write_text("{}", encoding="utf-8")
    assert [tuple(r) for r in readers.dataset_cases(spark, str(tmp_path)).collect()] == [("db", "case1")]
    out = tmp_path / "out" / "db" / "case1" / "m"
    out.mkdir(parents=True)
    (out / "result.json").write_text("{}", encoding="utf-8")
    assert [r["method"] for r in readers.method_outputs(spark, str(tmp_path / "out")).collect()] == ["m"]


def test_stream_equals_batch(spark, tmp_path):
    from rowproof.streaming.verify_stream import verify_rows

    src = tmp_path / "in"
    df = spark.createDataFrame([(str(i), "x" if i % 3 else "F") for i in range(30)], "tuple_id string, st string")
    df.write.parquet(str(src))
    s = parse_schema({"tables": [{"name": "t", "attributes": {"st": {"domain": ["F"]}}}]})
    q = verify_rows(spark.readStream.schema(df.schema).parquet(str(src)), s, "t", AS_OF).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["id"] for r in spark.table("seen").collect()) == sorted(r["id"] for r in verify_rows(df, s, "t", AS_OF).collect())


def _stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _drain(stream, name, mode, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_window_counts_on_a_stream(spark, tmp_path):
    from rowproof.streaming.verify_stream import latest_stage, window_counts

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "TYPE" if m % 2 else "VALUE", h * 60 + m) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, constraint_type string, n long").withColumn("ts", F.col("t").cast("timestamp"))
    src = _stream(spark, df.drop("t"), tmp_path / "in")
    got = _drain(window_counts(src, "ts"), "windows", "complete", tmp_path / "c1")
    want = window_counts(df, "ts").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["n"] for r in got) == len(rows)
    newest = _drain(latest_stage(src, ["constraint_type"], "ts"), "newest", "complete", tmp_path / "c2")
    assert {r["constraint_type"]: r["n"] for r in newest} == {k: max(n for _, kk, n in rows if kk == k) for k in ("TYPE", "VALUE")}


def test_stream_references_duplicates_and_batches(spark, tmp_path):
    from rowproof.streaming.verify_stream import distinct_rows, merge_batches, verify_reference

    df = spark.createDataFrame([(str(i), str(i % 5), "2024-01-01 00:00:00") for i in range(20)], "tuple_id string, k string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    src = _stream(spark, df, tmp_path / "in")
    ref = spark.createDataFrame([("0",), ("1",)], "k string")
    lost = _drain(verify_reference(src, "t", "k", ref, "k"), "lost", "append", tmp_path / "c1")
    assert len(lost) == 12 and len(lost) == verify_reference(df, "t", "k", ref, "k").count()
    assert len(_drain(distinct_rows(src, ["k"], "ts"), "once", "append", tmp_path / "c2")) == 5
    seen = []
    merge_batches(src, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(120)
    assert sum(n for _, n in seen) == 20


def test_greedy_match_equals_brute_force(spark):
    """Names edited in every row, and missing rows, so that no field need agree."""
    rng = random.Random(3)
    fields = ["name", "town", "amount"]
    name = lambda: "".join(rng.choice("abcdefgh ") for _ in range(12)).strip() or "x"
    gold = [(i, name(), rng.choice(["north", "south", "eastern"]), str(rng.randrange(100, 900))) for i in range(25)]
    made = [(i, n[:-1] + "z", t + "x", str(int(a) + 1)) for i, n, t, a in gold if i % 4]
    schema = "_seq long, name string, town string, amount string"
    g, m = spark.createDataFrame(gold, schema), spark.createDataFrame(made, schema)
    pairs = g.select(F.col("_seq").alias("g"), *(F.col(f).alias(f"g_{f}") for f in fields)).crossJoin(m.select(F.col("_seq").alias("m"), *(F.col(f).alias(f"m_{f}") for f in fields)))
    score = {(r["g"], r["m"]): r["s"] for r in pairs.select("g", "m", F.round(E.row_similarity([(F.col(f"g_{f}"), F.col(f"m_{f}")) for f in fields]), 9).alias("s")).collect()}
    want, used = set(), set()
    for i, *_ in gold:
        free = [(-score[i, j], j) for j, *_ in made if j not in used and score[i, j] >= 0.3]
        if free:
            want.add((i, min(free)[1]))
            used.add(min(free)[1])
    got = {(r["g"], r["m"]) for r in E.greedy_match(E.score_matrix(g, m, fields)).collect()}
    assert got == want and len(want) > 15


def test_closure_has_no_depth_cap(spark):
    rows = [(str(i), str(i + 1)) for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {tuple(r) for r in S.closure(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {(str(i), str(j)) for i in range(101) for j in range(i + 1, 101)} | {(a, b) for a in "xyz" for b in "xyz"}
