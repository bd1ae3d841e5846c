"""Streams with state, ledgers of batches, stored runs, warm extraction."""

import datetime as dt

import pandas as pd

from rowproof.operators.documents import map_warm
from rowproof.sources.writers import clear, store
from rowproof.streaming.verify_stream import latest_stage, merge_when_complete

LOG = "run_id string, tbl string, stage string, created_at timestamp"


def append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_latest_stage_forgets(spark, tmp_path):
    path, day = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    append(spark, [("r", "a", "extraction", day), ("r", "a", "fixing", day + dt.timedelta(hours=2)), ("r", "b", "extraction", day)], LOG, path)
    out = latest_stage(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path), ["run_id", "tbl"], "created_at", keep="2 days")
    seen = []
    start = lambda: out.writeStream.outputMode("update").foreachBatch(lambda d, n: seen.extend(tuple(r) for r in d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    def run():
        q = start()
        q.awaitTermination(180)
        return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]

    assert run()[-1] == 2
    assert {(t, s) for _, t, s, _ in seen} == {("a", "fixing"), ("b", "extraction")}
    seen.clear()
    append(spark, [("r", "a", "verification", day + dt.timedelta(hours=1)), ("r", "b", "final", day + dt.timedelta(hours=3))], LOG, path)
    run()
    assert {(t, s) for _, t, s, _ in seen} == {("b", "final")}  # a's is older than what is known
    append(spark, [("r", "z", "extraction", day + dt.timedelta(days=30))], LOG, path)
    totals = run()
    append(spark, [("r", "z", "final", day + dt.timedelta(days=31))], LOG, path)
    assert (totals + run())[-1] == 1  # a and b are gone
    batch = latest_stage(spark.read.parquet(path), ["run_id", "tbl"], "created_at").collect()
    assert {(r["tbl"], r["stage"]) for r in batch} == {("a", "fixing"), ("b", "final"), ("z", "final")}


def test_batches_are_merged_once_when_all_are_there(spark, tmp_path):
    schema, path, target = "run_id string, tbl string, batch int, n_batches int, v string", str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        merge_when_complete(stream, target, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
        return sorted((r["tbl"], r["v"]) for r in spark.read.parquet(f"{target}/merged").collect())

    append(spark, [("r", "t", 1, 3, "a"), ("r", "t", 1, 3, "b"), ("r", "u", 1, 1, "x")], schema, path)
    assert run() == [("u", "x")]
    append(spark, [("r", "t", 3, 3, "c"), ("r", "t", 3, 3, "a")], schema, path)
    append(spark, [("r", "t", 1, 3, "other")], schema, path)  # batch 1 again: the first delivery counts
    assert run() == [("u", "x")]
    append(spark, [("r", "t", 2, 3, "d")], schema, path)
    assert run() == [("t", "a"), ("t", "b"), ("t", "c"), ("t", "d"), ("u", "x")]
    append(spark, [("r", "t", 2, 3, "late")], schema, path)
    assert run() == [("t", "a"), ("t", "b"), ("t", "c"), ("t", "d"), ("u", "x")]


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("r", "t", 1, 1, "a")], "run_id string, tbl string, batch int, n_batches int, v string")
    taken = []

    class Stream:
        """Stands for a stream: hands out the function that foreachBatch is given."""

        writeStream = property(lambda self: self)

        def foreachBatch(self, f):
            taken.append(f)
            return self

        def option(self, *_):
            return self

    merge_when_complete(Stream(), str(tmp_path), "c")
    for epoch in (0, 0, 1, 0, 1):
        taken[0](rows, epoch)
    assert [(r["epoch"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/merged").collect()] == [(0, "a")]


def test_store_and_clear_one_run_and_table(spark, tmp_path):
    v, path = spark.createDataFrame([("v1", "a"), ("v2", "b")], "id string, attr string"), str(tmp_path / "v")
    for run, table in (("r1", "t"), ("r1", "u"), ("r2", "t")):
        store(v, path, run, table)
    left = lambda: sorted((r["run_id"], r["tbl"], r["id"]) for r in spark.read.parquet(path).collect())
    store(v.limit(1), path, "r1", "t")
    assert left() == [("r1", "t", "v1"), ("r1", "u", "v1"), ("r1", "u", "v2"), ("r2", "t", "v1"), ("r2", "t", "v2")]
    clear(v, path, "r1", "u")
    store(v.limit(0), path, "r2", "t")
    assert left() == [("r1", "t", "v1")]


def test_warm_extraction(spark):
    docs = spark.createDataFrame([("e1", "alpha 5"), ("e1", "beta"), ("e2", "gamma")], "entity string, text string")
    rows = spark.createDataFrame([("e1", "4", 1.5), ("e3", "9", None)], "entity string, size string, x double")
    wrong = spark.createDataFrame([("e1", "size")], "entity string, attr string")

    def extract(own, earlier, found):
        assert list(earlier.columns) == ["entity", "size", "x"] and list(found.columns) == ["entity", "attr"]
        size = "5" if len(found) else (earlier["size"].iloc[0] if len(earlier) else "new")
        return pd.DataFrame({"entity": [own["entity"].iloc[0]], "size": [size], "n": [len(own)]})

    got = {(r["entity"], r["size"], r["n"]) for r in map_warm(docs, rows, wrong, "entity", extract, "entity string, size string, n long").collect()}
    assert got == {("e1", "5", 2), ("e2", "new", 1)}
