"""The jobs: against their SQL, over growing input, reruns, odd rows, the command line."""

import json
import logging
import subprocess
import sys

import pytest

from compare import connect, same
from conftest import ROOT
from jobs import document_intake as I
from jobs import nightly_verification as N
from jobs.queries import oracle_sql, queries
from jobs.settings import load


@pytest.mark.parametrize("name", sorted(queries()))
def test_against_sql(name, spark, sf):
    before = dict(spark.conf.getAll)
    same(queries()[name](spark, sf), connect(sf), oracle_sql()[name])
    assert dict(spark.conf.getAll) == before


def chunk_rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("doc_id", "name", "language", "words", "locate", "idx", "start", "stop", "chunk_key", "chunk").collect())


def test_intake_takes_only_what_is_new(spark, sf, tmp_path, caplog):
    docs, settings = spark.read.parquet(f"{sf}/documents.parquet"), load("document_intake") | {"files_per_batch": 1}
    parts = docs.randomSplit([1.0, 1.0, 1.0], 3)
    to = {k: str(tmp_path / k) for k in ("documents", "chunks", "checkpoint")}
    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(to["documents"])
    with caplog.at_level(logging.INFO):
        assert I.intake(spark, **to, settings=settings) == parts[0].count() + parts[1].count()
    assert "documents read from" in caplog.text and "chunks" in caplog.text
    first = chunk_rows(spark, to["chunks"])
    files = sorted(p.name for p in (tmp_path / "chunks").rglob("*.parquet"))
    assert I.intake(spark, **to, settings=settings) == 0
    assert chunk_rows(spark, to["chunks"]) == first and sorted(p.name for p in (tmp_path / "chunks").rglob("*.parquet")) == files
    parts[2].coalesce(1).write.mode("append").parquet(to["documents"])
    assert I.intake(spark, **to, settings=settings) == parts[2].count()
    whole = str(tmp_path / "whole")
    I.prepare(docs, settings).write.parquet(whole)
    assert chunk_rows(spark, to["chunks"]) == chunk_rows(spark, whole)
    assert {p.name for p in (tmp_path / "chunks").iterdir() if p.name.startswith("language=")} <= {"language=en", "language=zh"}


def test_intake_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "word " * 3000, "b/spam"), (3, "本文介绍数据" * 10, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS language", "1 AS words").write.parquet(str(tmp_path / "documents"))
    settings = load("document_intake")
    to = {k: str(tmp_path / k) for k in ("documents", "chunks", "checkpoint")}
    assert I.intake(spark, **to, settings=settings) == 5
    got = spark.read.parquet(to["chunks"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["chunk"] for r in by[1]] == ["", ""] and by[2][0]["name"] is None and by[3][0]["language"] == "zh"
    assert len(by[None]) == 8 and all(r["locate"] and r["words"] == 3000 for r in by[None])
    some = I.prepare(spark.read.parquet(to["documents"]), settings | {"include": ["b"], "exclude": ["spam"]}).collect()
    assert {r["doc_id"] for r in some} == {3}


def test_verification_reruns_alike_and_leaves_other_runs(spark, sf, tmp_path):
    settings, to = load("nightly_verification"), str(tmp_path)
    done = N.verify_run(spark, sf, to, settings)
    assert all(d["read"] == d["rows"] for d in done.values()) and done["orders"]["violations"] == done["orders"]["fixes"] > 0
    first = sorted(map(str, N.read_back(spark, to, settings).collect()))
    loose = json.loads(json.dumps(settings | {"run": "2001-01-02"}))
    loose["schema"]["tables"][1]["attributes"]["c_acctbal"] = {"type": "float"}
    assert N.verify_run(spark, sf, to, loose)["customer"]["violations"] == 0
    assert N.verify_run(spark, sf, to, settings) == done
    assert sorted(map(str, N.read_back(spark, to, settings).collect())) == first
    # the same run under other settings: nothing of the old partitions stays
    N.verify_run(spark, sf, to, loose | {"run": settings["run"]})
    assert not [r for r in N.read_back(spark, to, settings).collect() if r["tbl"] == "customer" and r["output"] != "rows"]


def test_verification_uses_other_tables_and_formats(spark, tmp_path):
    spark.createDataFrame([(1, 10, "F", 5.0, "1996-01-01"), (2, 99, None, 5.0, None)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string").write.parquet(f"{tmp_path}/in/orders.parquet")
    spark.createDataFrame([(10, "Customer#000000010", 1.0), (11, "Mister X", None)], "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/in/customer.parquet")
    settings = load("nightly_verification")
    N.verify_run(spark, f"{tmp_path}/in", f"{tmp_path}/out", settings)
    got = {(r["tuple_id"], r["code"].split()[0]) for r in N.read_back(spark, f"{tmp_path}/out", settings).collect() if r["output"] == "violations"}
    assert {("orders-2", "REFERENCE_FOREIGN_KEY"), ("orders-2", "STRUCTURE_NOT_NULL")} <= got
    assert any(t == "customer-11" and c.startswith("FORMAT") for t, c in got)


def test_command_line(sf, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"chunk_chars": 500}))
    args = [sys.executable, "-m", "jobs.document_intake", "--documents", f"{sf}/documents.parquet", "--chunks", str(tmp_path / "c"), "--checkpoint", str(tmp_path / "k"), "--config", str(config)]
    out = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "200 documents read" in out.stderr and list((tmp_path / "c").rglob("*.parquet"))
