"""Violations of different cells whose 32-bit ids are the same stay apart."""

from pyspark.sql import functions as F

from jobs import nightly_verification as N
from jobs.settings import load
from rowproof.operators import repair as P
from rowproof.operators import verify as R
from rowproof.plans.schema import parse_schema
from rowproof.queries import queries
from rowproof.sources.shared import shared_table

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def orders(spark, to, rows):
    spark.createDataFrame([(k, 1, status, price, None, None) for k, status, price in rows], ORDER).withColumn("o_orderdate", F.lit("1994-05-06").cast("timestamp_ntz")).write.parquet(f"{to}/orders.parquet")
    spark.createDataFrame([(1, "Customer#000000001", 1.0)], "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{to}/customer.parquet")


def test_dedup_violations(spark, tmp_path):
    orders(spark, tmp_path, [(3462, "X", 1.0), (129507, "X", 1.0)])  # md5 of both cells begins with 9382ede5
    got = queries()["dedup_violations"](spark, str(tmp_path)).collect()
    assert {(r["id"], r["tuple_id"]) for r in got} == {("v-9382ede5", "t-3462"), ("v-9382ede5", "t-129507")} and len(got) == 2


def test_repair_loop_fixes_and_reports_both(spark):
    s = parse_schema({"tables": [{"name": "orders", "attributes": {"o_orderstatus": {"type": "string", "domain": ["F", "O", "P"]}, "o_totalprice": {"type": "float", "min": 0}}}]})
    keys = [3462, 129507, 9849, 333329]
    rows = spark.createDataFrame([(f"t-{k}", k, "f" if k in keys[:2] else "F", None if k in keys[2:] else "1") for k in keys], "tuple_id string, _seq long, o_orderstatus string, o_totalprice string")
    fixed, left, fixes = P.repair_loop(rows, lambda r: R.verify(r, s, "orders"), ["o_orderstatus", "o_totalprice"], shared_table)
    assert {r["tuple_id"] for r in fixes.collect()} == {"t-3462", "t-129507"} and {r["o_orderstatus"] for r in fixed.collect()} == {"F"}
    assert {(r["tuple_id"], r["id"]) for r in left.collect()} == {("t-9849", "v-eb90a406"), ("t-333329", "v-eb90a406")}


def test_nightly_verification(spark, tmp_path):
    orders(spark, f"{tmp_path}/in", [(15227, "F", 1.0), (142778, "F", 1.0)])
    settings = load("nightly_verification")
    done = N.verify_run(spark, f"{tmp_path}/in", f"{tmp_path}/out", settings)
    assert done["orders"] == {"read": 2, "violations": 2, "fixes": 2, "rows": 2}
    got = [r for r in N.read_back(spark, f"{tmp_path}/out", settings).collect() if r["output"] == "rows" and r["attr"] == "o_orderdate"]
    assert {(r["tuple_id"], r["value"]) for r in got} == {("orders-15227", "1995-01-01"), ("orders-142778", "1995-01-01")}
