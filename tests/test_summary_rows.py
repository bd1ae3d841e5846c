"""Tables without a total or average row are not summed."""

from pyspark.sql import functions as F

from rowproof.operators import setchecks as S

SCHEMA = "tuple_id string, name string, n string"


def test_numbers_are_read_for_marked_rows_only(spark, monkeypatch):
    plain = spark.createDataFrame([("1", "a", "2"), ("2", "b", "3")], SCHEMA)
    marked = plain.union(spark.createDataFrame([("3", "Total", "7"), ("4", "AVG", "4")], SCHEMA))
    got = S.summary_rows(marked, "t", ["name", "n"], None).collect()
    assert {(r["tuple_id"], r["attr"], r["rule_code"], r["suggested_fix"]) for r in got} == {("3", "n", "AGGREGATION_TOTAL_ROW", "9.0")}  # 2 + 3 + 4; the mean of 2, 3, 7 holds
    monkeypatch.setattr(S.V, "to_number", lambda c, spaces=False: F.raise_error(F.concat(F.lit("read "), c)).cast("double"))
    assert S.summary_rows(plain, "t", ["name", "n"], None).collect() == []
