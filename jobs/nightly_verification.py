"""Verification and repair of a run's tables, written by run, table and category.

    python -m jobs.nightly_verification --tables DIR --target DIR [--config FILE]

Every table named in the settings' rows is read as Parquet from tables, and its cells are taken as texts by
the SQL expressions given there.  It is verified against the declared schema, with the other tables at hand
for references and the patterns of formats; what the tools may repair is repaired.  target then holds

    violations/run=<run>/tbl=<table>/processing_category=<...>   what was found
    fixes/run=<run>/tbl=<table>/fix_type=<...>                   which cells were changed, from what to what
    rows/run=<run>/tbl=<table>                                   the table after the fixes

A table of a run is overwritten as a whole, so a rerun gives the same files' content, also after a run that
died half-way, and leaves other runs alone.  Fixes and rows come from the violations as written: each table
is verified once a run.
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import main
from rowproof.operators.setchecks import OUT
from rowproof.plans import api
from rowproof.plans.schema import parse_schema

LOG = logging.getLogger(__name__)

FOUND = ", ".join(f"{c} {'ARRAY<STRING>' if c == 'affected_tuple_ids' else 'STRING'}" for c in (*OUT, "id", "processing_category"))


def read_rows(spark: SparkSession, tables: str, name: str, cells: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{tables}/{name}.parquet").selectExpr(*(f"{sql} AS {column}" for column, sql in cells.items()))


def verify_run(spark: SparkSession, tables: str, target: str, settings: dict) -> dict[str, dict[str, int]]:
    """Writes a run's outputs; for each table, how many rows were read, and violations, fixes and rows written."""
    schema, as_of = parse_schema(settings["schema"]), dt.date.fromisoformat(settings["as_of"])
    rows = {name: read_rows(spark, tables, name, cells) for name, cells in settings["rows"].items()}
    done = {}
    for name, df in rows.items():
        place = lambda kind, table=name: f"{target}/{kind}/run={settings['run']}/tbl={table}"
        columns = [c for c in settings["rows"][name] if c not in ("tuple_id", "_seq")]
        found = api.batch_verify(df, schema, name, as_of=as_of, tables={n: d for n, d in rows.items() if n != name}, formats=settings["formats"])
        found.drop("tbl").write.mode("overwrite").partitionBy("processing_category").parquet(place("violations"))
        written = spark.read.schema(FOUND).parquet(place("violations")).withColumn("tbl", F.lit(name))
        fixes, repaired = api.fix_violations(df, written, columns)
        fixes.drop("tbl").write.mode("overwrite").partitionBy("fix_type").parquet(place("fixes"))
        repaired.write.mode("overwrite").parquet(place("rows"))
        count = lambda kind: spark.read.schema("tuple_id STRING").parquet(place(kind)).count()
        done[name] = {"read": df.count(), **{kind: count(kind) for kind in ("violations", "fixes", "rows")}}
        LOG.info("%s: %s", name, ", ".join(f"{k} {n}" for k, n in done[name].items()))
    return done


def read_back(spark: SparkSession, target: str, settings: dict) -> DataFrame:
    """A run's three outputs as rows (output, tbl, tuple_id, attr, code, value): repaired tables cell by cell."""
    parts = []
    for name, cells in settings["rows"].items():
        place = lambda kind, table=name: f"{target}/{kind}/run={settings['run']}/tbl={table}"
        columns = [c for c in cells if c not in ("tuple_id", "_seq")]
        v = spark.read.schema(FOUND).parquet(place("violations"))
        parts.append(v.select(F.lit("violations").alias("output"), F.lit(name).alias("tbl"), "tuple_id", "attr", F.concat_ws(" ", "rule_code", "processing_category").alias("code"), F.col("suggested_fix").alias("value")))
        x = spark.read.schema("tuple_id STRING, attr STRING, new STRING, fix_type STRING").parquet(place("fixes"))
        parts.append(x.select(F.lit("fixes").alias("output"), F.lit(name).alias("tbl"), "tuple_id", "attr", F.col("fix_type").alias("code"), F.col("new").alias("value")))
        r = spark.read.schema(", ".join(f"{c} STRING" for c in ("tuple_id", *columns))).parquet(place("rows"))
        cell = F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(c).alias("value")) for c in columns))).alias("c")
        parts.append(r.select("tuple_id", cell).select(F.lit("rows").alias("output"), F.lit(name).alias("tbl"), "tuple_id", "c.attr", F.lit(None).cast("string").alias("code"), "c.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


if __name__ == "__main__":
    main("nightly_verification", {"tables": "folder with <table>.parquet", "target": "folder of the outputs"}, verify_run)
