"""State and history: stage logs, latest snapshots, run summaries, flat views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a table's life and the legal steps between them.
STATES = ("created", "extracting", "extracted", "verifying", "verified", "fixing", "fixed", "final", "failed", "cancelled")
STEPS = {
    "created": ("extracting", "cancelled"), "extracting": ("extracted", "failed", "cancelled"), "extracted": ("verifying", "failed", "cancelled"), "verifying": ("verified", "failed", "cancelled"),
    "verified": ("fixing", "final", "extracting", "failed"), "fixing": ("fixed", "failed", "cancelled"), "fixed": ("verifying", "final", "failed"), "final": (), "failed": ("extracting",), "cancelled": (),
}


def latest_snapshots(log: DataFrame, keys: tuple[str, ...] = ("run_id", "tbl", "stage")) -> DataFrame:
    """The newest entry of each key, by a partial aggregate instead of a window; ties: the whole row."""
    order = F.struct("created_at", F.xxhash64(*log.columns))
    return log.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in log.columns if c not in keys)), order).alias("r")).select(*keys, "r.*")


def run_summary(rows: DataFrame, violations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per table: rows, violations, errors, fixes."""
    a = rows.groupBy("tbl").agg(F.count("*").alias("n_rows"))
    b = violations.groupBy("tbl").agg(F.count("*").alias("n_violations"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    c = fixes.groupBy("tbl").agg(F.count("*").alias("n_fixes"))
    out = a.join(b, "tbl", "full").join(c, "tbl", "full")
    return out.select("tbl", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_rows", "n_violations", "n_errors", "n_fixes")))


def illegal_steps(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Events whose state may not follow the one before of the same key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    legal = F.create_map(*(x for s, nxt in STEPS.items() for x in (F.lit(s), F.array(*(F.lit(n) for n in nxt)) if nxt else F.array().cast("array<string>"))))
    e = events.withColumn("before", F.lag(state).over(w))
    return e.where("before is not null").where(~F.coalesce(F.array_contains(F.try_element_at(legal, F.col("before")), F.col(state)), F.lit(False)))


def flat_cells(rows: DataFrame, names: list[str], tuple_id: str = "tuple_id") -> DataFrame:
    """For display: one row a cell."""
    return rows.select(tuple_id, F.explode(F.array(*(F.struct(F.lit(n).alias("attr"), F.col(n).cast("string").alias("value")) for n in names))).alias("c")).select(tuple_id, "c.attr", "c.value")


def stage_key(run: Column, table: Column, stage: Column, ts: Column) -> Column:
    return F.concat_ws("_", F.lit("snapshot"), run, table, stage, ts.cast("string"))
