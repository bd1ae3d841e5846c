"""Sinks: stage logs, violations, results, reports, a cache keyed by content."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.repair import purge_deleted


def append_snapshot(rows: DataFrame, path: str, run_id: str, table: str, stage: str, description: str = "") -> None:
    """Appends rows to the stage log, partitioned so that reading one run, table or stage prunes the rest."""
    out = rows.withColumns({"run_id": F.lit(run_id), "tbl": F.lit(table), "stage": F.lit(stage), "stage_description": F.lit(description)})
    out.write.mode("append").partitionBy("run_id", "tbl", "stage").parquet(path)


def store(rows: DataFrame, path: str, run_id: str, table: str) -> None:
    """Violations or fixes of one run and table: replaces what was stored for these, and nothing else."""
    out = rows.drop("run_id", "tbl").withColumns({"run_id": F.lit(run_id), "tbl": F.lit(table)})
    if not out.head(1):
        clear(rows, path, run_id, table)
    else:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "tbl").parquet(path)


def clear(like: DataFrame, path: str, run_id: str, table: str) -> None:
    """Empties one run and table; like: any frame with the stored columns.  A dynamic overwrite without rows would keep them."""
    if not all(re.fullmatch(r"[\w.-]+", part) for part in (run_id, table)):
        raise ValueError("run and table must be plain names")
    like.drop("run_id", "tbl").limit(0).write.mode("overwrite").parquet(f"{path}/run_id={run_id}/tbl={table}")


def overwrite_json(df: DataFrame, path: str) -> None:
    """Violations or fixes as JSON lines."""
    df.write.mode("overwrite").json(path)


def ordered(df: DataFrame, schema_columns: list[str]) -> DataFrame:
    """Schema columns first, in order; others last."""
    return df.select(*(c for c in schema_columns if c in df.columns), *(c for c in df.columns if c not in schema_columns))


def result_rows(df: DataFrame, schema_columns: list[str]) -> DataFrame:
    """Schema columns as texts, missing ones '', without deleted rows; one JSON text a row."""
    named = df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in schema_columns))
    return purge_deleted(named, schema_columns).select(F.to_json(F.struct(*schema_columns)).alias("json"))


def write_result(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Every table's rows as JSON texts under <path>/table=<name>."""
    for name, (df, columns) in tables.items():
        result_rows(df, columns).write.mode("overwrite").text(f"{path}/table={name}")


def write_summary(df: DataFrame, path: str) -> None:
    """A method summary as CSV with a header (there is no spreadsheet sink)."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def cached(spark: SparkSession, keys: DataFrame, compute, path: str, key: str = "key", max_age_days: int | None = None) -> DataFrame:
    """Results by content key: those in the cache at path, the others computed and appended to it.

    keys has the column key and whatever compute (DataFrame -> DataFrame with key) needs.  The cache has a folder
    a day; days older than max_age_days are neither read nor kept.  A key comes back once, its newest result.
    """

    def held() -> DataFrame | None:
        try:
            old = spark.read.parquet(path).withColumn("cached_on", F.to_date("cached_on"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return old if max_age_days is None else old.where(F.col("cached_on") >= F.date_sub(F.current_date(), max_age_days))

    if max_age_days is not None:
        purge_cache(spark, path, max_age_days)
    old = held()
    fresh = keys if old is None else keys.join(old.select(key).distinct(), key, "left_anti")
    compute(fresh).withColumn("cached_on", F.current_date()).write.mode("append").partitionBy("cached_on").parquet(path)
    now = held()
    if now is None:
        return compute(fresh).withColumn("cached_on", F.current_date())  # nothing was asked for
    found = now.join(keys.select(key).distinct(), key, "left_semi")
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*rest), "cached_on").alias("_r")).select(key, "_r.*")


def purge_cache(spark: SparkSession, path: str, max_age_days: int) -> int:
    """Deletes the days of the cache that are too old; how many they were."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    oldest = spark.range(1).select(F.date_sub(F.current_date(), max_age_days).cast("string")).first()[0]
    days = [s.getPath() for s in fs.listStatus(root)]
    old = [p for p in days if p.getName().startswith("cached_on=") and p.getName().partition("=")[2] < oldest]
    for p in old:
        fs.delete(p, True)
    return len(old)
