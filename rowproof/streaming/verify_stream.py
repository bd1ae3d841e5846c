"""Verification on streams (an extension): row-local checks as they are, references against static tables,
duplicates within a watermark, counts per window, batches merged by foreachBatch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checks import row_checks
from ..operators.setchecks import foreign_key
from ..operators.verify import apply_checks, with_ids
from ..plans.schema import Schema


def verify_rows(stream: DataFrame, schema: Schema, table: str, as_of: dt.date, families: list[str] | None = None) -> DataFrame:
    """All stateless checks; works on batches just the same."""
    return with_ids(apply_checks(stream, table, row_checks(schema, table, as_of, families)))


def verify_reference(stream: DataFrame, table: str, attr: str, ref: DataFrame, ref_attr: str) -> DataFrame:
    """Foreign keys against a static table.  A stream-static anti join is a left join without match."""
    keys = ref.select(F.col(ref_attr).cast("string").alias("_ref")).where("_ref is not null").distinct()
    if not stream.isStreaming:
        return foreign_key(stream, table, attr, ref, ref_attr)
    lost = stream.join(keys, F.trim(F.col(attr).cast("string")) == F.col("_ref"), "left_anti")
    return lost.select(F.lit(table).alias("tbl"), F.col("tuple_id").cast("string").alias("tuple_id"), F.lit(attr).alias("attr"), F.lit("REFERENCE").alias("constraint_type"), F.col(attr).cast("string").alias("value"))


def distinct_rows(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(violations: DataFrame, time: str, every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Violations per tumbling window and type."""
    v = violations.withWatermark(time, delay) if violations.isStreaming else violations
    return v.groupBy(F.window(time, every).alias("w"), "constraint_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "constraint_type", "n")


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch is verified and merged by merge(batch, number)."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_stage(stream: DataFrame, key: list[str], time: str, keep: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Append-only stage log, newest wins.

    keep, as "7 days": on a stream the newest row of a key (ties: the greater row) comes out whenever it changes,
    for update output, and a key is forgotten once the watermark is more than keep after it, so that the state
    holds only what is recent.  A row that comes later than delay counts only while its key is still known.
    Without keep all keys are held: for complete output of logs with few keys.
    """
    rest = [c for c in stream.columns if c not in key]
    if not stream.isStreaming or keep is None:
        return stream.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(time)).alias("r")).select(*key, "r.*")
    at, columns = stream.columns.index(time), list(stream.columns)
    held_for = int(pd.Timedelta(keep).total_seconds() * 1000)

    def newest(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        best = old
        for part in parts:
            for row in part[columns].astype(object).where(part[columns].notna(), None).itertuples(index=False, name=None):
                row = tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row)
                if row[at] is not None and (best is None or (row[at], str(row)) > (best[at], str(best))):
                    best = row
        if best is None:
            return
        state.update(best)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(best[at]).timestamp() * 1000) + held_for, state.getCurrentWatermarkMs() + 1))
        if best != old:
            yield pd.DataFrame([best], columns=columns)

    timed = stream.withWatermark(time, delay)
    return timed.groupBy(*key).applyInPandasWithState(newest, stream.schema, stream.schema, "update", GroupStateTimeout.EventTimeTimeout)


def merge_when_complete(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("run_id", "tbl"), batch: str = "batch", batches: str = "n_batches"):
    """A stream writer that merges a table's batches once, when all of them have arrived, whatever their order.

    Rows carry their batch and how many there are.  A micro-batch goes to target/staged/epoch=<number>, and the
    tables that it completes to target/merged/epoch=<number>: both are overwritten if the micro-batch is
    replayed.  Of a batch that is delivered twice the first delivery counts; what comes after the merge is
    staged and not merged again.  Equal rows of different batches are one.
    """

    def take(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{target}/staged/epoch={epoch}")
        staged = spark.read.schema(f"{_ddl(rows)}, epoch BIGINT").parquet(f"{target}/staged").where(F.col("epoch") <= epoch)
        first = staged.groupBy(*keys, batch).agg(F.min("epoch").alias("epoch"))
        ready = staged.groupBy(*keys).agg(F.count_distinct(batch).alias("_n"), F.max(batches).alias("_of")).where("_n >= _of").select(*keys)
        ready = ready.join(_merged(spark, rows, target).where(F.col("epoch") < epoch).select(*keys).distinct(), list(keys), "left_anti")
        whole = staged.join(first, [*keys, batch, "epoch"], "left_semi").join(ready, list(keys), "left_semi")
        whole.drop(batch, batches, "epoch").distinct().write.mode("overwrite").parquet(f"{target}/merged/epoch={epoch}")

    def _merged(spark: SparkSession, rows: DataFrame, target: str) -> DataFrame:
        schema = f"{_ddl(rows.drop(batch, batches))}, epoch BIGINT"
        try:
            return spark.read.schema(schema).parquet(f"{target}/merged")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
