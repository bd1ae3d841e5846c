"""Global row numbers and running totals without a single-task window, and spreading of inputs with few partitions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table


def _in_order(df: DataFrame, order: str) -> DataFrame:
    """df with _p, the number of its range partition, and _h, which breaks ties, as a written table.

    Ranges come from a sample of (order, hash of the row), so equal values are split as well; nulls come first.
    """
    rows = df.withColumn("_h", F.xxhash64(*df.columns))
    return shared_table(rows.repartitionByRange(F.col(order).asc_nulls_first(), "_h").withColumn("_p", F.spark_partition_id()), "in-order")


def _window(order: str):
    return Window.partitionBy("_p").orderBy(F.col(order).asc_nulls_first(), "_h")


def _with_offsets(rows: DataFrame, value: Column) -> DataFrame:
    """Adds _off: the sum of value over earlier partitions; one row a partition goes through the window."""
    sums = rows.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(sums.select("_p", F.coalesce(before, F.lit(0)).alias("_off"))), "_p")


def with_row_number(df: DataFrame, order: str, name: str = "_row") -> DataFrame:
    """Numbers rows from 0 in the order of a column of any type (ties: by the whole row)."""
    rows = _with_offsets(_in_order(df, order), F.lit(1))
    return rows.withColumn(name, F.row_number().over(_window(order)) - 1 + F.col("_off")).drop("_p", "_h", "_off")


def with_running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over all earlier rows in the order of a column."""
    rows = _with_offsets(_in_order(df, order), F.coalesce(F.col(value), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(_window(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, inside + F.col("_off")).drop("_p", "_h", "_off")


def with_previous(df: DataFrame, order: str, name: str = "_previous") -> DataFrame:
    """Adds the value of the row before in the order of a column (not null): each range partition is told the last value of those before."""
    rows = _in_order(df, order)
    last = rows.groupBy("_p").agg(F.max(order).alias("_last"))
    before = F.max("_last").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    rows = rows.join(F.broadcast(last.select("_p", before.alias("_before"))), "_p")
    return rows.withColumn(name, F.coalesce(F.lag(order).over(_window(order)), F.col("_before"))).drop("_p", "_h", "_before")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out where the source has far fewer partitions than the cluster has cores (one small file).

    Row-local checks are bound by CPU.  Inputs of many files or row groups have partitions enough and are not
    shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
