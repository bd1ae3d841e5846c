"""Helpers shared by the corpus operators: shared-folder tables, checked broadcasts, folds."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: A side is broadcast only if a count has shown that it has at most so many (narrow) rows.
BROADCAST_ROWS = 500_000

#: One run of ASCII white space, as a Java and as an RE2 pattern.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


#: Rows of a narrow table that share a file.
ROWS_PER_FILE = 250_000

_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("rowproof_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; in local mode a temporary one where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rowproof-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rowproof"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which is removed at the end: by then their readers must have run.

    The folder belongs to the calling thread's context, so pipelines in several threads keep to their own.
    """
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(before)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, executors may be lost.

    rows: about how many rows a narrow table has, if known.  It then takes few files: two a core, or as many as
    keep ROWS_PER_FILE rows each.  The rows are dealt to them by a shuffle, so the stage that makes them, which may
    join whole texts, keeps the tasks that it has.
    """
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.repartition(max(2 * spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast after counting df (which should be a written table), else leaves it to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, mod parts; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """(label, text, id) of whole labelled rows outside the held-out fold: at most per_class rows of each class.

    Rows come in the order of the md5 of their id, so the sample does not hang on row order, and while the
    whole texts of a class fit into chars characters: a row that no longer fits is left out, never cut.  Rows
    without label are left out; a document labelled twice has its largest label, and of an id on several texts
    the one with the smallest hash counts.
    """
    seen = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)").where(fold("_id", parts) != held_out).groupBy("_id").agg(F.max("_y").alias("_y"))
    order = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary"))
    picked = [seen.where(F.col("_y") == y).select("_id", "_y", order.alias("_o")).orderBy("_o").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 x per_class narrow rows
    text = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    sized = text.join(chosen, "_id").groupBy("_id", "_y", "_o").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.length("_t").alias("n"))).alias("x"))
    fits, room = [], [chars, chars]
    for r in sorted(sized.select("_o", "_id", "_y", "x.h", "x.n").collect()):  # the same rows, narrow
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            fits.append((r["_id"], r["_y"], r["h"]))
    if not fits:
        return []
    fits_df = docs.sparkSession.createDataFrame(fits, StructType([StructField("_id", docs.schema[id_col].dataType), StructField("_y", IntegerType()), StructField("_h", LongType())]))
    rows = text.join(F.broadcast(fits_df), "_id").where(F.xxhash64("_t") == F.col("_h")).dropDuplicates(["_id"])
    return sorted((r["_y"], r["_t"], r["_id"]) for r in rows.toLocalIterator())  # bounded by chars


def map_texts(df: DataFrame, text_col: str, keep: tuple[str, ...], run: Callable[[list], dict[str, list]], added: str) -> DataFrame:
    """Adds columns computed by Python from one column, in Arrow batches; keep columns pass unchanged.

    run: a list of values (None for null) -> {column: list}.  Other columns of df never reach Python.
    """
    names = [f"k{i}" for i in range(len(keep))]
    own = keep.index(text_col) if text_col in keep else len(names)
    slim = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), *([F.col(text_col).alias("_text")] if own == len(names) else []))
    new = StructType.fromDDL(added)
    schema = StructType([*slim.schema.fields[: len(names)], *new.fields])
    arrow = to_arrow_schema(new)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 256  # texts at once in Python: bounds memory where a batch holds long texts
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                got = run(part.column(own).to_pylist())
                columns = [part.column(i) for i in range(len(names))] + [pa.array(got[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *arrow.names])

    out = slim.mapInArrow(each, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *(F.col(f.name) for f in new))
