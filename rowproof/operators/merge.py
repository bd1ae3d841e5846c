"""Merging and de-duplicating rows of overlapping batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.empties import is_row_void, strip


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(names) if names else None)


def signature(names: Sequence[str]) -> Column:
    """Sorted field:value pairs, values trimmed and lower-cased, empty ones left out."""
    part = lambda n: F.when(~is_row_void(F.col(n).cast("string")) & (strip(F.col(n).cast("string")) != ""), F.concat(F.lit(f"{n}:"), F.lower(strip(F.col(n).cast("string")))))
    return F.concat_ws("||", *(part(n) for n in sorted(names)))


def dedup_signature(df: DataFrame, names: Sequence[str], order: str = "_seq") -> DataFrame:
    """The first row of each signature; ties of order go by the whole row."""
    first = F.min_by(F.struct(*df.columns), F.struct(order, F.xxhash64(*df.columns)))
    return df.groupBy(signature(names).alias("_s")).agg(first.alias("r")).select("r.*")


def dominated(df: DataFrame, names: Sequence[str], tuple_id: str = "tuple_id", order: str = "_seq", within: Sequence[str] | None = None) -> DataFrame:
    """tuple_ids of rows that are identical to an earlier row, or a strict subset of any row.

    Equal rows are first reduced to one (a plain aggregate, so groups of copies cost nothing more); the others
    meet on their rarest filled cell, which any superset must hold too, and are then compared whole.
    """
    filled = F.filter(F.array(*(F.struct(F.lit(n).alias("f"), F.col(n).cast("string").alias("v")) for n in sorted(names))), lambda c: ~is_row_void(c["v"]))
    scope = F.struct(*(F.col(k).cast("string") for k in within)) if within else F.lit("").cast("string")
    rows = df.select(F.col(tuple_id), F.col(order).alias("_o"), scope.alias("_w"), filled.alias("_c"))
    first = rows.groupBy("_w", "_c").agg(F.min(F.struct("_o", tuple_id)).alias("_f"))
    kept = first.select(F.col(f"_f.{tuple_id}").alias(tuple_id), "_w", "_c")
    copies = rows.join(kept.select(tuple_id), tuple_id, "left_anti").select(tuple_id)
    one = kept.select(tuple_id, "_w", "_c", F.explode("_c").alias("cell"))
    counts = one.groupBy("_w", "cell").agg(F.count("*").alias("n"))
    rarest = one.join(counts, ["_w", "cell"]).groupBy(tuple_id, "_w", "_c").agg(F.min(F.struct("n", "cell")).alias("m")).select(tuple_id, "_w", "_c", F.col("m.cell").alias("cell"))
    big = one.select("_w", "cell", F.col("_c").alias("_d"))
    held = (F.size("_c") < F.size("_d")) & (F.size(F.array_intersect("_c", "_d")) == F.size("_c"))
    subsets = rarest.join(big, ["_w", "cell"]).where(held).select(tuple_id)
    return copies.union(subsets).distinct()  # a row without filled cells is identical to such rows only


def dedup_subset(df: DataFrame, names: Sequence[str], tuple_id: str = "tuple_id", order: str = "_seq") -> DataFrame:
    return df.join(dominated(df, names, tuple_id, order), tuple_id, "left_anti")


def multiset_intersection(a: DataFrame, b: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of names with n = the smaller of both counts."""
    x = a.groupBy(*names).agg(F.count("*").alias("_x"))
    y = b.groupBy(*names).agg(F.count("*").alias("_y"))
    return x.join(y, list(names)).select(*names, F.least("_x", "_y").alias("n"))


def warm_start(old: DataFrame, new: DataFrame, names: Sequence[str], tuple_id: str = "tuple_id", evidence: str | None = None) -> DataFrame:
    """Cells of new (where filled) overwrite old ones of the same tuple; evidence lists are united and tagged."""
    fresh = new.select(F.col(tuple_id), *(F.col(n).alias(f"_{n}") for n in names), *([F.col(evidence).alias("_ev")] if evidence else []))
    out = old.join(fresh, tuple_id, "left")
    filled = lambda n: ~is_row_void(F.col(f"_{n}").cast("string"))
    cols = {n: F.when(filled(n), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}
    if evidence:
        tagged = F.transform(F.coalesce("_ev", F.array().cast("array<string>")), lambda x: F.concat(F.lit("[Warm Start Fix] "), x))
        cols[evidence] = F.array_union(F.coalesce(evidence, F.array().cast("array<string>")), tagged)
    return out.withColumns(cols).drop(*(f"_{n}" for n in names), "_ev")


def overlay(base: DataFrame, top: DataFrame, tuple_id: str = "tuple_id") -> DataFrame:
    """Rows of top replace those of base with their tuple_id; others are added."""
    return base.join(top.select(tuple_id).distinct(), tuple_id, "left_anti").unionByName(top, allowMissingColumns=True)


def anchor_merge(old: DataFrame, new: DataFrame, anchor: str, affected: DataFrame, names: Sequence[str]) -> DataFrame:
    """Old rows of affected anchors go, the new ones come; equal rows stay once."""
    keys = affected.select(F.col(anchor).alias("_a")).distinct()
    return old.join(keys, F.col(anchor) == F.col("_a"), "left_anti").unionByName(new).dropDuplicates(list(names))


def number_batches(df: DataFrame, order: str, size: int = 20) -> DataFrame:
    """Adds batch: rows in order by twenties.  Offsets of range partitions come from one small aggregate."""
    from ..sources.numbering import with_row_number

    return with_row_number(df, order).withColumn("batch", F.ceil((F.col("_row") + 1) / size).cast("long")).drop("_row")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
