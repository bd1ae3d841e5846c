"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

One scan takes the length and the prefix hash of every text.  Rows whose length is unique are out; of the
others those whose (length, prefix hash) is unique; only the rest meet by full hash, and only their texts
are hashed in full, in a second scan.  Narrow rows are shuffled, and groups are counted with partial
aggregates whose result goes back to the rows by a join that adaptive execution may split; no group is
gathered.  Texts move only where more keys survive than a checked broadcast may hold: then one semi join
brings the surviving texts, and no others, to their hash.

Edge cases: null counts as the empty text, so all null and empty texts are copies of each other; of equal
rows with the same id exactly one stays; a null id stays only if the whole group has null ids; an empty
table gives an empty result; columns other than id and text are never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_ROWS, broadcast_if_small, text_or_empty, written

#: Characters of the prefix whose hash refines a length group.
PREFIX = 64


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), ASCII_SPACE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha, len, ph.

    sha is the full hash of rows that reached the last step; with digest=True, which asks for the hash of all
    rows, the first scan takes it along and the second falls away.
    """
    rows = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    head, full = F.xxhash64(F.substring("t", 1, prefix)), F.unhex(F.sha2("t", 256))
    rows = rows.select("id", "t", F.length("t").alias("len"), head.alias("ph"))
    narrow = rows.select("id", "len", "ph", *([full.alias("sha")] if digest else []), F.monotonically_increasing_id().alias("tag"))
    narrow = written(narrow, "dedup-rows")
    lengths = written(narrow.groupBy("len").count().where("count > 1").select("len"), "dedup-lengths")
    heads = narrow.join(broadcast_if_small(lengths), "len", "left_semi").groupBy("len", "ph").count().where("count > 1")
    heads = broadcast_if_small(written(heads.select("len", "ph"), "dedup-heads"))
    if digest:
        again = narrow.join(heads, ["len", "ph"], "left_semi").select("id", "len", "ph", "sha", "tag")
    else:
        again = rows.join(heads, ["len", "ph"], "left_semi").select("id", "len", "ph", full.alias("sha"), F.monotonically_increasing_id().alias("tag"))
        again = written(again, "dedup-again")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag"))
    groups = written(again.groupBy("sha").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1"), "dedup-groups")
    if digest:  # all rows have their hash
        out = narrow.join(broadcast_if_small(groups), "sha", "left")
    else:
        out = again.join(broadcast_if_small(groups), "sha", "left").select("id", "len", "ph", "sha", "tag", "first", "n")
        alone = narrow.join(heads, ["len", "ph"], "left_anti")
        out = out.unionByName(alone.select("id", "len", "ph", "tag"), allowMissingColumns=True)
    single = F.col("n").isNull()
    return out.select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("tag") == F.col("first.tag"))).alias("kept"),
        "sha",
        "len",
        "ph",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of df, all columns, without later copies: of equal texts the row with the smallest id stays.

    Rows meet the list of lost ones by id, length and prefix hash; the full hash is the join's condition and no key
    of it, so it is taken only of rows that meet a lost one there.  An id on many texts is no hot key.  The text
    moves once, at every size alike (the list grows with the data, so it is never broadcast), and a hot text is
    spread by id.  Null texts are empty ones, null ids meet null ids, whole repeated rows leave one; an empty table
    stays empty.
    """
    marks = exact_dedup(df, id_col, text_col, prefix)
    keys = ("id", "len", "ph", "sha")
    lost = written(marks.where("not kept").select(*(F.col(k).alias(f"_lost_{k}") for k in keys)).distinct(), "dedup-lost")
    won = marks.where("kept and group_size > 1").select(F.col("id").alias("_won_id"), F.col("sha").alias("_won_sha"))
    twice = written(lost.join(won, lost["_lost_id"].eqNullSafe(won["_won_id"]) & (lost["_lost_sha"] == won["_won_sha"]), "left_semi"), "dedup-twice")
    text = normalised(df[text_col])
    sha = F.unhex(F.sha2(text, 256))

    def meets(other: DataFrame) -> Column:
        same = df[id_col].eqNullSafe(other["_lost_id"]) & (F.length(text) == other["_lost_len"]) & (F.xxhash64(F.substring(text, 1, prefix)) == other["_lost_ph"])
        return same & sha.between(other["_lost_sha"], other["_lost_sha"])  # an equality would become a key, taken of every row

    kept = df.join(lost.hint("merge"), meets(lost), "left_anti")
    if twice.head(1):  # whole repeated rows: one of each comes back
        again = df.join(broadcast_if_small(twice), meets(twice), "left_semi")
        kept = kept.unionByName(again.withColumn("_lost_sha", sha).dropDuplicates([id_col, "_lost_sha"]).drop("_lost_sha"))
    return kept
