"""Joins of similar texts by rare grams: candidates by equi-joins that are complete for the test that follows.

A text's grams are ordered by how many texts hold them, so that a gram that a third of all texts share is
hardly ever a join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(c: Column, n: Column | int) -> Column:
    """Distinct substrings of length n."""
    n = F.lit(n) if isinstance(n, int) else n
    cut = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))
    return F.when(F.length(c) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _rarest(values: DataFrame, keyed: DataFrame, n: Column) -> DataFrame:
    """values with g, their gram that the fewest rows of keyed (value, g) hold; those with a gram that none holds are out."""
    held = keyed.groupBy("g").agg(F.count("*").alias("often"))
    own = values.withColumn("need", F.size(grams(F.col("value"), n))).select("value", "need", F.explode(grams(F.col("value"), n)).alias("g"))
    best = own.join(held, "g").groupBy("value", "need").agg(F.min(F.struct("often", "g")).alias("best"), F.count("*").alias("found"))
    return best.where("found = need").select("value", F.col("best.g").alias("g"))


def containing(longer: DataFrame, shorter: DataFrame, size: int = 3) -> DataFrame:
    """(longer, shorter) with the one holding the other, equal ones too; columns: value, not empty.

    Every gram of a held text is in the text that holds it, so the rarest one is key enough; texts shorter than
    a gram are grams themselves.
    """
    x, y = longer.select("value").distinct(), shorter.select("value").distinct()
    n = F.least(F.lit(size), F.length("value"))
    keyed = x.select("value", F.explode(F.concat(*(grams(F.col("value"), k) for k in range(1, size + 1)))).alias("g"))
    best = _rarest(y, keyed, n)
    near = keyed.select(F.col("value").alias("longer"), "g").join(best.select(F.col("value").alias("shorter"), "g"), "g")
    return near.where(F.contains("longer", F.col("shorter"))).select("longer", "shorter").distinct()


def few_edits(values: DataFrame, others: DataFrame, share: float = 0.1, least: int = 5) -> DataFrame:
    """(a, b), different, with a Levenshtein distance under share of the longer one's length; both of least letters.

    d edits spoil at most 2 d of a text's 2-grams, so of the 2 d + 1 rarest, in one order for all, one is shared.
    """
    both = values.select("value").union(others.select("value")).where(F.length("value") >= least).distinct()
    numbered = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    # repeats of a gram in a text are grams of their own, so that the bound holds for multisets
    own = both.select("value", F.explode(numbered).alias("g")).groupBy("value", "g").agg(F.count("*").alias("k"))
    own = own.select("value", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), lambda i: F.concat("g", i.cast("string")))).alias("g"))
    often = own.groupBy("g").agg(F.count("*").alias("often"))
    ranked = own.join(often, "g").groupBy("value").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("gs"))  # one text's grams
    edits = F.floor(F.length("value") / (1 - share) * share)
    keys = ranked.select("value", F.explode(F.slice("gs", F.lit(1), (2 * edits + 1).cast("int"))).alias("x")).select("value", F.col("x.g").alias("g"))
    a, b = keys.select(F.col("value").alias("a"), "g"), keys.select(F.col("value").alias("b"), "g")
    near = a.join(b, "g").where("a <> b").select("a", "b").distinct()
    near = near.where(F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) < share)
    return near.join(values.select(F.col("value").alias("a")).distinct(), "a", "left_semi").join(others.select(F.col("value").alias("b")).distinct(), "b", "left_semi")
