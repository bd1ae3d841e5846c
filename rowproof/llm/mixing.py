"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are token shares raised to an exponent in [0, 1] and normalised.  The exponent is bisected: the
largest one whose weights reach a target entropy (a share of the entropy of equal weights), raised where
needed until no source is repeated more than a limit.  A source's budget is its weight times the token
budget.  Its documents are dealt by hash into blocks; each epoch is a permutation of the blocks, with the
documents permuted inside each.  Whole epochs come first; the last one stops where the budget is spent:
whole blocks in order, then the documents of one block while they fit.

Only narrow rows (id, source, tokens) are shuffled.  A source with a third of all rows is spread over its
blocks of about BLOCK_TOKENS tokens; blocks are put in order in groups of about GROUP of them, and a running
sum over the groups' totals, one row a group, gives each group its place.  Per-source totals are partial
aggregates.

Edge cases: a null source is the source ''; texts without words hold 0 tokens and ride along in whole
blocks; a source of nothing but such texts has no weight and is used once, as a whole; blocks hold at most
about BLOCK_TOKENS documents too; with one source, or no tokens, weights are the shares; ties and null ids go in the order of hash,
then id; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
ENTROPY, REPEATS, BLOCK_TOKENS, GROUP, SEED = 0.98, 4.0, 1 << 15, 4096, "mix"


def _hash(*parts: Column) -> Column:
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.md5(text.cast("binary"))


def _border(totals: DataFrame, holds, columns) -> float:
    """The largest exponent in [0, 1] at which holds(values) is true, if it is true below some border.

    Bisection in 16 sections at a time: columns(exponent) are aggregates over the table of sources, so a pass
    is one job whose one row comes back, however many sources there are.
    """
    lo, hi = 0.0, 1.0
    while hi - lo > 1e-6:
        grid = [lo + (hi - lo) * k / 16 for k in range(17)]
        row = totals.agg(*(c.alias(f"{name}{k}") for k, a in enumerate(grid) for name, c in columns(a).items())).first()
        true = [holds({name: row[f"{name}{k}"] for name in columns(0.0)}) for k in range(17)]
        if all(true):
            return hi
        k = true.index(False)
        if k == 0:
            return lo
        lo, hi = grid[k - 1], grid[k]
    return lo


def mixing_exponent(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> float:
    """totals: source, tokens (> 0).  Rounded to four digits, so that it does not hang on the order of sums."""
    n, tokens = totals.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(tokens))
    budget = tokens if budget is None else budget

    def sums(a: float) -> dict[str, Column]:
        w = F.pow(share, F.lit(a))
        return {"z": F.sum(w), "e": F.sum(w * F.lit(a) * F.log(share)), "r": F.max(w / share)}

    # entropy falls as the exponent grows; repetition falls as it grows
    reached = _border(totals, lambda v: math.log(v["z"]) - v["e"] / v["z"] >= entropy * math.log(n), sums)
    repeated = _border(totals, lambda v: budget * v["r"] / v["z"] > repeats * tokens, sums)
    return round(max(reached, repeated), 4)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """One row per use of a document: id, source, tokens, epoch, block (place in the epoch), position (in the block).

    budget: tokens; by default as many as there are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("tokens"))
    rows = written(rows, "mix-rows")
    totals = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "mix-totals")
    some = totals.where("tokens > 0")
    budget = (some.agg(F.sum("tokens")).first()[0] or 0) if budget is None else budget
    a = mixing_exponent(some, entropy, repeats, budget)
    z = some.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()[0] or 1.0
    goal = F.floor(F.round(F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z) * F.lit(float(budget)), 3)).cast("long")
    plan = totals.select("source", F.col("tokens").alias("total"), "n", F.when(F.col("tokens") > 0, goal).otherwise(F.lit(0)).cast("long").alias("goal"))
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.try_divide("goal", "total")), F.lit(1)).cast("long")).withColumn("rest", F.col("goal") - F.col("whole") * F.col("total"))
    plan = plan.withColumn("blocks", F.ceil(F.greatest("total", "n") / BLOCK_TOKENS).cast("long"))
    plan = written(plan, "mix-plan")  # one narrow row a source

    number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    part = number(_hash(F.lit(seed), F.col("id")))
    dealt = rows.join(plan, "source").withColumn("part", part % F.col("blocks"))
    blocks = dealt.groupBy("source", "part").agg(F.sum("tokens").alias("size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    uses = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))  # at most repeats + 1 a block
    uses = uses.withColumn("order", _hash(F.lit(seed), F.col("source"), F.col("part"), F.col("epoch")))
    # groups are ranges of the order: of about GROUP blocks each
    uses = uses.withColumn("group", F.floor(number(F.col("order")) * F.ceil(F.col("blocks") / GROUP) / F.lit(1 << 32)).cast("long"))
    uses = written(uses, "mix-order")
    groups = uses.groupBy("source", "epoch", "group").agg(F.sum("size").alias("group_size"), F.count("*").alias("group_n"))
    earlier = Window.partitionBy("source", "epoch").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "epoch", "group", F.coalesce(F.sum("group_size").over(earlier), F.lit(0)).alias("size_before"), F.coalesce(F.sum("group_n").over(earlier), F.lit(0)).alias("n_before"))
    in_group = Window.partitionBy("source", "epoch", "group").orderBy("order", "part")
    uses = uses.join(groups, ["source", "epoch", "group"]).withColumn("block", (F.col("n_before") + F.row_number().over(in_group)).cast("long"))
    before = F.col("size_before") + F.coalesce(F.sum("size").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    uses = uses.withColumn("room", F.when(F.col("epoch") < F.col("whole"), F.col("size")).otherwise(F.col("rest") - before)).where("room > 0 or epoch < whole")
    uses = written(uses.select("source", "part", "epoch", "block", "size", "room"), "mix-uses")
    placed = rows.join(plan.select("source", "blocks"), "source").withColumn("part", part % F.col("blocks")).join(uses, ["source", "part"])
    inside = Window.partitionBy("source", "part", "epoch").orderBy(_hash(F.lit(seed), F.col("id"), F.col("epoch")), "id", "tokens")
    placed = placed.withColumn("position", F.row_number().over(inside).cast("long")).withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("room") >= F.col("size")) | (F.col("upto") <= F.col("room"))).select("id", "source", "tokens", "epoch", "block", "position")
