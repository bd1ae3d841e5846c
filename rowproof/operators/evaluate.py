"""Scoring extracted tables against gold: cells, rows, structure, multisets, reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.empties import is_eval_null, is_llm_null

#: Fixed value: at least this similar rows may be matched.
LEAST_SIMILARITY = 0.3
#: Tasks over which all pairs of a group are dealt.
PARTS = 64


def dashed_date(c: Column) -> Column:
    return F.regexp_replace(V.collapse_spaces(c), r"[-/\s]+", "-")


def is_truth(c: Column) -> Column:
    return F.lower(c).isin("true", "yes", "是", "1")


def compare(expected: Column, generated: Column) -> Column:
    """struct(match, match_type, similarity) of two cells' texts."""

    def result(match, kind, s) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(match).alias("match"), lit(kind).alias("match_type"), lit(s).cast("double").alias("similarity"))

    none = result(False, "none", 0.0)

    def numeric(p: Column) -> Column:
        e, g = p["e"], p["g"]
        near = F.when(e != 0, F.greatest(F.lit(0.0), 1 - F.abs(e - g) / F.abs(e))).otherwise(0.0)
        return F.when(e.isNull() | g.isNull(), none).when(e == g, result(True, "exact_numeric", 1.0)).otherwise(result(False, "none", near))

    def text(p: Column) -> Column:
        a, b, sim = p["a"], p["b"], p["sim"]
        limit = F.when(a.rlike(V.HAN) | b.rlike(V.HAN), 0.85).otherwise(0.9)
        words = F.when(F.lower(a) == F.lower(b), result(True, "case_insensitive", 1.0)).when(V.descriptive_match(a, b), result(True, "keyword_match", 0.85))
        return F.when(sim >= limit, result(True, "string_similar", sim)).otherwise(words.otherwise(result(False, "none", sim)))

    def by_type(t: Column) -> Column:
        is_a = lambda kind: (t["e"] == kind) | (t["g"] == kind)
        numbers = F.struct(V.normalise_number(expected)["value"].alias("e"), V.normalise_number(generated)["value"].alias("g"))
        strings = V.let(F.struct(V.collapse_spaces(expected).alias("a"), V.collapse_spaces(generated).alias("b")), lambda p: V.let(F.struct(p["a"].alias("a"), p["b"].alias("b"), V.string_similarity(p["a"], p["b"]).alias("sim")), text))
        return (
            F.when((t["e"] == "null") & (t["g"] == "null"), result(True, "exact", 1.0)).when(is_a("null"), none)
            .when(is_a("numeric"), V.let(numbers, numeric)).when(is_a("string"), strings)
            .when(is_a("date"), F.when(dashed_date(expected) == dashed_date(generated), result(True, "date_normalized", 1.0)).otherwise(none))
            .otherwise(F.when(is_truth(expected) == is_truth(generated), result(True, "boolean", 1.0)).otherwise(none))
        )

    return V.let(F.struct(V.value_type(expected).alias("e"), V.value_type(generated).alias("g")), by_type)


def row_similarity(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Mean over common fields of 1 for a match, else the similarity."""
    if not pairs:
        return F.lit(0.0)
    scores = F.array(*(V.let(compare(e, g), lambda c: F.when(c["match"], 1.0).otherwise(c["similarity"])) for e, g in pairs))
    return F.aggregate(scores, F.lit(0.0), lambda x, y: x + y) / len(pairs)


def score_matrix(gold: DataFrame, made: DataFrame, fields: Sequence[str], block: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """(grp, g, m, score) of all pairs of rows (columns _seq and fields) of a group.

    The greedy match is defined over all of them, and pairs that agree in no field may be similar enough: the
    work is the product of both tables' rows, dealt over PARTS tasks a group.  With block, only pairs that share
    a value of a block field, for tables whose rows are paired by a key.
    """
    grp = (F.col(group) if group else F.lit("")).alias("grp")
    key = lambda c: F.lower(V.collapse_spaces(c.cast("string")))
    own = lambda prefix: [grp, F.col("_seq").alias(prefix), *(F.col(f).cast("string").alias(f"{prefix}_{f}") for f in fields)]

    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        ks = F.array(*(F.when(~is_eval_null(F.col(b).cast("string")), F.struct(F.lit(i).alias("i"), key(F.col(b)).alias("k"))) for i, b in enumerate(block)))
        return df.select(*own(prefix), F.explode(F.filter(ks, lambda x: x.isNotNull())).alias("kk"))

    if block:
        pairs = keyed(gold, "g").join(keyed(made, "m"), ["grp", "kk"]).drop("kk").dropDuplicates(["grp", "g", "m"])
    else:
        parts = made.select(*own("m"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        pairs = gold.select(*own("g"), F.pmod(F.xxhash64("_seq"), F.lit(PARTS)).cast("int").alias("part")).join(parts, ["grp", "part"]).drop("part")
    return pairs.select("grp", "g", "m", F.round(row_similarity([(F.col(f"g_{f}"), F.col(f"m_{f}")) for f in fields]), 9).alias("score"))


def greedy_match(scores: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(grp, g, m, score): gold rows in order take their best unused made row; ties: the smallest.

    The walk is in order by definition, so a group (a case's table) is one task; only narrow rows of pairs
    over the threshold get there, sorted outside Python, which holds no more than the used rows of a group.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, used, done = None, set(), None  # done: the gold row that has its partner
        first = True
        for part in batches:
            out = []
            for row in part.itertuples(index=False, name=None):
                if first or row[0] != grp:
                    grp, used, done, first = row[0], set(), None, False
                if row[1] != done and row[2] not in used:
                    used.add(row[2])
                    done = row[1]
                    out.append(row)
            yield pd.DataFrame(out, columns=["grp", "g", "m", "score"])

    ordered = scores.where(F.col("score") >= least).select("grp", F.col("g").cast("long").alias("g"), F.col("m").cast("long").alias("m"), "score")
    ordered = ordered.repartition("grp").sortWithinPartitions("grp", "g", F.desc("score"), "m")
    return ordered.mapInPandas(walk, "grp string, g long, m long, score double")


def cell_counts(gold: DataFrame, made: DataFrame, matches: DataFrame, fields: Sequence[str], group: str | None = None) -> DataFrame:
    """grp, expected, generated, correct cells; unmatched rows count all their cells."""
    fields = [f for f in fields if not f.lower().endswith("companyid")]
    grp = (F.col(group) if group else F.lit("")).alias("grp")
    filled = lambda p: reduce(lambda a, b: a + b, (F.when(~is_eval_null(F.col(f).cast("string")), 1).otherwise(0) for f in fields))
    exp = gold.groupBy(grp).agg(F.sum(filled("")).alias("expected"))
    gen = made.groupBy(grp).agg(F.sum(filled("")).alias("generated"))
    g = gold.select(grp, F.col("_seq").alias("g"), *(F.col(f).cast("string").alias(f"g_{f}") for f in fields))
    m = made.select(grp, F.col("_seq").alias("m"), *(F.col(f).cast("string").alias(f"m_{f}") for f in fields))
    both = matches.select("grp", "g", "m").join(g, ["grp", "g"]).join(m, ["grp", "m"])
    both = both.repartition(both.sparkSession.sparkContext.defaultParallelism, "g")  # few bytes, much work
    good = both.groupBy("grp").agg(F.sum(reduce(lambda a, b: a + b, (compare(F.col(f"g_{f}"), F.col(f"m_{f}"))["match"].cast("int") for f in fields))).alias("correct"))
    return exp.join(gen, "grp", "full").join(good, "grp", "left").select("grp", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "generated", "correct")))


def prf(correct: Column, generated: Column, expected: Column) -> list[Column]:
    """precision, recall, f1 in percent, 0 where undefined."""
    p = F.coalesce(F.try_divide(correct, generated) * 100, F.lit(0.0))
    r = F.coalesce(F.try_divide(correct, expected) * 100, F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1")]


def table_scores(counts: DataFrame, by: str = "grp") -> DataFrame:
    """Per table and in total (null), by rollup."""
    sums = counts.rollup(by).agg(*(F.sum(c).alias(c) for c in ("correct", "generated", "expected")))
    return sums.select(by, "correct", "generated", "expected", *prf(F.col("correct"), F.col("generated"), F.col("expected")))


def match_tables(gold: DataFrame, made: DataFrame) -> DataFrame:
    """(gold, made) table names equal in any case, else up to plural s; columns: name."""
    norm = lambda c: F.rtrim(F.lower(c), F.lit("s"))
    g, m = gold.select(F.col("name").alias("gold")), made.select(F.col("name").alias("made"))
    both = g.join(m, norm(F.col("gold")) == norm(F.col("made")))
    return both.groupBy("gold").agg(F.min_by("made", F.struct((F.lower("gold") != F.lower("made")).cast("int"), "made")).alias("made"))


def structural(gold: DataFrame, made: DataFrame) -> DataFrame:
    """Scores of table names and of (table, field) pairs; columns tbl, field; case counts."""

    def one(level: str, names: list[str]) -> DataFrame:
        x, y = gold.select(*names).distinct(), made.select(*names).distinct()
        c = x.intersect(y)
        parts = [d.select(F.lit(k).alias("k")).groupBy("k").count() for k, d in (("expected", x), ("generated", y), ("correct", c))]
        pivot = reduce(DataFrame.union, parts).agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("count"))), F.lit(0)).alias(k) for k in ("expected", "generated", "correct")))
        return pivot.select(F.lit(level).alias("level"), "expected", "generated", "correct", *prf(F.col("correct"), F.col("generated"), F.col("expected")))

    return one("table", ["tbl"]).unionByName(one("field", ["tbl", "field"]))


def multiset_scores(gold: DataFrame, made: DataFrame) -> DataFrame:
    """Scores of normalised (tbl, attr, value) cells as multisets."""
    norm = lambda d: d.where(~is_llm_null(F.col("value"))).select("tbl", "attr", F.lower(V.collapse_spaces(F.col("value"))).alias("value"))
    x = norm(gold).groupBy("tbl", "attr", "value").agg(F.count("*").alias("e"), F.lit(0).cast("long").alias("g"))
    y = norm(made).groupBy("tbl", "attr", "value").agg(F.lit(0).cast("long").alias("e"), F.count("*").alias("g"))
    both = x.unionByName(y).groupBy("tbl", "attr", "value").agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    sums = both.rollup("tbl").agg(F.sum("e").alias("expected"), F.sum("g").alias("generated"), F.sum(F.least("e", "g")).alias("correct"))
    return sums.select("tbl", "expected", "generated", "correct", *prf(F.col("correct"), F.col("generated"), F.col("expected")))


def method_averages(scores: DataFrame, metrics: Sequence[str] = ("precision", "recall", "f1")) -> DataFrame:
    return scores.groupBy("method").agg(*(F.round(F.avg(m), 2).alias(m) for m in metrics), F.count("*").alias("n_cases"))


def best_methods(scores: DataFrame, metrics: Sequence[str] = ("precision", "recall", "f1")) -> DataFrame:
    """The best method by each metric (ties: the first by name), as rows metric, method, value."""
    top = scores.agg(*(F.min(F.struct((-F.col(m)).alias("v"), "method")).alias(m) for m in metrics))
    return top.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.method").alias("method"), (-F.col(f"{m}.v")).alias("value")) for m in metrics))).alias("b")).select("b.*")


def quality_level(f1: Column) -> Column:
    return F.when(f1 >= 90, "excellent").when(f1 >= 75, "good").when(f1 >= 60, "acceptable").otherwise("poor")


def report(scores: DataFrame) -> DataFrame:
    """One JSON line a case with its level, and one of averages (case null)."""
    cases = scores.select("case", F.to_json(F.struct("precision", "recall", "f1", quality_level(F.col("f1")).alias("level"))).alias("json"))
    mean = scores.agg(*(F.round(F.avg(m), 2).alias(m) for m in ("precision", "recall", "f1")))
    return cases.unionByName(mean.select(F.lit(None).cast("string").alias("case"), F.to_json(F.struct("precision", "recall", "f1", quality_level(F.col("f1")).alias("level"))).alias("json")))


def best_snapshot(log: DataFrame) -> DataFrame:
    """Per table: the last final stage, else the stage with most rows; partial batches are left out.

    log: tbl, stage, description, rows_count, created_at.
    """
    some = log.where(~F.contains(F.coalesce("description", F.lit("")), F.lit("Batch验证")))
    rank = F.create_map(*(F.lit(x) for kv in (("verification", -1), ("fixing", -2), ("extraction", -3)) for x in kv))
    final = F.col("stage") == "final"
    order = F.struct(final.cast("int").alias("a"), F.when(final, 0).otherwise(F.col("rows_count")).alias("b"), F.when(final, 0).otherwise(F.coalesce(F.try_element_at(rank, F.col("stage")), F.lit(-9))).alias("c"), F.col("created_at").alias("d"))
    return some.groupBy("tbl").agg(F.max_by(F.struct("stage", "rows_count", "created_at"), order).alias("s")).select("tbl", "s.*")


def kind_scores(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Scores of entity tables and of relation tables; counts by grp, kinds: grp, kind."""
    sums = counts.join(kinds, "grp").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("correct", "generated", "expected")))
    return sums.select("kind", "correct", "generated", "expected", *prf(F.col("correct"), F.col("generated"), F.col("expected")))


def merge_outputs(frames: list[DataFrame]) -> DataFrame:
    """Outputs of several documents as one table, equal rows once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).distinct()


def first_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """A report's sample: the first n rows."""
    return df.orderBy(order).limit(n)
