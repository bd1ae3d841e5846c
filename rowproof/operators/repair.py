"""Deterministic repairs: fixes as rows, applied to wide tables by one aggregate and one join."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.empties import is_blank
from ..functions.ids import fix_id
from .merge import dominated
from .verify import categorise, dedup, for_tools

DELETED = "__DELETED__"
FIX_COLUMNS = ("id", "tbl", "tuple_id", "attr", "old", "new", "fix_type", "applied_by", "fix_success", "failure_reason", "needs_manual_review", "ord")
FIX_TYPES = {"TYPE": "type_conversion", "VALUE": "domain_mapping", "STRUCTURE": "default_value", "FORMAT": "format_normalisation", "TEMPORAL": "temporal_correction", "REFERENCE": "nearest_reference", "AGGREGATION": "recalculation", "LOGIC": "standard_format"}


def cells(df: DataFrame, names: Sequence[str], tuple_id: str = "tuple_id") -> DataFrame:
    """Long form: tuple_id, attr, value."""
    pairs = F.array(*(F.struct(F.lit(n).alias("attr"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select(F.col(tuple_id).cast("string").alias("tuple_id"), F.explode(pairs).alias("c")).select("tuple_id", "c.attr", "c.value")


def suggest(v: DataFrame, rows: DataFrame, names: Sequence[str], normalisers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A fix for every violation whose suggestion may be applied to its cell.

    Formats, logic and aggregations of an attribute with a normaliser take the cell's normal form first.

    Defaults fill only empty cells; missing values are not mapped to a domain; sequence gaps are left alone;
    other fixes need a changed, valid value.
    """
    kind = F.col("constraint_type")
    at = v.join(cells(rows, names), ["tuple_id", "attr"])
    normal = [F.when(kind.isin("FORMAT", "LOGIC", "AGGREGATION") & (F.col("attr") == a), f(F.col("value"))) for a, f in (normalisers or {}).items()]
    at = at.withColumn("suggested_fix", F.coalesce(*normal, "suggested_fix")).where("suggested_fix is not null")
    new = F.col("suggested_fix")
    may = (
        F.when(F.col("rule_code") == "TEMPORAL_GAP", False)
        .when(kind == "STRUCTURE", is_blank(F.col("value")))
        .when(kind == "VALUE", ~F.col("rule_code").isin("VALUE_MISSING", "VALUE_MISSING_INFERRED") & V.valid_fix(new))
        .otherwise(F.coalesce(F.col("value") != "", F.lit(False)) & V.valid_fix(new) & (F.col("value") != new))
    )
    names_of = F.create_map(*(F.lit(x) for kv in FIX_TYPES.items() for x in kv))
    out = at.where(may).withColumn("fix_type", names_of[kind])
    order = F.array_position(F.array(*(F.lit(k) for k in FIX_TYPES)), kind).cast("long")
    return out.select(
        fix_id(F.col("tbl"), F.col("tuple_id"), F.col("attr"), F.col("fix_type"), F.col("value")).alias("id"), "tbl", "tuple_id", "attr", F.col("value").alias("old"), new.alias("new"), "fix_type",
        F.concat(F.initcap(kind), F.lit("Fixer.v1")).alias("applied_by"), F.lit(True).alias("fix_success"), F.lit(None).cast("string").alias("failure_reason"), F.lit(False).alias("needs_manual_review"), order.alias("ord"),
    )


def rule_fixes(v: DataFrame) -> DataFrame:
    """What graph and ratio rules ask for: manual review, checking the source, or a row to insert."""
    action = F.when(F.col("business_rule_id") == "phi_1", "manual_review").when(F.col("business_rule_id") == "phi_2", "verify_source").when(F.col("business_rule_id") == "phi_3", "insert_row")
    out = v.withColumn("fix_action", action).where("fix_action is not null")
    return out.select("tbl", "tuple_id", "attr", "business_rule_id", "fix_action", F.col("suggested_fix").alias("detail"), (F.col("fix_action") != "insert_row").alias("needs_manual_review"))


def apply_fixes(rows: DataFrame, fixes: DataFrame, names: Sequence[str], purge: bool = True) -> DataFrame:
    """The last fix of a cell wins; rows with a deleted cell go (unless purge is False)."""
    last = fixes.groupBy("tuple_id", "attr").agg(F.max_by("new", F.struct("ord", "new")).alias("new"))
    wide = last.groupBy("tuple_id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "new"))).alias("_fix"))  # at most one entry a column
    out = rows.join(wide.withColumnRenamed("tuple_id", "_t"), F.col("tuple_id").cast("string") == F.col("_t"), "left").drop("_t")
    out = out.withColumns({n: F.coalesce(F.try_element_at("_fix", F.lit(n)), F.col(n).cast("string")) for n in names}).drop("_fix")
    return purge_deleted(out, names) if purge else out


def purge_deleted(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.where(~F.exists(F.array(*(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)), lambda x: x == DELETED))


def fill_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return rows.withColumns({n: F.when(is_blank(F.col(n)), d).otherwise(F.col(n)) for n, d in defaults.items()})


def fill_nearest(rows: DataFrame, attr: str, nearest: DataFrame) -> DataFrame:
    """nearest: value, nearest (one row a value)."""
    return rows.join(nearest.select(F.col("value").alias("_v"), F.col("nearest").alias("_n")), F.col(attr).cast("string") == F.col("_v"), "left").withColumn(attr, F.coalesce("_n", F.col(attr).cast("string"))).drop("_v", "_n")


def normalise_column(rows: DataFrame, attr: str, normaliser: Callable[[Column], Column]) -> DataFrame:
    """Every row of the attribute gets its normal form where it has one."""
    return rows.withColumn(attr, F.coalesce(normaliser(F.col(attr)), F.col(attr)))


def merge_by_key(rows: DataFrame, key: Sequence[str], names: Sequence[str], order: str = "_seq") -> DataFrame:
    """One row a key: each attribute's first non-blank value in order."""
    value = lambda n: F.min_by(F.col(n), F.when(~is_blank(F.col(n).cast("string")), F.col(order)))
    return rows.groupBy(*key).agg(*(value(n).alias(n) for n in names if n not in key))


def safe_delete(rows: DataFrame, key: Sequence[str], names: Sequence[str], tuple_id: str = "tuple_id", order: str = "_seq") -> DataFrame:
    """Drops rows that are identical to, or a strict subset of, another row with the same key; one always stays."""
    lost = dominated(rows, names, tuple_id, order, within=key)
    return rows.join(lost, tuple_id, "left_anti")


def delete_fixes(v: DataFrame, rows: DataFrame, key: Sequence[str], names: Sequence[str], tuple_id: str = "tuple_id", order: str = "_seq") -> DataFrame:
    """Deletions as fixes: rows that repeat a key and are identical to, or a strict subset of, another row of it."""
    hit = v.where("rule_code = 'STRUCTURE_KEY_DUPLICATE'").select(F.col("tbl"), F.col("tuple_id").alias("_t")).distinct()
    lost = dominated(rows, names, tuple_id, order, within=key).select(F.col(tuple_id).cast("string").alias("_t"))
    # of a key's rows the first one is not reported itself, though it may be the poorer one
    same = [F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(key)]
    keyed = rows.select(F.col(tuple_id).cast("string").alias("_t"), F.col(key[0]).cast("string").alias("old"), *same)
    keys = keyed.join(hit, "_t").select("tbl", *(f"_k{i}" for i in range(len(key)))).distinct()
    out = keyed.join(lost, "_t", "left_semi").join(keys, [f"_k{i}" for i in range(len(key))])
    return out.select(
        fix_id(F.col("tbl"), F.col("_t"), F.lit(key[0]), F.lit("safe_delete"), F.col("old")).alias("id"), "tbl", F.col("_t").alias("tuple_id"), F.lit(key[0]).alias("attr"), "old", F.lit(DELETED).alias("new"),
        F.lit("safe_delete").alias("fix_type"), F.lit("StructureFixer.v1").alias("applied_by"), F.lit(True).alias("fix_success"), F.lit(None).cast("string").alias("failure_reason"), F.lit(False).alias("needs_manual_review"), F.lit(99).cast("long").alias("ord"),
    )


def keep_dominant(rows: DataFrame, key: Sequence[str], names: Sequence[str], order: str = "_seq") -> DataFrame:
    """Of the rows of a key the one with most filled cells stays; ties: the first."""
    full = sum((F.when(~is_blank(F.col(n).cast("string")), 1).otherwise(0) for n in names), F.lit(0))
    w = Window.partitionBy(*key).orderBy(F.desc("_full"), order)
    return rows.withColumn("_full", full).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_full", "_n")


def mark_unfixed(v: DataFrame, fixes: DataFrame) -> DataFrame:
    """Adds fixable: some fix touched the violation's cell."""
    done = fixes.select("tuple_id", "attr").distinct().withColumn("fixable", F.lit(True))
    return v.join(done, ["tuple_id", "attr"], "left").withColumn("fixable", F.coalesce("fixable", F.lit(False)))


def repair_loop(
    rows: DataFrame, check: Callable[[DataFrame], DataFrame], names: Sequence[str], written: Callable[[DataFrame, str], DataFrame], most: int = 3,
    normalisers: dict[str, Callable[[Column], Column]] | None = None, key: Sequence[str] | None = None, history: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verify and fix in turn: (rows, violations left, all fixes with their round).

    normalisers: normal forms by attribute; if a format of the attribute is violated, every row gets its normal
    form.  key: rows that repeat it and say nothing of their own are deleted.  history: earlier fixes (tuple_id,
    attr); a cell that a fix touched is not tried again for its logic.  Stops when nothing is violated, nothing could be fixed, or only warnings are left after a fix.  written
    stores a round's table where all executors can read it, which also cuts the lineage.
    """
    every = None
    for n in range(most):
        found = written(categorise(dedup(check(rows))), f"violations-{n}")
        if not found.head(1):
            break
        if every is not None and not found.where("severity = 'error'").head(1):
            break
        tries = for_tools(found)
        past = [h.select("tuple_id", "attr") for h in (history, every) if h is not None]
        if past:
            logic = F.col("constraint_type") == "LOGIC"
            tries = tries.where(~logic).unionByName(not_yet_fixed(tries.where(logic), reduce(DataFrame.union, past)).select(tries.columns))
        fixes = suggest(tries, rows, names, normalisers)
        if key:
            fixes = fixes.unionByName(delete_fixes(found, rows, key, names))
        fixes = written(fixes.withColumn("round", F.lit(n)), f"fixes-{n}")
        if not fixes.head(1):
            break
        every = fixes if every is None else every.unionByName(fixes)
        rows = apply_fixes(rows, fixes, names)
        if normalisers:
            bad = {r["attr"] for r in found.where("constraint_type = 'FORMAT'").select("attr").distinct().collect()}  # attributes of the schema
            for attr in sorted(bad & normalisers.keys()):
                rows = normalise_column(rows, attr, normalisers[attr])
        rows = written(rows, f"rows-{n}")
    left = categorise(dedup(check(rows)))
    if every is None:
        every = suggest(left, rows, names).withColumn("round", F.lit(0)).limit(0)
    return rows, left, every


def lookup_rows(rows: DataFrame, ids: DataFrame, tuple_id: str = "tuple_id") -> DataFrame:
    """Rows by id, tolerant of square brackets around the asked ids; ids: tuple_id."""
    asked = ids.select(F.regexp_replace(F.trim("tuple_id"), r"^\[+|\]+$", "").alias("_asked")).distinct()
    return rows.join(asked, F.regexp_replace(F.trim(F.col(tuple_id).cast("string")), r"^\[+|\]+$", "") == F.col("_asked"), "left_semi")


def not_yet_fixed(v: DataFrame, history: DataFrame) -> DataFrame:
    """Violations whose cell is not in the history of fixes: those that may still be tried."""
    return v.join(history.select("tuple_id", "attr").distinct(), ["tuple_id", "attr"], "left_anti")


def first_fixes(fixes: DataFrame, n: int | None = None) -> DataFrame:
    """The first n fixes in order (a limit that some callers set per round); all of them by default."""
    return fixes if n is None else fixes.orderBy("ord", "id").limit(n)
