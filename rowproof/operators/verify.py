"""Verification of whole tables: one scan for all row-local checks, plans for the rest; ids, categories, summaries."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import violation_id
from ..plans.routing import FAMILIES, route
from ..plans.schema import Attr, Rule, Schema
from . import setchecks as S
from .checks import VIOLATION, null_suggestion, row_checks

#: Codegen keeps within its method size if an array holds at most so many checks.
PER_ARRAY = 60


def apply_checks(df: DataFrame, table: str, checks: list, tuple_id: str = "tuple_id", order: str | None = None) -> DataFrame:
    """All row-local checks in one projection; works on batches and streams."""
    checks = [c for c in checks if c.attr in df.columns]
    none = F.array().cast(f"array<{VIOLATION}>")
    parts = [F.filter(F.array(*(c.column() for c in checks[k : k + PER_ARRAY])), lambda x: x.isNotNull()) for k in range(0, len(checks), PER_ARRAY)]
    found = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none
    hits = df.select(F.col(tuple_id).cast("string").alias("tuple_id"), F.explode(found).alias("x"))
    return hits.select(F.lit(table).alias("tbl"), "tuple_id", "x.*", F.lit(None).cast("array<string>").alias("affected_tuple_ids")).select(*S.OUT)


def verify(df: DataFrame, schema: Schema, table: str, tables: dict[str, DataFrame] | None = None, families: list[str] | None = None, as_of: dt.date = dt.date(2024, 1, 1), strict: bool = False, formats: dict[str, str] | None = None, order: str = "_seq") -> DataFrame:
    """Violations of one table, with ids, before de-duplication.  tables: others, for references and joins."""
    t, routed = schema.table(table), families is None
    families = families or route(schema, table, formats)
    tables = tables or {}
    here = {a.name: a for a in t.attrs if a.name in df.columns}
    parts = [apply_checks(df, table, row_checks(schema, table, as_of, families, strict, formats))]
    if "VALUE" in families:
        parts.append(S.inferred_missing_all(df, table, {n: null_suggestion(a) for n, a in here.items() if a.is_numeric}))
        for f, ts in schema.shared_fields().items():  # spellings of entities that other tables name as well
            if table in ts and f in here and _is_name(here[f]) and any(n in tables and f in tables[n].columns for n in ts if n != table):
                parts.append(S.entity_consistency({n: d for n, d in ({**tables, table: df}).items() if n in ts}, f, only=table))
    if "STRUCTURE" in families:
        parts += [S.duplicates(df, table, a.name) for a in t.attrs if a.get("unique") and a.name in df.columns]
        if t.primary_key and set(t.primary_key) <= set(df.columns):
            parts.append(S.duplicate_keys(df, table, t.primary_key, order))
    if "TEMPORAL" in families:
        dated = next((n for n, a in here.items() if a.is_temporal), None)
        if dated and order in df.columns:
            parts.append(S.sequence_gaps(df, table, dated, order))
    if "REFERENCE" in families:
        for a in t.attrs:
            fk = schema.foreign_key(table, a.name)
            if fk and fk[0] in tables and a.name in df.columns:
                parts.append(S.foreign_key_with_fix(df, table, a.name, tables[fk[0]], fk[1]))
    if "AGGREGATION" in families:
        for r in schema.rules_for(table, "aggregation"):
            parts += _aggregation_rule(df, schema, table, r, tables)
    if here and ("AGGREGATION" in families or routed and any(a.is_numeric for a in t.attrs)):
        parts.append(S.summary_rows(df, table, list(here), None))
    return with_ids(reduce(DataFrame.unionByName, parts))


def _is_name(a: Attr) -> bool:
    """A text that may name an entity: neither a number nor a date nor a key."""
    return not (a.is_numeric or a.is_temporal or a.kind in ("boolean", "bool", "integer", "float", "number", "decimal") or a.get("primary_key") or a.get("foreign_key"))


def _aggregation_rule(df: DataFrame, schema: Schema, table: str, r: Rule, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """A declared limit of rows a group, or of an amount summed over a join, if the tables for it are there."""
    group, most = r.logic.get("group_by"), r.logic.get("max", r.logic.get("max_value"))
    if group not in df.columns or most is None:
        return []
    amount, join = r.logic.get("aggregate_field"), r.logic.get("join_field")
    if r.logic.get("aggregation_type") != "sum" and not amount:
        return [S.group_limit(df, table, group, most, r.id, r.severity)]
    # the amount stands in the table that the join field refers to, else in the first that has both fields
    fk = schema.foreign_key(table, join)
    near = [(fk[0], fk[1])] if fk else [(n, join) for n in (r.tables or tables) if n != table]
    for name, key in near:
        if join in df.columns and name in tables and {key, amount} <= set(tables[name].columns):
            return [S.join_limit(df, table, group, join, tables[name], key, amount, most, r.id, r.severity)]
    return []


def verify_basic(df: DataFrame, schema: Schema, table: str, as_of: dt.date = dt.date(2024, 1, 1)) -> DataFrame:
    """Format and type only, as run right after an extraction."""
    return with_ids(apply_checks(df, table, row_checks(schema, table, as_of, ["FORMAT", "TYPE"])))


def verify_multi(tables: dict[str, DataFrame], schema: Schema, child_to_parent: bool = False) -> DataFrame:
    """Relations and shared fields over several tables."""
    parts = []
    for r in schema.relations:
        a, f, b, g = r.from_table, r.from_field, r.to_table, r.to_field
        if child_to_parent and r.kind == "one-to-many":
            a, f, b, g = b, g, a, f
        if a in tables and b in tables and f in tables[a].columns and g in tables[b].columns:
            parts.append(S.relation(tables[a], a, f, tables[b], g, r.nullable))
    parts += [S.type_consistency({n: tables[n] for n in ts if n in tables and f in tables[n].columns}, f) for f, ts in schema.shared_fields().items() if any(n in tables and f in tables[n].columns for n in ts)]
    for f, ts in schema.shared_fields().items():
        own = {n: tables[n] for n in ts if n in tables and f in tables[n].columns and _is_name(schema.table(n).attr(f))}
        if len(own) > 1:
            parts.append(S.entity_consistency(own, f))
    for r in schema.rules:
        fields = r.logic.get("fields") or ()
        if r.enabled and r.type == "graph" and len(fields) == 2 and r.tables and r.tables[0] in tables:
            parts.append(S.graph_violations(S.edges(tables[r.tables[0]], *fields), r.tables[0]))
    if not parts:
        raise ValueError("the schema declares nothing over several tables")
    return with_ids(reduce(DataFrame.unionByName, parts))


def with_ids(v: DataFrame) -> DataFrame:
    kind = F.lower("constraint_type")
    return v.withColumn("id", violation_id(F.col("tbl"), F.col("tuple_id"), F.col("attr"), kind))


def execution_order(v: DataFrame) -> Column:
    return F.array_position(F.array(*(F.lit(f) for f in FAMILIES)), F.col("constraint_type"))


def dedup(v: DataFrame) -> DataFrame:
    """One violation for each cell and constraint type: the first in execution order (then by code and text).

    The id is a hash of 32 bits, which different cells share in a large table: the cell itself is the key.
    """
    w = Window.partitionBy("id", "tbl", "tuple_id", "attr", "constraint_type").orderBy(execution_order(v), "rule_code", "description")
    return v.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def normalise(v: DataFrame) -> DataFrame:
    """Unknown severities become warn (case is ignored), empty suggestions null."""
    low = F.lower("severity")
    return v.withColumn("severity", F.when(low.isin("error", "warn", "info"), low).otherwise("warn")).withColumn("suggested_fix", F.nullif(F.col("suggested_fix"), F.lit("")))


TOOL_CODES = ("VALUE_RANGE", "STRICT_LENGTH", "STRUCTURE_UNIQUE", "STRUCTURE_KEY_DUPLICATE", "LOGIC_PATTERN")


def category(v: DataFrame | None = None) -> Column:
    """tool_fixable or reextraction, from codes alone."""
    return (
        F.when(F.col("business_rule_id").isin("agg_1", "agg_2"), "reextraction")
        .when(F.col("constraint_type").isin("TYPE", "FORMAT") | F.col("suggested_fix").isNotNull() | F.col("rule_code").isin(*TOOL_CODES), "tool_fixable")
        .when(F.col("constraint_type").isin("STRUCTURE", "REFERENCE") | F.col("rule_code").isin("VALUE_MISSING", "VALUE_MISSING_INFERRED") | (F.col("severity") == "error"), "reextraction")
        .otherwise("tool_fixable")
    )


def categorise(v: DataFrame) -> DataFrame:
    return v.withColumn("processing_category", category(v))


def for_tools(v: DataFrame) -> DataFrame:
    """Looser than the category: some types always go to the tools as well."""
    return v.where((F.col("processing_category") == "tool_fixable") | F.col("constraint_type").isin("FORMAT", "TYPE", "VALUE", "LOGIC", "AGGREGATION"))


def for_reextraction(v: DataFrame) -> DataFrame:
    return v.where(F.col("processing_category") == "reextraction")


def summary(v: DataFrame) -> DataFrame:
    """Counts by type, by severity and by table in one pass."""
    return v.groupingSets([["constraint_type"], ["severity"], ["tbl"]], "constraint_type", "severity", "tbl").agg(F.count("*").alias("n"))


def by_attribute(v: DataFrame) -> DataFrame:
    return v.groupBy("constraint_type", "attr").agg(F.count("*").alias("n"))


def unfixable(v: DataFrame, fixes: DataFrame) -> DataFrame:
    """Violations whose cell no fix touched."""
    return v.join(fixes.select("tuple_id", "attr").distinct(), ["tuple_id", "attr"], "left_anti")


def repeated(v: DataFrame, fixes: DataFrame) -> DataFrame:
    """Violations whose cell had a fix before."""
    return v.join(fixes.select("tuple_id", "attr").distinct(), ["tuple_id", "attr"], "left_semi")


def without(v: DataFrame, ids: DataFrame) -> DataFrame:
    return v.join(ids.select("id").distinct(), "id", "left_anti")


def affected_anchors(v: DataFrame, rows: DataFrame, anchor: str, entities: DataFrame, entity_key: str) -> DataFrame:
    """Entities that the violating rows (or the rows a violation lists) refer to.

    A violation of a group that lists no members (too many, or a sum over a join) names the group: its rows are
    those with the group's value in the violation's attribute.
    """
    hit = v.select(F.explode(F.coalesce("affected_tuple_ids", F.array("tuple_id"))).alias("tuple_id")).distinct()
    found = rows.join(hit, "tuple_id", "left_semi").select(F.col(anchor).alias("_k"))
    if "attr" in v.columns:
        named = v.where("affected_tuple_ids is null").select("attr", F.regexp_extract("tuple_id", "(?s)^(?:AGGREGATION|GROUP)_(.*)$", 1).alias("_value"), F.col("tuple_id").rlike("^(AGGREGATION|GROUP)_").alias("_of_group"))
        named = named.where("_of_group").select("attr", "_value").distinct()
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("_value")) for c, t in rows.dtypes if "<" not in t))).alias("c")
        found = found.union(rows.select(F.col(anchor).alias("_k"), cells).select("_k", "c.attr", "c._value").join(named, ["attr", "_value"], "left_semi").select("_k"))
    keys = found.distinct()
    return entities.join(keys, F.col(entity_key) == F.col("_k"), "left_semi")
