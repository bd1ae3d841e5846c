"""The tool surface as plain functions: verify, fix, and what a client may ask about."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..functions import values as V
from ..operators import repair, verify
from .routing import FAMILIES
from .schema import Attr, Schema, Table

FIX_STRATEGIES = {"TYPE": "convert to the declared type", "VALUE": "clamp to the bound or take the nearest listed value", "STRUCTURE": "fill a default, merge or delete dominated rows", "FORMAT": "normal form", "TEMPORAL": "ISO date or the date that order demands", "REFERENCE": "nearest referred value", "AGGREGATION": "recalculate", "LOGIC": "normal form or manual review"}
SCHEMA_TEMPLATE = {"tables": [{"name": "table", "type": "entity", "attributes": {"id": {"type": "INTEGER", "primary_key": True}, "name": {"type": "VARCHAR(255)", "not_null": True}}}], "relations": [], "rules": []}


def constraint_types() -> list[str]:
    return list(FAMILIES)


def spark_type(a: Attr) -> DataType:
    if a.scale is not None:
        return DecimalType(38, min(a.scale, 38))
    kinds = {"integer": LongType(), "int": LongType(), "float": DoubleType(), "number": DoubleType(), "decimal": DecimalType(38, 18), "date": DateType(), "datetime": TimestampNTZType(), "timestamp": TimestampNTZType(), "boolean": BooleanType(), "bool": BooleanType()}
    return kinds.get(a.kind, StringType())


def row_type(table: Table) -> StructType:
    """The row model of a declared table."""
    return StructType([StructField(a.name, spark_type(a), True) for a in table.attrs])


def materialise(df: DataFrame, table: Table) -> DataFrame:
    """Text columns cast to their declared types; what does not fit becomes null."""

    def cast(a: Attr):
        c, t = F.col(a.name), spark_type(a)
        if isinstance(t, (LongType, DoubleType, DecimalType)):
            return V.strip_currency(c, spaces=True).try_cast(t)
        if isinstance(t, (DateType, TimestampNTZType)):
            return V.parse_date(c).cast(t)
        if isinstance(t, BooleanType):
            return F.when(V.is_boolean(c), F.lower(F.trim(c)).isin(*V.TRUE_WORDS))
        return c

    return df.select(*(cast(a).alias(a.name) for a in table.attrs if a.name in df.columns))


def batch_verify(df: DataFrame, schema: Schema, table: str, families: list[str] | None = None, as_of: dt.date = dt.date(2024, 1, 1), tables: dict[str, DataFrame] | None = None, formats: dict[str, str] | None = None, strict: bool = False, order: str = "_seq") -> DataFrame:
    """Violations of a table, one per cell and type, categorised.

    tables: the others, for references, joined limits and spellings; formats: patterns of a rule file, by attribute.
    """
    return verify.categorise(verify.dedup(verify.normalise(verify.verify(df, schema, table, tables, families, as_of, strict, formats, order))))


def fix_violations(df: DataFrame, violations: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fixes for the violations, and the rows after them."""
    fixes = repair.suggest(verify.for_tools(violations), df, columns)
    return fixes, repair.apply_fixes(df, fixes, columns)
