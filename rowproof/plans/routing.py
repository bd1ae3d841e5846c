"""Which families of checks a table needs: read off its declaration, instead of asking a model."""

from __future__ import annotations

from .schema import Schema

FAMILIES = ("TYPE", "VALUE", "STRUCTURE", "FORMAT", "LOGIC", "TEMPORAL", "REFERENCE", "AGGREGATION")
MANDATORY = ("TYPE", "STRUCTURE")
BASIC = ("FORMAT", "TYPE")


def route(schema: Schema, table: str, formats: dict[str, str] | None = None) -> list[str]:
    """formats: patterns of a rule file, by attribute."""
    t = schema.table(table)
    any_of = lambda *keys: any(a.get(k) for a in t.attrs for k in keys)
    needed = set(MANDATORY)
    if any(a.is_numeric for a in t.attrs) or any_of("min", "max", "domain", "enum", "constraints"):
        needed.add("VALUE")
    if any_of("pattern") or any(t.attr(a) for a in formats or ()):
        needed.add("FORMAT")
    if any_of("business_rules") or schema.rules_for(table, "logic"):
        needed.add("LOGIC")
    if any(a.is_temporal for a in t.attrs):
        needed.add("TEMPORAL")
    if any(schema.foreign_key(table, a.name) for a in t.attrs):
        needed.add("REFERENCE")
    if any_of("calculated") or schema.rules_for(table, "aggregation"):
        needed.add("AGGREGATION")
    return [f for f in FAMILIES if f in needed]


def skipped(schema: Schema, table: str) -> list[str]:
    return [f for f in FAMILIES if f not in route(schema, table)]
