"""Declared schemas: four JSON layouts read once, on the driver, into frozen definitions."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Attr:
    name: str
    type: str = ""
    options: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str, default: Any = None) -> Any:
        return self.options.get(key, default)

    @property
    def kind(self) -> str:
        return self.type.lower().strip()

    @property
    def scale(self) -> int | None:
        """s of DECIMAL(p, s)."""
        m = re.match(r"decimal\s*\(\s*\d+\s*,\s*(\d+)\s*\)$", self.kind)
        return int(m[1]) if m else None

    @property
    def is_temporal(self) -> bool:
        if self.kind:
            return any(w in self.kind for w in ("date", "time"))
        return bool(re.search(r"(^|_)(date|time|day|month|year|at|on)($|_)|(Date|Time)", self.name)) or self.name.lower().endswith(("date", "time"))

    @property
    def is_numeric(self) -> bool:
        return any(w in self.type.upper() for w in ("DECIMAL", "INTEGER", "FLOAT", "DOUBLE", "NUMBER", "INT"))


@dataclass(frozen=True)
class Relation:
    kind: str
    from_table: str
    from_field: str
    to_table: str
    to_field: str
    nullable: bool = True


@dataclass(frozen=True)
class Rule:
    id: str
    type: str = ""
    severity: str = "error"
    scope: str = ""
    tables: tuple[str, ...] = ()
    enabled: bool = True
    logic: dict[str, Any] = field(default_factory=dict)
    name: str = ""


@dataclass(frozen=True)
class Table:
    name: str
    attrs: tuple[Attr, ...]
    kind: str = "entity"
    extraction: dict[str, Any] = field(default_factory=dict)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.attrs if a.get("primary_key"))

    def attr(self, name: str) -> Attr | None:
        return next((a for a in self.attrs if a.name == name), None)


@dataclass(frozen=True)
class Schema:
    tables: tuple[Table, ...]
    relations: tuple[Relation, ...] = ()
    rules: tuple[Rule, ...] = ()

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name.lower() == name.lower():
                return t
        raise KeyError(name)

    def targets(self, named: str | None) -> list[str]:
        """The named table, or all of them if there is none of that name."""
        names = [t.name for t in self.tables]
        return [named] if named in names else names

    def foreign_key(self, table: str, attr: str) -> tuple[str, str] | None:
        """(table, field) referred to: from the attribute's own dict, or from relations if it says just True."""
        a = self.table(table).attr(attr)
        fk = a.get("foreign_key") if a else None
        if isinstance(fk, dict):
            return fk.get("table"), fk.get("field")
        if fk:
            for r in self.relations:
                if r.from_table == table and r.from_field == attr:
                    return r.to_table, r.to_field
        return None

    def rules_for(self, table: str, kind: str | None = None, scope: str | None = None) -> list[Rule]:
        return [r for r in self.rules if r.enabled and (kind is None or r.type == kind) and (scope is None or not r.scope or r.scope == scope) and (not r.tables or table in r.tables)]

    def shared_fields(self) -> dict[str, list[str]]:
        """Fields declared by more than one table."""
        found: dict[str, list[str]] = {}
        for t in self.tables:
            for a in t.attrs:
                found.setdefault(a.name, []).append(t.name)
        return {f: ts for f, ts in found.items() if len(ts) > 1}

    def reference_of(self, attr: str) -> str | None:
        """The table that an attribute like CourseID or course_id names, in any case."""
        m = re.match(r"(.+?)_?id$", attr, re.I)
        return next((t.name for t in self.tables if m and t.name.lower() == m[1].lower()), None)


def _attr(name: str, spec: Any) -> Attr:
    spec = dict(spec) if isinstance(spec, dict) else {"type": spec or ""}
    inner = spec.pop("constraints", None)
    if isinstance(inner, dict):
        spec = {**inner, **spec}  # nested constraints never overwrite
    elif inner is not None:
        spec["constraints"] = list(inner)
    return Attr(name, str(spec.pop("type", "") or ""), spec)


def _attrs(spec: Any) -> tuple[Attr, ...]:
    if isinstance(spec, dict):
        return tuple(_attr(n, s) for n, s in spec.items())
    return tuple(_attr(s["name"], {k: v for k, v in s.items() if k != "name"}) if isinstance(s, dict) else _attr(str(s), "") for s in spec or ())


def _table(name: str, spec: dict[str, Any]) -> Table:
    body = spec.get("attributes") or spec.get("fields") or spec.get("columns") or ()
    kind = str(spec.get("type") or "entity").lower()
    extraction = spec.get("relation_extraction") or {}
    if kind == "relationship" or extraction.get("enabled"):
        kind = "relation"
    return Table(name, _attrs(body), kind, extraction)


def parse_schema(source: str | dict[str, Any]) -> Schema:
    """tables as list or dict, or one table with columns as list or dict; repeated names get _1, _2, ..."""
    spec = json.loads(source) if isinstance(source, str) else source
    tables = spec.get("tables")
    if isinstance(tables, dict):
        found = [_table(n, s) for n, s in tables.items()]
    elif tables:
        found = [_table(s.get("name") or s.get("table_name"), s) for s in tables]
    else:
        found = [_table(spec.get("table_name") or spec.get("name") or "table", spec)]
    many, seen = Counter(t.name for t in found), Counter()
    named = []
    for t in found:
        if many[t.name] > 1:
            seen[t.name] += 1
            t = replace(t, name=f"{t.name}_{seen[t.name]}")
        named.append(t)
    relations = tuple(
        Relation(r.get("type", ""), r["from"].get("table"), r["from"].get("field"), r["to"].get("table"), r["to"].get("field"), (r.get("constraints") or {}).get("nullable", True) is not False)
        for r in spec.get("relations") or () if r.get("from") and r.get("to")
    )
    rules = tuple(Rule(r.get("id", ""), r.get("type", ""), str(r.get("severity", "error")).lower(), r.get("scope", ""), tuple(r.get("tables") or ()), r.get("enabled", True), r.get("validation_logic") or {}, r.get("name", "")) for r in spec.get("rules") or ())
    return Schema(tuple(named), relations, rules)


def keyword_rules(rules: list[dict[str, Any]], table: str, fields: list[str]) -> list[dict[str, Any]]:
    """Business rules whose trigger words occur in the table's name or in a field's, in any case."""
    names = [table.lower(), *(f.lower() for f in fields)]
    return [r for r in rules if any(k.lower() in n for k in r.get("keywords", ()) for n in names)]
