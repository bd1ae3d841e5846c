"""Row-local checks: each is one expression that yields a violation struct or null.

All checks of a table are evaluated by a single projection over a single scan (see verify.py), and run
unchanged on streams.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.empties import is_blank, is_blank_or_nullword, strip
from ..plans.schema import Attr, Schema, Table

VIOLATION = "struct<attr:string,constraint_type:string,rule_code:string,severity:string,description:string,suggested_fix:string,business_rule_id:string>"


@dataclass(frozen=True)
class Check:
    attr: str
    kind: str
    code: str
    severity: str
    when: Column
    text: str
    fix: Column | None = None
    rule: str | None = None

    def column(self) -> Column:
        null = F.lit(None).cast("string")
        fields = F.struct(
            F.lit(self.attr).alias("attr"), F.lit(self.kind).alias("constraint_type"), F.lit(self.code).alias("rule_code"), F.lit(self.severity).alias("severity"),
            F.lit(self.text).alias("description"), (null if self.fix is None else self.fix.cast("string")).alias("suggested_fix"), (F.lit(self.rule) if self.rule else null).alias("business_rule_id"),
        )
        return F.when(self.when, fields)


def type_checks(table: Table) -> list[Check]:
    out = []
    for a in table.attrs:
        c, kind = F.col(a.name), a.kind
        tests = {
            "integer": (V.is_integer, V.keep_numeric, "INTEGER"), "int": (V.is_integer, V.keep_numeric, "INTEGER"),
            "float": (V.is_number, V.keep_numeric, "FLOAT"), "number": (V.is_number, V.keep_numeric, "FLOAT"), "decimal": (V.is_plain_decimal, V.keep_numeric, "DECIMAL"),
            "date": (V.is_date, V.suggest_date, "DATE"), "datetime": (V.is_datetime, V.suggest_date, "DATETIME"), "timestamp": (V.is_datetime, V.suggest_date, "DATETIME"),
            "boolean": (V.is_boolean, V.suggest_boolean, "BOOLEAN"), "bool": (V.is_boolean, V.suggest_boolean, "BOOLEAN"),
        }
        if kind in tests:
            valid, suggest, name = tests[kind]
            out.append(Check(a.name, "TYPE", f"TYPE_{name}", "warn", ~is_blank(c) & ~valid(c), f"not a valid {kind}", suggest(c)))
        elif a.scale is not None:
            scale = V.decimal_scale(c)
            out.append(Check(a.name, "TYPE", "TYPE_SCALE", "warn", ~is_blank(c) & (scale != a.scale), f"not {a.scale} digits after the point", F.format_string(f"%.{a.scale}f", V.to_number(c))))
    return out


def _bounds(a: Attr) -> tuple[float | None, float | None]:
    low, high = a.get("min"), a.get("max")
    for text in a.get("constraints") or ():
        words = str(text).upper().split()
        if len(words) == 3 and words[0] == "CHECK" and _reads_as_number(words[2]):
            n = float(words[2])
            low = {">=": n, ">": n + 0.001}.get(words[1], low)
            high = {"<=": n, "<": n - 0.001}.get(words[1], high)
    return low, high


def _reads_as_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def _listed(a: Attr, key: str) -> list[str]:
    if a.get(key):
        return [str(x) for x in a.get(key)]
    if key == "domain":
        for text in a.get("constraints") or ():
            head, _, rest = str(text).partition("CHECK IN")
            if rest:
                return [x.strip().strip("'\"") for x in rest.strip().strip("()").split(",")]
    return []


def nearest(c: Column, choices: list[str]) -> Column:
    """The choice equal in any case, else the one with the best character Jaccard; ties: smallest."""
    scored = F.array(*(F.struct((-F.when(F.lower(strip(c)) == v.lower(), 2.0).otherwise(V.char_jaccard(c, F.lit(v)))).alias("s"), F.lit(v).alias("v")) for v in sorted(choices)))
    return F.array_min(scored)["v"]


def null_suggestion(a: Attr) -> str:
    kind, name = a.kind, a.name.lower()
    if "id" in name:
        return "1"
    if "name" in name or "varchar" in kind or "text" in kind:
        return "未知"
    if "date" in kind:
        return "2024-01-01"
    if any(w in kind for w in ("decimal", "float", "number")):
        return "0"
    if "status" in name:
        return (_listed(a, "domain") or ["待确认"])[0]
    return "待补充"


def default_value(a: Attr, as_of: dt.date) -> str:
    name = a.name.lower()
    for words, value in ((("status",), "待处理"), (("date", "time"), as_of.isoformat()), (("amount", "price", "cost"), "0.00"), (("quantity", "count"), "1"), (("name",), "未命名"), (("description", "remark"), "无")):
        if any(w in name for w in words):
            return value
    by_kind = {"integer": "0", "int": "0", "number": "0", "float": "0.0", "decimal": "0.0", "boolean": "false", "bool": "false", "date": as_of.isoformat(), "datetime": f"{as_of.isoformat()} 00:00:00", "timestamp": f"{as_of.isoformat()} 00:00:00"}
    return by_kind.get(a.kind, "")


def value_checks(table: Table) -> list[Check]:
    out = []
    for a in table.attrs:
        c = F.col(a.name)
        if any("NOT NULL" in str(t).upper() for t in a.get("constraints") or ()):
            out.append(Check(a.name, "VALUE", "VALUE_MISSING", "error", is_blank_or_nullword(c), "missing value", F.lit(null_suggestion(a))))
        low, high = _bounds(a)
        n = V.to_number(c, spaces=True)
        present = ~is_blank_or_nullword(c)
        if low is not None:
            out.append(Check(a.name, "VALUE", "VALUE_RANGE", "warn", present & (n < float(low)), f"below the minimum {low}", F.lit(str(low))))
        if high is not None:
            out.append(Check(a.name, "VALUE", "VALUE_RANGE", "warn", present & (n > float(high)), f"above the maximum {high}", F.lit(str(high))))
        for key, code in (("domain", "VALUE_DOMAIN"), ("enum", "VALUE_ENUM")):
            if choices := _listed(a, key):
                out.append(Check(a.name, "VALUE", code, "warn", present & ~strip(c).isin(choices), f"not in its {key}", nearest(c, choices)))
    return out


def strict_checks(table: Table) -> list[Check]:
    """What schemas declare but the compatible mode does not enforce: VARCHAR(n), ENUM(...), nullable false."""
    import re

    out = []
    for a in table.attrs:
        c = F.col(a.name)
        if m := re.match(r"varchar\s*\(\s*(\d+)\s*\)$", a.kind):
            out.append(Check(a.name, "TYPE", "STRICT_LENGTH", "warn", F.length(c) > int(m[1]), f"longer than {m[1]}", F.substring(c, 1, int(m[1]))))
        if m := re.match(r"enum\s*\((.*)\)$", a.type.strip(), re.I):
            choices = [x.strip().strip("'\"") for x in m[1].split(",")]
            out.append(Check(a.name, "VALUE", "STRICT_ENUM", "warn", ~is_blank(c) & ~strip(c).isin(choices), "not in its ENUM", nearest(c, choices)))
        if a.get("nullable") is False:
            out.append(Check(a.name, "STRUCTURE", "STRICT_NULL", "error", is_blank(c), "null though nullable is false"))
    return out


def structure_checks(table: Table, as_of: dt.date) -> list[Check]:
    out = []
    key = table.primary_key
    for a in table.attrs:
        c = F.col(a.name)
        if a.get("not_null") or a.get("required"):
            out.append(Check(a.name, "STRUCTURE", "STRUCTURE_NOT_NULL", "error", is_blank(c), "must not be empty", F.lit(default_value(a, as_of))))
        if a.name in key:
            out.append(Check(a.name, "STRUCTURE", "STRUCTURE_KEY_NULL", "error", is_blank(c), "empty part of the primary key"))
    return out


def anchored(pattern: str) -> str:
    """A pattern that must match at the start only."""
    return f"^(?:{pattern})"


def format_checks(table: Table, config: dict[str, str] | None = None) -> list[Check]:
    out = []
    for a in table.attrs:
        pattern = a.get("pattern") or (config or {}).get(a.name)
        if pattern:
            c = F.col(a.name)
            text = a.get("pattern_description") or a.get("format_description") or "does not have its format"
            out.append(Check(a.name, "FORMAT", "FORMAT_PATTERN" if a.get("pattern") else "FORMAT_CONFIG", "warn", ~is_blank(c) & ~c.rlike(anchored(pattern)), str(text)))
    return out


PAIRS = (
    ("TEMPORAL_START_END", ("start", "begin"), ("end", "finish", "complete"), 1),
    ("TEMPORAL_CREATE_UPDATE", ("create", "add"), ("update", "modify"), 0),
    ("TEMPORAL_ORDER_DELIVERY", ("order",), ("delivery", "ship"), 3),
)


def temporal_checks(table: Table, as_of: dt.date) -> list[Check]:
    out = []
    dated = [a for a in table.attrs if a.is_temporal]
    day = F.lit(as_of.isoformat()).cast("timestamp_ntz")
    for a in dated:
        c, t = F.col(a.name), V.parse_date(F.col(a.name))
        out.append(Check(a.name, "TEMPORAL", "TEMPORAL_PARSE", "warn", ~is_blank(c) & t.isNull(), "not a date", V.suggest_date(c)))
        for key, bad in (("min_date", "before"), ("max_date", "after")):
            if a.get(key):
                bound = V.parse_date(F.lit(str(a.get(key))))
                out.append(Check(a.name, "TEMPORAL", f"TEMPORAL_{key.upper()}", "warn", t < bound if bad == "before" else t > bound, f"{bad} {a.get(key)}", F.lit(str(a.get(key)))))
        if a.get("no_future"):
            out.append(Check(a.name, "TEMPORAL", "TEMPORAL_FUTURE", "warn", t > day, "in the future", F.lit(as_of.isoformat())))
    for code, first, second, days in PAIRS:
        for x in dated:
            for y in dated:
                if x.name != y.name and any(w in x.name.lower() for w in first) and any(w in y.name.lower() for w in second):
                    early, late = V.parse_date(F.col(x.name)), V.parse_date(F.col(y.name))
                    fix = F.date_format(F.date_add(early.cast("date"), days), "yyyy-MM-dd")
                    out.append(Check(y.name, "TEMPORAL", code, "error", late < early, f"before {x.name}", fix))
    return out


def expected_value(a: Attr) -> Column | None:
    how = a.get("calculation") or {}
    kind = how.get("type")
    num = lambda f: V.to_number(F.col(f), spaces=True)
    if kind in ("sum", "multiply") and how.get("fields"):
        total = num(how["fields"][0])
        for f in how["fields"][1:]:
            total = total + num(f) if kind == "sum" else total * num(f)
        return total
    if kind == "percentage":
        return F.try_divide(num(how["numerator"]), num(how["denominator"])) * 100
    return None


def aggregation_checks(table: Table, tolerance: float = 0.01) -> list[Check]:
    out = []
    for a in table.attrs:
        if a.get("calculated") and (want := expected_value(a)) is not None:
            have = V.to_number(F.col(a.name), spaces=True)
            out.append(Check(a.name, "AGGREGATION", "AGGREGATION_CALCULATED", "error", F.abs(have - want) > tolerance, "differs from its formula", F.round(want, 6)))
    return out


def cash_ratio(beginning: str, ending: str, rule: str = "phi_2", limit: float = 10.0) -> Check:
    a, b = V.to_number(F.col(beginning)), V.to_number(F.col(ending))
    return Check(ending, "LOGIC", "LOGIC_CASH_RATIO", "error", F.abs(F.try_divide(b, a)) >= limit, f"at least {limit:g} times {beginning}", rule=rule)


def logic_checks(table: Table, schema: Schema | None = None) -> list[Check]:
    out = []
    for a in table.attrs:
        c = F.col(a.name)
        for r in a.get("business_rules") or ():
            text = r.get("description") or "breaks a business rule"
            if r.get("type") == "pattern":
                out.append(Check(a.name, "LOGIC", "LOGIC_PATTERN", "warn", ~is_blank(c) & ~c.rlike(anchored(r["pattern"])), text))
            elif r.get("type") == "range":
                n = V.to_number(c)
                outside = n.isNull() | (n < float(r.get("min", "-inf"))) | (n > float(r.get("max", "inf")))
                out.append(Check(a.name, "LOGIC", "LOGIC_RANGE", "warn", ~is_blank(c) & outside, text))
    for r in schema.rules_for(table.name, "logic") if schema else ():
        names = [f for f in r.logic.get("fields", ()) if table.attr(f)]
        begin = next((f for f in names if "end" not in f.lower() and "begin" in f.lower()), None)
        end = next((f for f in names if "end" in f.lower()), None)
        if begin and end:
            out.append(cash_ratio(begin, end, r.id, float(r.logic.get("max_ratio", 10))))
    return out


def row_checks(schema: Schema, table: str, as_of: dt.date, families: list[str] | None = None, strict: bool = False, formats: dict[str, str] | None = None) -> list[Check]:
    """The row-local checks of a table, in execution order."""
    t = schema.table(table)
    every = {
        "TYPE": lambda: type_checks(t), "VALUE": lambda: value_checks(t), "STRUCTURE": lambda: structure_checks(t, as_of), "FORMAT": lambda: format_checks(t, formats),
        "LOGIC": lambda: logic_checks(t, schema), "TEMPORAL": lambda: temporal_checks(t, as_of), "AGGREGATION": lambda: aggregation_checks(t),
    }
    out = [c for f, make in every.items() if families is None or f in families for c in make()]
    return out + (strict_checks(t) if strict else [])
