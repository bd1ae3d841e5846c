"""Content-hash identifiers as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _short(prefix: str, hashed: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(hashed, 1, n))


def joined(*parts: Column) -> Column:
    """Parts with colons between; a null part reads None."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def run_id(schema: Column, docs: Column, prompt: Column, table: Column) -> Column:
    return _short("run-", F.sha2(joined(schema, docs, prompt, table), 256), 16)


def tuple_id(table: Column, index: Column, row_json: Column) -> Column:
    """t-<table>-<ordinal, three digits at least>-<hash of the row>."""
    n = index.cast("string")
    return F.concat(F.lit("t-"), table, F.lit("-"), F.lpad(n, 3, "0") if isinstance(index, int) else F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n), F.lit("-"), F.substring(F.md5(row_json), 1, 8))


def violation_id(table: Column, tuple_: Column, attr: Column, kind: Column) -> Column:
    return _short("v-", F.md5(joined(table, tuple_, attr, kind)), 8)


def fix_id(table: Column, tuple_: Column, attr: Column, kind: Column, old: Column) -> Column:
    return _short("f-", F.md5(joined(table, tuple_, attr, kind, old)), 8)


def table_id(name: str, schema_json: Column) -> Column:
    return _short(f"table-{name}-", F.md5(schema_json), 8)


def detector_id(class_name: str, version: int = 1) -> Column:
    return F.lit(f"{class_name}.v{version}")
