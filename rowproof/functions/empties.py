"""The five notions of "empty" that different rules use, by name."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trims every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def is_blank_or_nullword(c: Column) -> Column:
    return is_blank(c) | (F.lower(strip(c)) == "null")


def is_row_void(c: Column) -> Column:
    """Exact, untrimmed: what row comparison leaves out."""
    return c.isNull() | c.isin("", "null", "NULL")


def is_eval_null(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_llm_null(c: Column) -> Column:
    return c.isNull() | F.lower(c).isin("null", "none", "n/a", "")
