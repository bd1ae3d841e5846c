"""License scan with ordered signature rules, in DataFrame expressions only.

Keywords stand at the start of a word and are plain lower-case letters, digits and blanks.

1. Every text becomes its words joined by single spaces (ASCII letters in any case, digits, all non-ASCII).
2. Keyword prefilter: one alternation of the rules' keywords decides whether a text needs rules at all, and
   then a rule runs only if the text holds its keyword.
3. Each rule yields all its places: the text is split at the pattern, and running lengths of the pieces and
   of the matches give character offsets.
4. Suppression: detections in order of (start, longest, priority); one that lies within an earlier kept one
   is dropped, of equal intervals the higher priority stays.  Base phrases are counted before suppression
   and their labels always stay.

It is one map over rows: nothing is shuffled, so a hot source or a group of copies costs nothing extra.

Edge cases: null and empty texts have no words, no labels and score 0; ids may repeat or be null; other
columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_rules import BASE, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "struct<start:int,stop:int,priority:int,label:string,confidence:double>"


def spaced(text: str | Column) -> Column:
    """' w1 w2 ... ': the text's words between single spaces; ' ' if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), text_or_empty(text), F.lit(" ")), SEPARATORS, " ")


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, factored by their common beginnings."""
    if "" in words:
        return ""  # a shorter word ends here
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = [h + one_of(rest) for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _rule_array(table: list[tuple[str, int, float, str, str]]) -> Column:
    one = [F.struct(F.lit(lb).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(f" {k}").alias("keyword"), F.lit(rf"(?<= )(?:{r})(?= )").alias("pattern")) for lb, p, c, k, r in table]
    return F.array(*one)


def _places(text: Column, rule: Column) -> Column:
    """All matches of one rule as structs; offsets are characters from 0, stop exclusive."""
    matches = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    pieces = F.transform(F.split(text, rule["pattern"]), F.length)
    lengths = F.transform(matches, F.length)
    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(lengths)).alias("gap"), lengths.alias("len")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.array_append(acc["found"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))).alias("found"),
        ),
    )
    return walked["found"]


def _suppressed(found: Column) -> Column:
    """Drops detections contained in a kept one."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("end"), (-d["priority"]).alias("rank"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    kept = F.aggregate(
        order,
        F.struct(F.lit(0).alias("reach"), F.array().cast("array<struct<start:int,stop:int,label:string,confidence:double>>").alias("kept")),
        lambda acc, d: F.when(-d["end"] <= acc["reach"], acc).otherwise(F.struct((-d["end"]).alias("reach"), F.array_append(acc["kept"], F.struct(d["start"].alias("start"), (-d["end"]).alias("stop"), d["label"].alias("label"), d["confidence"].alias("confidence"))).alias("kept"))),
    )
    return kept["kept"]


def license_scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), table: list[tuple[str, int, float, str, str]] | None = None) -> DataFrame:
    """keep columns, n_words, base (struct array of base places), found (kept detections with offsets)."""
    table = rules() if table is None else table
    gate = "(?i) " + one_of(sorted({k for _, _, _, k, _ in table}))
    rows = docs.select(*keep, spaced(text_col).alias("_s"))
    # the rest runs on the few texts with a keyword; these are lower-cased there
    rows = rows.withColumn("_low", F.when(F.col("_s").rlike(gate), F.translate("_s", UPPER, LOWER)))
    low = F.col("_low")
    fired = F.filter(_rule_array(table), lambda r: F.contains(low, r["keyword"]))
    rows = rows.withColumn("_all", F.when(low.isNotNull(), F.flatten(F.transform(fired, lambda r: _places(low, r)))))
    none = F.array().cast(f"array<{FOUND}>")
    rows = rows.withColumn("_all", F.coalesce("_all", none))
    words = F.length("_s") - F.length(F.replace("_s", F.lit(" "), F.lit(""))) - 1
    return rows.select(*keep, words.cast("long").alias("n_words"), F.filter("_all", lambda d: d["priority"] == 0).alias("base"), _suppressed(F.col("_all")).alias("found"), "_s")


def license_digest(scan: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The contract's columns from license_scan's."""
    # every word is preceded by one space: the word number at an offset is the number of spaces before it, less one
    at = lambda o: (o - F.length(F.replace(F.substring(F.col("_s"), F.lit(1), o), F.lit(" "), F.lit(""))) - 1).cast("long")
    starts = F.transform("base", lambda d: d["start"])
    labels = lambda c: F.array_distinct(F.transform(c, lambda d: d["label"]))
    base = labels(F.col("base"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    some = F.size("base") > 0
    return scan.select(
        *keep, "n_words", F.size("base").cast("long").alias("n_base"),
        F.when(some, at(F.array_min(starts))).alias("first_word"), F.when(some, at(F.array_max(starts))).alias("last_word"),
        text(base).alias("base_labels"), text(F.array_union(base, labels(F.col("found")))).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda d: d["confidence"])), F.lit(0.0)), 6).alias("score"),
    )


assert len(BASE) == 4
