"""Checks that look beyond one row: duplicates, references, totals, groups, graphs, several tables.

Every function takes DataFrames and returns violations with the columns of OUT.  Nothing is gathered per
key unless the result itself lists a group's members; existence and counts are partial aggregates joined
back, so that a hot key can be split by adaptive execution.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.empties import is_blank, is_blank_or_nullword, strip
from ..sources.numbering import with_previous
from ..sources.shared import shared_table
from .matching import containing, few_edits

LOG = logging.getLogger(__name__)

#: Members that a violation lists in one row.
LISTED = 100_000
OUT = ("tbl", "tuple_id", "attr", "constraint_type", "rule_code", "severity", "description", "suggested_fix", "business_rule_id", "affected_tuple_ids")


def violations(df: DataFrame, table: str, tuple_id: Column, attr: Column | str, kind: str, code: str, severity: str, text: Column | str, fix: Column | None = None, rule: str | None = None, members: Column | None = None, extra: Column | None = None, extra_code: Column | None = None) -> DataFrame:
    """extra, extra_code: the table and the code as columns, where they differ between rows."""
    lit = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    return df.select(
        (F.lit(table) if extra is None else extra).alias("tbl"), tuple_id.cast("string").alias("tuple_id"), lit(attr).alias("attr"), F.lit(kind).alias("constraint_type"), (F.lit(code) if extra_code is None else extra_code).alias("rule_code"),
        F.lit(severity).alias("severity"), lit(text).alias("description"), (F.lit(None) if fix is None else fix).cast("string").alias("suggested_fix"),
        F.lit(rule).cast("string").alias("business_rule_id"), (F.lit(None) if members is None else members).cast("array<string>").alias("affected_tuple_ids"),
    )



def duplicates(df: DataFrame, table: str, attr: str, tuple_id: str = "tuple_id") -> DataFrame:
    """Unique violated: one violation for each member of a group of equal (untrimmed) values."""
    many = df.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("_v")).count().where("count > 1")
    hit = df.join(many, F.col(attr) == F.col("_v"))
    return violations(hit, table, F.col(tuple_id), attr, "STRUCTURE", "STRUCTURE_UNIQUE", "error", F.concat(F.lit("occurs "), F.col("count").cast("string"), F.lit(" times")))


def duplicate_keys(df: DataFrame, table: str, key: Sequence[str], order: str = "_seq", tuple_id: str = "tuple_id") -> DataFrame:
    """Second and later rows of a primary key: one violation for each key attribute, naming the first row."""
    first = df.where(~_any_blank(key)).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min(F.struct(order, tuple_id)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)]
    later = df.join(first, on).where(F.struct(F.col(order), F.col(tuple_id)) != F.col("_first"))
    later = later.withColumn("_attr", F.explode(F.array(*(F.lit(k) for k in key))))
    return violations(later, table, F.col(tuple_id), F.col("_attr"), "STRUCTURE", "STRUCTURE_KEY_DUPLICATE", "error", F.concat(F.lit("repeats the key of "), F.col(f"_first.{tuple_id}").cast("string")))


def _any_blank(names: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | is_blank(F.col(n).cast("string"))
    return out


def inferred_missing(df: DataFrame, table: str, attr: str, fix: str, tuple_id: str = "tuple_id") -> DataFrame:
    """A numeric attribute is empty though some other row has a value."""
    return inferred_missing_all(df, table, {attr: fix}, tuple_id)


def inferred_missing_all(df: DataFrame, table: str, fixes: dict[str, str], tuple_id: str = "tuple_id") -> DataFrame:
    """The same for several attributes, each with its fix: one row of flags over the table, then one scan."""
    empty = {a: is_blank_or_nullword(F.col(a).cast("string")) for a in fixes}
    flags = df.agg(*(F.max(~e).alias(f"f{k}") for k, e in enumerate(empty.values()))).first() if fixes else ()
    some = [a for a, flag in zip(fixes, flags) if flag]
    entry = lambda a: F.when(empty[a], F.struct(F.lit(a).alias("attr"), F.lit(fixes[a]).alias("fix")))
    none = F.array().cast("array<struct<attr:string,fix:string>>")
    hits = df.select(tuple_id, F.explode(F.filter(F.array(*map(entry, some)), lambda x: x.isNotNull()) if some else none).alias("_m"))
    return violations(hits, table, F.col(tuple_id), F.col("_m.attr"), "VALUE", "VALUE_MISSING_INFERRED", "error", "missing value", F.col("_m.fix"))


def foreign_key(df: DataFrame, table: str, attr: str, ref: DataFrame, ref_attr: str, strip_ref: bool = True, tuple_id: str = "tuple_id", fix: Column | None = None) -> DataFrame:
    """Non-blank values that the referred table does not have."""
    side = F.col(ref_attr).cast("string")
    keys = ref.where(side.isNotNull()).select((strip(side) if strip_ref else side).alias("_ref")).distinct()
    lost = df.where(~is_blank(F.col(attr).cast("string"))).join(keys, strip(F.col(attr).cast("string")) == F.col("_ref"), "left_anti")
    return violations(lost, table, F.col(tuple_id), attr, "REFERENCE", "REFERENCE_FOREIGN_KEY", "error", F.concat(F.lit("no such value: "), F.col(attr).cast("string")), fix)


def relation(df: DataFrame, table: str, attr: str, ref: DataFrame, ref_attr: str, nullable: bool = True, tuple_id: str = "tuple_id") -> DataFrame:
    """from -> to as declared, whatever the relation's kind; nulls violate only if not nullable."""
    keys = ref.where(F.col(ref_attr).isNotNull()).select(F.col(ref_attr).cast("string").alias("_ref")).distinct()
    lost = df.where(F.col(attr).isNotNull()).join(keys, F.col(attr).cast("string") == F.col("_ref"), "left_anti")
    out = violations(lost, table, F.col(tuple_id), attr, "REFERENCE", "REFERENCE_RELATION", "error", F.concat(F.lit("no such value: "), F.col(attr).cast("string")))
    if nullable:
        return out
    return out.unionByName(relation_nulls(df, table, attr, tuple_id))


def relation_nulls(df: DataFrame, table: str, attr: str, tuple_id: str = "tuple_id") -> DataFrame:
    return violations(df.where(F.col(attr).isNull()), table, F.col(tuple_id), attr, "REFERENCE", "REFERENCE_NULL", "error", "null in a relation that allows none")


#: Bounds of similarity at which nearest sets are looked for, one after another; at 0 any common character counts.
TIERS = (0.75, 0.5, 0.25, 0.0)


def nearest_sets(x: DataFrame, y: DataFrame, tiers: Sequence[float] = TIERS) -> tuple[DataFrame, int]:
    """(x, nearest, score) of the y most similar to each x, and how many pairs were compared; x, y: texts of distinct characters.

    y also has nearest, by which equal scores are decided.  Sets with a Jaccard similarity of at least t share
    one of their rarest characters, all but t of each, and their sizes differ by the factor t at most; so each
    tier joins on few rare characters, an x leaves once its best is at the tier or above, and only what is left
    meets wider prefixes.  An x that shares no character has no row.
    """
    split = lambda c: F.filter(F.split(F.col(c), ""), lambda ch: ch != "")
    often = y.select(F.explode(split("y")).alias("ch")).groupBy("ch").agg(F.count("*").alias("often"))

    def ranked(df: DataFrame, c: str) -> DataFrame:
        """Sets with their characters, rarest first: at most one row a character of the alphabet is grouped."""
        each = df.select(c, F.explode(split(c)).alias("ch")).join(often, "ch", "left")
        listed = each.groupBy(c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "ch"))).alias("l"))
        return listed.select(c, F.transform("l", lambda e: e["ch"]).alias(f"{c}s"))

    ys = shared_table(ranked(y, "y").join(y, "y"), "nearest-of")
    left = shared_table(ranked(x, "x"), "nearest-for")
    found, compared = [], 0
    for t in tiers:
        if not left.head(1):
            break
        prefix = lambda c: F.explode(F.slice(c, F.lit(1), F.least(F.size(c), F.size(c) - F.ceil(F.size(c) * t - 1e-9).cast("int") + 1))).alias("ch")  # noqa: E731, B023
        near = left.select("x", "xs", prefix("xs")).join(ys.select("y", "ys", "nearest", prefix("ys")), "ch")
        near = near.where((F.size("ys") >= F.size("xs") * t - 1e-9) & (F.size("xs") >= F.size("ys") * t - 1e-9)).dropDuplicates(["x", "y"])
        common = F.size(F.array_intersect("xs", "ys"))
        scored = near.select("x", "nearest", (common / (F.size("xs") + F.size("ys") - common)).alias("s"))
        best = shared_table(scored.groupBy("x").agg(F.min(F.struct((-F.col("s")).alias("s"), "nearest")).alias("b"), F.count("*").alias("n")), "nearest-best")
        compared += best.agg(F.sum("n")).first()[0] or 0
        settled = best.where(-F.col("b.s") >= t).select("x", "b.nearest", (-F.col("b.s")).alias("score"))
        found.append(settled)
        left = shared_table(left.join(settled, "x", "left_anti"), "nearest-for")
    LOG.info("nearest sets: %s pairs compared", compared)
    if not found:
        return x.select("x", F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("score")).limit(0), 0
    return reduce(DataFrame.union, found), compared


def nearest_reference(lost: DataFrame, attr: str, ref: DataFrame, ref_attr: str) -> DataFrame:
    """(attr value, nearest, score) for the distinct values of lost.

    Values equal in any case come first (score 2), then the best character-set Jaccard; the smallest value on
    ties, and with score 0 where none shares a character.  Scores hang on the sets of characters alone, so
    distinct sets are compared: values of digits have at most 1023 of them, however many values there are.
    """
    chars = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != "")))
    a = lost.select(F.col(attr).cast("string").alias("value")).where("value is not null").distinct()
    b = ref.select(F.col(ref_attr).cast("string").alias("nearest")).where("nearest is not null").distinct()
    same = b.groupBy(F.lower("nearest").alias("_low")).agg(F.min("nearest").alias("_same"))
    a = shared_table(a.select("value", F.concat_ws("", chars(F.col("value"))).alias("x")).join(same, F.lower(strip(F.col("value"))) == F.col("_low"), "left").select("value", "x", "_same"), "nearest-lost")
    x = a.where("_same is null and x <> ''").select("x").distinct()
    if not x.head(1):
        smallest, best = (b.agg(F.min("nearest")).first()[0] if a.where("_same is null").head(1) else None), x.select("x", F.lit(None).cast("string").alias("near"), F.lit(None).cast("double").alias("s"))
    else:
        y = shared_table(b.groupBy(F.concat_ws("", chars(F.col("nearest"))).alias("y")).agg(F.min("nearest").alias("nearest")), "nearest-sets")
        smallest = y.agg(F.min("nearest")).first()[0]
        best = nearest_sets(x, y)[0].select("x", F.col("nearest").alias("near"), F.col("score").alias("s"))
    out = a.join(best, "x", "left")
    return out.select("value", F.coalesce("_same", "near", F.lit(smallest)).alias("nearest"), F.round(F.when(F.col("_same").isNotNull(), 2.0).otherwise(F.coalesce("s", F.lit(0.0))), 6).alias("score"))


def foreign_key_with_fix(df: DataFrame, table: str, attr: str, ref: DataFrame, ref_attr: str, tuple_id: str = "tuple_id") -> DataFrame:
    """foreign_key, with the nearest value of the referred table as the suggestion."""
    out = foreign_key(df, table, attr, ref, ref_attr, tuple_id=tuple_id, fix=F.col(attr).cast("string"))  # the lost value, until the nearest is known
    near = nearest_reference(out.select("suggested_fix"), "suggested_fix", ref, ref_attr).select(F.col("value").alias("_v"), F.col("nearest").alias("_n"))
    return out.join(near, F.col("suggested_fix") == F.col("_v"), "left").withColumn("suggested_fix", F.col("_n")).select(*OUT)


TOTAL_WORDS, AVERAGE_WORDS = ("总计", "total", "合计", "sum"), ("平均", "average", "avg", "均值")


def summary_rows(df: DataFrame, table: str, cells: Sequence[str], average: bool | None = False, tuple_id: str = "tuple_id", tolerance: float = 0.01) -> DataFrame:
    """Rows whose cells name a total (or average): each numeric cell against the sum (mean) of all other rows.

    One row of counts of such rows, then, if there are any, one of sums over the table, and leave-one-out by
    subtraction.  average=None looks for both in one pass.
    """
    texts = F.array(*(F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in cells))
    kinds = [k for k in (False, True) if average in (k, None)]
    named = lambda words: F.exists(texts, lambda x: _any_word(x, words))
    marks = {k: named(AVERAGE_WORDS if k else TOTAL_WORDS).alias(f"_m{int(k)}") for k in kinds}
    nums = df.select(tuple_id, *marks.values(), *(V.to_number(F.col(c).cast("string"), spaces=True).alias(c) for c in cells))
    marked = [F.count_if(f"_m{int(k)}").alias(f"_n{int(k)}") for k in kinds]
    # decimals, so that a sum does not hang on the order of rows; doubles where a number does not fit
    exact = lambda c: F.col(c).try_cast("decimal(30,6)")
    totals = lambda c: (F.sum(exact(c)).alias(f"s_{c}"), F.sum(c).alias(f"d_{c}"), F.count_if(F.col(c).isNotNull() & exact(c).isNull()).alias(f"o_{c}"), F.count(c).alias(f"n_{c}"))
    sums = nums.agg(*marked).first().asDict()
    if any(sums.values()):  # reading all cells as numbers is dear
        sums |= nums.agg(*(x for c in cells for x in totals(c))).first().asDict()
    found = []
    for k in kinds:
        code = "AGGREGATION_AVERAGE_ROW" if k else "AGGREGATION_TOTAL_ROW"
        for c in cells if sums[f"_n{int(k)}"] else ():
            n = int(sums[f"n_{c}"] or 0) - 1
            if n <= 0:
                continue
            if sums[f"o_{c}"] or sums[f"s_{c}"] is None:
                others = F.lit(float(sums[f"d_{c}"] or 0.0)) - F.col(c)
            else:
                others = (F.lit(sums[f"s_{c}"]).cast("decimal(38,6)") - exact(c)).cast("double")
            want = others / n if k else others
            fix = F.format_string("%.2f", want) if k else F.round(want, 6)
            found.append(F.when(F.col(f"_m{int(k)}") & (F.abs(F.col(c) - want) > tolerance), F.struct(F.lit(c).alias("attr"), F.lit(code).alias("code"), fix.cast("string").alias("fix"))))
    empty = F.array().cast("array<struct<attr:string,code:string,fix:string>>")
    hits = nums.select(tuple_id, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()) if found else empty).alias("h"))
    out = violations(hits, table, F.col(tuple_id), F.col("h.attr"), "AGGREGATION", "", "error", "differs from the other rows", F.col("h.fix"), extra_code=F.col("h.code"))
    return out


def _any_word(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def group_limit(df: DataFrame, table: str, group: str, most: int, rule: str = "agg_2", severity: str = "error", distinct: str | None = None, members: bool = True, tuple_id: str = "tuple_id") -> DataFrame:
    """Groups of more than most rows (or distinct values), with the members where asked for.

    A list of over LISTED members would not fit a row: such a group's is null, and group_members has its rows.
    """
    some = df.where(~is_blank(F.col(group).cast("string")))
    n = F.countDistinct(distinct) if distinct else F.count("*")
    over = some.groupBy(group).agg(n.alias("_n"), F.count("*").alias("_rows")).where(F.col("_n") > most)
    if members:  # gathers only groups that are reported
        listed = some.join(over.where(F.col("_rows") <= LISTED), group).groupBy(group).agg(F.array_sort(F.collect_list(F.col(tuple_id).cast("string"))).alias("_ids"))
        over = over.join(listed, group, "left")
    return violations(over, table, F.concat(F.lit("AGGREGATION_"), F.col(group).cast("string")), group, "AGGREGATION", "AGGREGATION_GROUP_LIMIT", severity, F.concat(F.col("_n").cast("string"), F.lit(f" > {most}")), rule=rule, members=F.col("_ids") if members else None)


def group_members(df: DataFrame, found: DataFrame, group: str, tuple_id: str = "tuple_id") -> DataFrame:
    """(violation's tuple_id, member) for groups that group_limit reported, as rows and so of any size."""
    at = found.select(F.col("tuple_id").alias("_g")).distinct()
    rows = df.select(F.concat(F.lit("AGGREGATION_"), F.col(group).cast("string")).alias("_g"), F.col(tuple_id).cast("string").alias("member"))
    return rows.join(at, "_g").select(F.col("_g").alias("tuple_id"), "member")


def join_limit(df: DataFrame, table: str, group: str, fk: str, ref: DataFrame, ref_key: str, amount: str, most: float, rule: str = "agg_1", severity: str = "error") -> DataFrame:
    """Sum of a joined amount per group over a limit (such as credits of a student's courses)."""
    prices = ref.select(F.col(ref_key).alias("_k"), F.col(amount).cast("double").alias("_a"))
    sums = df.join(prices, F.col(fk) == F.col("_k")).groupBy(group).agg(F.sum("_a").alias("_s")).where(F.col("_s") > most)
    return violations(sums, table, F.concat(F.lit("GROUP_"), F.col(group).cast("string")), group, "AGGREGATION", "AGGREGATION_JOIN_LIMIT", severity, F.concat(F.lit("over "), F.lit(str(most))), rule=rule)


def sequence_gaps(df: DataFrame, table: str, attr: str, order: str = "_seq", days: int = 365, tuple_id: str = "tuple_id") -> DataFrame:
    """Times more than days whole elapsed days after the one before them; of equal times the first row is reported.

    Times are reduced to distinct ones, and each range partition of these is told the last time before it.
    """
    dated = df.select(F.col(tuple_id), F.col(order).alias("_o"), V.parse_date(F.col(attr).cast("string")).alias("_t")).where("_t is not null")
    first = dated.groupBy("_t").agg(F.min(F.struct("_o", tuple_id)).alias("f"))
    gaps = with_previous(first, "_t", "p").withColumn("n", F.extract(F.lit("DAY"), F.col("_t") - F.col("p"))).where(F.col("n") > days)
    return violations(gaps, table, F.col(f"f.{tuple_id}"), attr, "TEMPORAL", "TEMPORAL_GAP", "info", F.concat(F.col("n").cast("string"), F.lit(" days after the date before")))


# Graphs: edges are distinct (src, dst)


def edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).where(~is_blank(F.col("src")) & ~is_blank(F.col("dst"))).distinct()


def mutual(e: DataFrame) -> DataFrame:
    """Unordered pairs with edges both ways; a loop counts."""
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"]).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def loops(e: DataFrame) -> DataFrame:
    return e.where("src = dst").select("src")


def missing_transitive(e: DataFrame) -> DataFrame:
    """(a, c): a -> b -> c with c not a, and no edge a -> c."""
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c").select("a", "c").distinct()
    return two.join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti")


def closure(e: DataFrame) -> DataFrame:
    """All (src, dst) with a path, to a fixed point: rounds join the new pairs with all, so paths double in length."""
    known = new = shared_table(e.select("src", "dst").distinct(), "closure")
    while new.head(1):
        step = lambda x, y: x.select("src", F.col("dst").alias("via")).join(y.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        found = step(new, known).union(step(known, new)).distinct()
        new = shared_table(found.join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.union(new)
    return known


def graph_violations(e: DataFrame, table: str = "MULTI_TABLE") -> DataFrame:
    pair = lambda x, y: F.concat_ws("|", F.col(x), F.col(y))
    return (
        violations(mutual(e), table, pair("a", "b"), "mutual_investment", "LOGIC", "LOGIC_MUTUAL", "error", "edges both ways", rule="phi_1")
        .unionByName(violations(missing_transitive(e), table, pair("a", "c"), "transitive_investment", "LOGIC", "LOGIC_TRANSITIVE", "error", "an edge is implied", F.concat_ws("->", "a", "c"), rule="phi_3"))
        .unionByName(violations(loops(e), table, F.col("src"), "self_investment", "LOGIC", "LOGIC_SELF", "error", "an edge to itself"))
    )


# Several tables


def shared_values(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """(tbl, value, n): counts of a field's values in every table that has it."""
    out = None
    for name, df in tables.items():
        if field in df.columns:
            one = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "value", "n")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise KeyError(field)
    return out


def type_consistency(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """One violation for each table that lacks the type most values of the field have over all tables."""
    kinds = shared_values(tables, field).groupBy("tbl", V.value_type(F.col("value")).alias("kind")).agg(F.sum("n").alias("n"))
    main = kinds.groupBy("kind").agg(F.sum("n").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("m")).first()
    main_kind = main["m"]["kind"] if main["m"] else None
    has = kinds.groupBy("tbl").agg(F.max((F.col("kind") == F.lit(main_kind)).cast("int")).alias("has")).where("has = 0")
    text = f"lacks values of the main type {main_kind}"
    named = has.select(F.col("tbl").alias("_tbl"))
    return violations(named, "", F.lit("CROSS_TABLE"), field, "TYPE", "CROSS_TYPE", "warn", text, extra=F.col("_tbl"))


def domain_report(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """For each table: distinct values, those common to all tables, those that no other table has."""
    v = shared_values(tables, field)
    k = sum(field in df.columns for df in tables.values())
    per = v.groupBy("value").agg(F.count("*").alias("t"))
    return v.join(per, "value").groupBy("tbl").agg(F.count("*").alias("n_values"), F.count_if(F.col("t") == k).alias("n_common"), F.count_if(F.col("t") == 1).alias("n_exclusive")).withColumn("exclusive_share", F.round(F.col("n_exclusive") / F.col("n_values"), 6))


def format_report(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """(tbl, pattern, n) of the field's string patterns."""
    return shared_values(tables, field).groupBy("tbl", V.string_pattern(F.col("value")).alias("pattern")).agg(F.sum("n").alias("n"))


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) similar entity names; left and right: column value.

    Each rule has an equi-join that is complete for it: equal cores, containment of names and of cores by the
    rarest gram of the held one, few edits by rare 2-grams.  The exact test follows.
    """
    named = lambda df: df.where(~is_blank(F.col("value"))).select("value", strip(F.col("value")).alias("full"), strip(V._without(strip(F.col("value")), V.ENTITY_SUFFIXES)).alias("core")).distinct()
    x, y = named(left), named(right)

    def by(form: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs of forms as pairs of values."""
        return pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).join(x.select(F.col(form).alias("_a"), F.col("value").alias("a")), "_a").join(y.select(F.col(form).alias("_b"), F.col("value").alias("b")), "_b").select("a", "b")

    found = []
    for form, gram in (("full", 3), ("core", 2)):
        p, q = (d.select(F.col(form).alias("value")).where("value <> ''").distinct() for d in (x, y))
        found += [by(form, containing(p, q, gram), "longer", "shorter"), by(form, containing(q, p, gram), "shorter", "longer")]
    found.append(by("full", few_edits(*(d.select(F.col("full").alias("value")).distinct() for d in (x, y))), "a", "b"))
    near = reduce(DataFrame.union, found).where("a <> b").distinct()
    return near.where(V.similar_entities(F.col("a"), F.col("b")))


def entity_groups(pairs: DataFrame) -> DataFrame:
    """(value, leader): greedy groups of similar values, those that come first leading; pairs: a, b, both ways, different.

    A value leads if no smaller value that leads or is undecided is similar to it; one whose smallest such value
    leads belongs to it; the others wait for the next round.  Each round decides at least the smallest value.
    """
    pairs = shared_table(pairs.select("a", "b"), "entity-pairs")
    state = shared_table(pairs.select(F.col("a").alias("value"), F.lit(None).cast("string").alias("leader")).distinct(), "entity-state")
    while True:
        live = state.where("leader is null or leader = value").select(F.col("value").alias("b"), F.col("leader").isNotNull().alias("leads"))
        first = pairs.where("b < a").join(live, "b").groupBy("a").agg(F.min(F.struct("b", "leads")).alias("f"))
        after = state.join(first, state["value"] == first["a"], "left").select("value", F.coalesce("leader", F.when(F.col("f").isNull(), F.col("value")).when(F.col("f.leads"), F.col("f.b"))).alias("leader"))
        state = shared_table(after, "entity-state")
        if not state.where("leader is null").head(1):
            return state


def entity_consistency(tables: dict[str, DataFrame], field: str, tuple_id: str = "tuple_id", only: str | None = None) -> DataFrame:
    """Values of a shared field that are similar to one of another table but not the longest form of their group.

    Each two tables are looked at by themselves: their values form greedy groups, a group counts if both tables
    have a value in it, and its longest (then smallest) form is the canonical one.  only: the table whose
    violations are asked for.
    """
    held = {name: df for name, df in tables.items() if field in df.columns}
    text = strip(F.col(field).cast("string"))
    values = {name: df.select(text.alias("value")).where("value <> ''").distinct() for name, df in held.items()}
    canon: dict[str, list[DataFrame]] = {name: [] for name in held}
    names = list(held)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if only not in (None, x, y):
                continue
            both = values[x].select("value", F.lit(1).alias("x"), F.lit(0).alias("y")).union(values[y].select("value", F.lit(0), F.lit(1))).groupBy("value").agg(F.max("x").alias("x"), F.max("y").alias("y"))
            groups = entity_groups(similar_pairs(both.select("value"), both.select("value"))).join(both, "value")
            best = groups.groupBy("leader").agg(F.min(F.struct((-F.length("value")).alias("n"), "value")).alias("best"), F.max("x").alias("in_x"), F.max("y").alias("in_y")).where("in_x = 1 and in_y = 1")
            forms = groups.select("value", "leader").join(best, "leader").select(F.col("value").alias("_form"), F.col("best.value").alias("canon")).where("_form <> canon")
            for name in (x, y):
                canon[name].append(forms)
    out = None
    for name in names if only is None else [n for n in names if n == only]:
        if not canon[name]:
            continue
        forms = reduce(DataFrame.union, canon[name]).distinct()
        one = violations(held[name].join(forms, text == F.col("_form")), name, F.col(tuple_id), field, "VALUE", "VALUE_ENTITY", "warn", "another spelling of the same entity", F.col("canon"))
        out = one if out is None else out.unionByName(one)
    if out is None:  # one table alone: nothing to be consistent with
        name, df = next(iter(held.items()))
        out = violations(df.limit(0), name, F.col(tuple_id), field, "VALUE", "VALUE_ENTITY", "warn", "", None)
    return out


def audit(df: DataFrame, ask, table: str) -> DataFrame:
    """A model's audit as a pluggable step: ask maps pandas frames of rows to frames of (tuple_id, attr,
    constraint_type, severity, description, suggested_fix)."""
    made = df.mapInPandas(ask, "tuple_id string, attr string, constraint_type string, severity string, description string, suggested_fix string")
    return violations(made, table, F.col("tuple_id"), F.col("attr"), "LOGIC", "MODEL_AUDIT", "warn", F.col("description"), F.col("suggested_fix"))
