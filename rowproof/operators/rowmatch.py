"""Greedy matching of gold rows with made rows, exactly, from short lists of each gold row's best partners.

Gold rows in order take their most similar unused made row (at least LEAST similar; ties: the smallest).  A
row's similarity is the mean over fields of the cells' similarity, and nearly all pairs of rows are a little
similar, so comparing all pairs of cells as texts would be the product of the tables.  Instead a first walk takes
each row's partner of highest bound from an index of the unused rows (`rowindex.py`): cells of fields with few
values by the scores of all their pairs, numbers of one field by their neighbours, other cells by a bound of their
kinds.  A pick stands if its score, compared exactly afterwards, is its bound, as no other row can then be better.
The rows from the first pick that does not stand are matched by lists:

* distinct contents stand for rows; a content is named by its first row;
* features of cells (kind, number, folded text) give an upper bound of a pair's score by array arithmetic, in
  blocks of contents, equal to the score wherever no two different texts of a field with many values meet;
* each gold content keeps the k made contents of highest bound, and the bound of the best one left out;
* the first of a list are scored exactly, each two different texts once; others go by their bound, and if the
  walk picks one of these, the pick stands if its score turns out to be its bound;
* the walk over a table's lists takes a partner only while it is surely better than anything left out; a row
  whose list does not settle it ends the walk, and the rest asks again, with longer lists, among unused rows.

Lists grow fourfold each round, so a table is settled after a few.  The walk is sequential by definition: one task a
table, over narrow rows sorted outside Python; it holds the numbers of a table's unused rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import shared_table
from .evaluate import LEAST_SIMILARITY, compare, dashed_date, is_truth, row_similarity
from .rowindex import Unused

#: Contents in a block of gold and of made rows; a pair of blocks is one call.  Few blocks of made rows, as each brings lists.
GOLD_BLOCK, MADE_BLOCK = 512, 4096
#: Length of the first lists, and how many of a list are scored exactly before the walk.
LISTED, DEPTH = 256, 8
KINDS = ("null", "numeric", "date", "boolean", "string")
#: Fields with at most so many pairs of different texts have all of them scored beforehand.
PAIRS = 20_000
#: Entries of a list that come to the walk in one row.
PIECE = 256
#: Columns of an array of hashed 2-grams.
GRAMS = 512
#: A table whose made rows fall into more groups is not walked by an index.
GROUPS = 4096


def _code(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind).cast("int") - 1


def _features(c: Column) -> Column:
    """What the bound of a cell needs: kind, number, folded text, and forms of dates and of truth values."""

    def by_kind(kind: Column) -> Column:
        other = F.when(kind == "date", dashed_date(c)).when(kind == "boolean", is_truth(c).cast("string"))
        dated = F.when(kind.isin("date", "boolean"), dashed_date(c))
        parts = {"k": _code(kind), "n": V.normalise_number(c)["value"], "t": F.lower(V.collapse_spaces(c)), "d": F.coalesce(dated, F.lit("")), "x": F.coalesce(other, F.lit(""))}
        return F.named_struct(*(x for name, part in parts.items() for x in (F.lit(name), part)))

    return V.let(V.value_type(c), by_kind)


def _contents(rows: DataFrame, fields: Sequence[str], group: str | None) -> DataFrame:
    """grp, seq, c (the first row with the same cells), v (cells as texts): one row a row."""
    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    cells = F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    own = rows.select(grp.alias("grp"), F.col("_seq").cast("long").alias("seq"), cells.alias("v"))
    first = own.groupBy("grp", "v").agg(F.min("seq").alias("c"))
    return own.join(first, ["grp", "v"]).select("grp", "seq", "c", "v")


def _text_bound(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The most that two texts can score: 1, or, where they share no two letters, what edits leave.

    Every rule by which texts match needs a shared run of two characters, unless a text has none or holds
    no keyword.  Without one, edits spoil all 2-grams of the longer text, two at a time.
    """

    def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = np.zeros((len(texts), GRAMS), np.float32)
        for i, t in enumerate(texts):
            for j in range(len(t) - 1):
                bits[i, hash(t[j : j + 2]) % GRAMS] = 1
        return bits, np.array([len(t) for t in texts]), np.array([len(t) < 2 or not any(c.isascii() and c.isalnum() or "\u4e00" <= c <= "\u9fff" for c in t) for t in texts])

    (x, nx, ox), (y, ny, oy) = grams(a), grams(b)
    longest = np.maximum(np.maximum(nx[:, None], ny[None, :]), 1)
    apart = (x @ y.T == 0) & ~ox[:, None] & ~oy[None, :]
    return np.where(apart, 1 - np.ceil((longest - 1) / 2) / longest, 1.0)


def _few_texts(gold: DataFrame, made: DataFrame, n: int) -> dict[int, dict[tuple[str, str], float]]:
    """Scores of all pairs of texts of the fields that have at most PAIRS of them: {field: {(text, text): score}}."""
    folded = lambda d, i, name: d.select(F.lower(V.collapse_spaces(F.get("v", F.lit(i)))).alias(name)).where(f"{name} <> ''").distinct()
    sizes = [d.agg(*(F.count_distinct(F.get("v", F.lit(i))).alias(f"n{i}") for i in range(n))).first() for d in (gold, made)]
    few = [i for i in range(n) if sizes[0][i] * sizes[1][i] <= PAIRS]
    if not few:
        return {}
    # a bounded product: at most PAIRS rows a field
    pairs = reduce(DataFrame.union, (folded(gold, i, "a").crossJoin(folded(made, i, "b")).select(F.lit(i).alias("i"), "a", "b") for i in few))
    score = V.let(compare(F.col("a"), F.col("b")), lambda c: F.when(c["match"], 1.0).otherwise(c["similarity"]))
    found: dict[int, dict[tuple[str, str], float]] = {i: {} for i in few}
    for r in pairs.where("a <> b").select("i", "a", "b", score.alias("s")).collect():
        found[r["i"]][r["a"], r["b"]] = r["s"]
    return found


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which texts of a are which of b, compared by number."""
    code = pd.factorize(np.concatenate([a, b]))[0]
    return code[: len(a), None] == code[None, len(a) :]


def _largest(ub: np.ndarray, k: int) -> np.ndarray:
    """Which k entries of each row are the largest (ties: the first), all where there are fewer."""
    if ub.shape[1] <= k:
        return np.ones(ub.shape, bool)
    last = np.partition(ub, ub.shape[1] - k, axis=1)[:, [ub.shape[1] - k]]
    above, level = ub > last, ub == last
    return above | level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True))


def _bounds(g: pd.DataFrame, m: pd.DataFrame, few: dict[int, dict[tuple[str, str], float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs: the bound of the score, rounded as scores are; the sum of what is exact; the fields that are not, as bits."""
    known, most, open_ = np.zeros((len(g), len(m))), np.zeros((len(g), len(m))), np.zeros((len(g), len(m)), np.int64)
    for i in range(len(g["f"].iloc[0])):
        a, b = ({k: np.array([r[i][k] for r in side["f"]], float if k in "kn" else object) for k in "kntdx"} for side in (g, m))
        ka, kb = a["k"][:, None], b["k"][None, :]
        either = lambda code: (ka == code) | (kb == code)
        same = lambda k: _equal(a[k], b[k])
        kinds = set(a["k"].tolist()) | set(b["k"].tolist())
        # later kinds give way to earlier ones; only what occurs is computed
        exact = same("x").astype(float) if kinds == {4} or len(kinds) > 1 else np.zeros((len(g), len(m)))
        if 2 in kinds:
            exact = np.where(either(2), same("d"), exact)
        if 1 in kinds:
            e, v = a["n"][:, None], b["n"][None, :]
            with np.errstate(all="ignore"):
                near = np.where(e != 0, np.maximum(0.0, 1 - np.abs(e - v) / np.abs(e)), 0.0)
            number = np.where(np.isnan(e) | np.isnan(v), 0.0, np.where(e == v, 1.0, np.nan_to_num(near, nan=1.0)))
            exact = number if kinds == {1} else np.where(either(1), number, exact)
        if 0 in kinds:
            exact = np.where((ka == 0) & (kb == 0), 1.0, np.where(either(0), 0.0, exact))
        texts = either(4) & ~either(0) & ~either(1)
        bound = exact
        if texts.any():
            alike = same("t").astype(float)
            ta, ia = np.unique(a["t"].astype(str), return_inverse=True)
            tb, ib = np.unique(b["t"].astype(str), return_inverse=True)
            if i in few:
                scores = np.array([[1.0 if x == y else few[i].get((x, y), 0.0) for y in tb] for x in ta])
                bound = exact = np.where(texts, scores[np.ix_(ia, ib)], exact)
            else:
                bound = np.where(texts, np.maximum(_text_bound(ta.tolist(), tb.tolist())[np.ix_(ia, ib)], alike), exact)
                differ = texts & (alike == 0)
                exact = np.where(differ, 0.0, np.where(texts, 1.0, exact))
                open_ |= np.where(differ, 1 << i, 0)
        known, most = known + exact, most + bound
    return np.round(most / len(g["f"].iloc[0]), 9), known, open_


def _lists(gold: DataFrame, made: DataFrame, k: int, least: float, few: dict[int, dict[tuple[str, str], float]]) -> DataFrame:
    """grp, g (content), l (its list: u = -bound, m, known, open), and t, tm: the bound and name of the best content left out."""

    blocks = lambda d, size: d.where("seq = c").groupBy("grp").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    n_gold, n_made = blocks(gold, GOLD_BLOCK), blocks(made, MADE_BLOCK)

    def blocked(rows: DataFrame, own: DataFrame, mine: str, other: DataFrame, theirs: str, name: str) -> DataFrame:
        """Contents with the numbers of their block and of every block of the other side."""
        both = own.withColumnRenamed("n", "own").join(other, "grp")
        some = rows.where("seq = c").join(both, "grp")
        return some.select("grp", F.col("c").alias(name), F.transform("v", _features).alias("f"), F.pmod(F.xxhash64("c"), F.col("own")).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(theirs))

    def top(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if g.empty or m.empty:
            return pd.DataFrame({"grp": [], "g": [], "m": [], "ub": [], "known": [], "open": []})
        m = m.sort_values("m")
        ub, known, open_ = _bounds(g, m, few)
        row, col = np.nonzero(_largest(ub, k + 1) & (ub >= least))  # ties: the smallest
        return pd.DataFrame({"grp": g["grp"].iloc[0], "g": g["g"].to_numpy()[row], "m": m["m"].to_numpy()[col], "ub": ub[row, col], "known": known[row, col], "open": open_[row, col]})

    gs = blocked(gold, n_gold, "gb", n_made, "mb", "g").groupBy("grp", "gb", "mb")
    ms = blocked(made, n_made, "mb", n_gold, "gb", "m").groupBy("grp", "gb", "mb")
    near = gs.cogroup(ms).applyInPandas(top, "grp string, g long, m long, ub double, known double, open long")
    # of all blocks the k best, and the next one
    entry = F.struct((-F.col("ub")).alias("u"), "m", "known", "open")
    listed = near.groupBy("grp", "g").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    rest = F.get("l", F.lit(k))
    return listed.select("grp", "g", F.slice("l", 1, k).alias("l"), (-rest["u"]).alias("t"), rest["m"].alias("tm"))


def _entries(lists: DataFrame, some: Column) -> DataFrame:
    """grp, g, m, known, open of some entries of each list."""
    return lists.select("grp", "g", F.explode(some).alias("e")).select("grp", "g", "e.m", "e.known", "e.open")


def _exact(lists: DataFrame, gold: DataFrame, made: DataFrame, n: int) -> DataFrame:
    """grp, g, m, score of listed pairs of contents: each two different texts are compared once."""
    cells = lambda d, k, p: d.where("seq = c").select("grp", F.col("c").alias(k), F.col("v").alias(p))
    field = F.explode(F.array(*(F.when(F.shiftright("open", i).bitwiseAND(F.lit(1)) == 1, F.lit(i)) for i in range(n))))
    some = lists.select("grp", "g", "m", field.alias("i")).where("i is not null")
    some = some.join(cells(gold, "g", "a"), ["grp", "g"]).join(cells(made, "m", "b"), ["grp", "m"])
    texts = some.select("grp", "g", "m", F.get("a", F.col("i")).alias("a"), F.get("b", F.col("i")).alias("b"))
    pairs = texts.select("a", "b").distinct()
    met = pairs.select("a", "b", V.let(compare(F.col("a"), F.col("b")), lambda c: F.when(c["match"], 1.0).otherwise(c["similarity"])).alias("s"))
    sums = texts.join(met, ["a", "b"]).groupBy("grp", "g", "m").agg(F.sum("s").alias("s"))
    return lists.join(sums, ["grp", "g", "m"]).select("grp", "g", "m", F.round((F.col("known") + F.col("s")) / n, 9).alias("score"))


def _scored(lists: DataFrame, gold: DataFrame, made: DataFrame, n: int, depth: int, least: float) -> DataFrame:
    """Lists of c, s, sure: pairs that hold no two different texts, and the first depth of a list, are exact, others bounds."""
    exact = _exact(_entries(lists, F.slice("l", 1, depth)).where("open <> 0"), gold, made, n)
    exact = exact.groupBy("grp", "g").agg(F.map_from_entries(F.collect_list(F.struct("m", "score"))).alias("exact"))

    def entry(e: Column) -> Column:
        met = F.try_element_at("exact", e["m"])
        return F.struct(e["m"].alias("c"), F.coalesce(met, -e["u"]).alias("s"), (met.isNotNull() | (e["open"] == 0)).alias("sure"))

    scored = F.filter(F.transform("l", entry), lambda e: e["s"] >= least)
    return lists.join(exact, ["grp", "g"], "left").select("grp", "g", scored.alias("l"), "t", "tm")


def _verified(picks: DataFrame, lists: DataFrame, gold: DataFrame, made: DataFrame, n: int) -> DataFrame:
    """The picks up to the first of a table whose score is less than the bound it was picked by."""
    unsure = picks.where("not sure")
    picked = lists.join(unsure.select("grp", F.col("gc").alias("g"), F.col("mc").alias("_m")).distinct(), ["grp", "g"])
    exact = _exact(_entries(picked, F.filter("l", lambda e: e["m"] == F.col("_m"))), gold, made, n).select("grp", F.col("g").alias("gc"), F.col("m").alias("mc"), F.col("score").alias("exact"))
    wrong = unsure.join(exact, ["grp", "gc", "mc"]).where("exact < score").groupBy("grp").agg(F.min("g").alias("wrong"))
    return picks.join(wrong, "grp", "left").where("wrong is null or g < wrong").select("grp", "g", "m", "score")


def _walk(scored: DataFrame, gold: DataFrame, made: DataFrame) -> DataFrame:
    """grp, g, m, score, sure, gc, mc (contents) of settled gold rows (m null: no partner), up to the first of a table that is not."""
    columns = ["grp", "g", "m", "score", "sure", "gc", "mc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, waiting, gone = object(), {}, {}
        row, content, entries, bound, stopped = None, None, [], None, False
        out = []

        def settle() -> None:
            nonlocal stopped
            if row is None or stopped:
                return
            best = min(((-s, waiting[c][gone[c]], c, sure) for s, c, sure in entries if gone[c] < len(waiting[c])), default=None)
            if bound is not None and (best is None or best[:2] > bound):
                stopped = True  # one that was left out may be the better one
            elif best is None:
                out.append((table, row, None, None, True, content, None))
            else:
                gone[best[2]] += 1
                out.append((table, row, best[1], -best[0], best[3], content, best[2]))

        def emitted() -> pd.DataFrame:
            part = pd.DataFrame(out, columns=columns).astype({"m": "Int64", "mc": "Int64", "sure": bool})
            out.clear()
            return part

        for part in batches:
            for grp, kind, g, gc, _, m, c, s, sure, t, tm in part.itertuples(index=False, name=None):
                if grp != table:
                    settle()
                    table, waiting, gone, row, stopped = grp, {}, {}, None, False
                if kind == 0:
                    waiting.setdefault(gc, []).append(m)
                    gone[gc] = 0
                    continue
                if g != row:
                    settle()
                    row, content, entries, bound = g, gc, [], None
                entries += zip(s.tolist(), c.tolist(), sure.tolist())
                if not np.isnan(t):
                    bound = (-t, tm)
            yield emitted()
        settle()
        yield emitted()

    none = F.lit(None).cast("double")
    no = F.lit(-1).cast("long")
    lists = {"c": "array<long>", "s": "array<double>", "sure": "array<boolean>"}
    empty = [F.array().cast(t).alias(name) for name, t in lists.items()]
    rows = made.select("grp", F.lit(0).alias("kind"), no.alias("g"), F.col("c").alias("gc"), F.lit(0).alias("piece"), F.col("seq").alias("m"), *empty, none.alias("t"), no.alias("tm"))
    asked = gold.select("grp", "seq", F.col("c").alias("g")).join(scored, ["grp", "g"], "left")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("l") - 1) / PIECE).cast("int"))), lambda i: F.slice("l", i * PIECE + 1, PIECE))
    asked = asked.withColumn("l", F.coalesce("l", F.array().cast("array<struct<c:long,s:double,sure:boolean>>"))).select("*", F.posexplode(pieces).alias("piece", "part"))
    parts = [F.col(f"part.{name}").alias(name) for name in lists]
    asked = asked.select("grp", F.lit(1).alias("kind"), F.col("seq").alias("g"), F.col("g").alias("gc"), "piece", no.alias("m"), *parts, "t", F.coalesce("tm", no).alias("tm"))
    ordered = rows.unionByName(asked).repartition("grp").sortWithinPartitions("grp", "kind", "g", "piece", "m")
    return ordered.mapInPandas(run, "grp string, g long, m long, score double, sure boolean, gc long, mc long")


def _few_cells(gold: DataFrame, made: DataFrame, n: int) -> tuple[dict[int, dict[tuple[str, str], float]], int | None]:
    """Scores of all pairs of cells of the fields that have at most PAIRS of them; of the others, the one with most numbers."""
    cell = lambda i: F.get("v", F.lit(i))
    counts = [F.count_distinct(cell(i)).alias(f"n{i}") for i in range(n)] + [F.count_if(V.value_type(cell(i)) == "numeric").alias(f"c{i}") for i in range(n)]
    sizes = [d.agg(*counts).first() for d in (gold, made)]
    few = {i: {} for i in range(n) if sizes[0][f"n{i}"] * sizes[1][f"n{i}"] <= PAIRS}
    if few:
        # a bounded product: at most PAIRS rows a field
        pairs = reduce(DataFrame.union, (gold.select(cell(i).alias("a")).distinct().crossJoin(made.select(cell(i).alias("b")).distinct()).select(F.lit(i).alias("i"), "a", "b") for i in few))
        for r in pairs.select("i", "a", "b", row_similarity([(F.col("a"), F.col("b"))]).alias("s")).collect():
            few[r["i"]][r["a"], r["b"]] = r["s"]
        few = {i: scores for i, scores in few.items() if np.isfinite(list(scores.values())).all()}  # infinite numbers have no score
    numbers = {i: sizes[1][f"c{i}"] for i in range(n) if i not in few and sizes[1][f"c{i}"]}
    return few, max(numbers, key=numbers.get, default=None)


def _indexed(gold: DataFrame, made: DataFrame, n: int, least: float) -> DataFrame:
    """grp, g, m, score (its bound) of gold rows in order (m null: no partner), from an index of each table's unused made rows."""
    few, by = _few_cells(gold, made, n)
    many = [i for i in range(n) if i not in few]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, unused, stopped = object(), None, False
        for part in batches:
            out = []
            for grp, kind, seq, cells, kinds, x in part.itertuples(index=False, name=None):
                if grp != table:
                    table, unused, stopped = grp, Unused(few, many, by), False
                cells, kinds = tuple(cells), tuple(kinds)
                if stopped:
                    continue
                if kind == 0:
                    unused.add(seq, cells, kinds, x)
                    stopped = unused.odd or len(unused.groups) > GROUPS
                    continue
                if by is not None and not kinds[many.index(by)] & 1 and not np.isfinite(x):
                    stopped = True  # no number that can be sorted
                    continue
                best = unused.take(cells, kinds, x, least)
                out.append((grp, seq, best[1] if best else None, best[0] if best else None))
            yield pd.DataFrame(out, columns=["grp", "g", "m", "score"]).astype({"m": "Int64"})

    def narrow(rows: DataFrame, kind: int) -> DataFrame:
        number = lambda i: V.normalise_number(F.get("v", F.lit(i)))["value"]
        kinds = [_code(V.value_type(F.get("v", F.lit(i)))) * 2 + number(i).isNull().cast("int") for i in many]
        x = F.lit(None).cast("double") if by is None else number(by)
        return rows.select("grp", F.lit(kind).alias("kind"), "seq", F.array(*(F.get("v", F.lit(i)) for i in few)).cast("array<string>").alias("cells"), F.array(*kinds).cast("array<int>").alias("kinds"), x.alias("x"))

    ordered = narrow(made, 0).unionByName(narrow(gold, 1)).repartition("grp").sortWithinPartitions("grp", "kind", "seq")
    return ordered.mapInPandas(run, "grp string, g long, m long, score double")


def _stand(picks: DataFrame, gold: DataFrame, made: DataFrame, n: int) -> DataFrame:
    """The picks up to the first of a table whose score is not the bound it was picked by."""
    cells = lambda d, k, v: d.select("grp", F.col("seq").alias(k), F.col("v").alias(v))
    both = picks.where("m is not null").join(cells(gold, "g", "a"), ["grp", "g"]).join(cells(made, "m", "b"), ["grp", "m"])
    both = both.repartition(both.sparkSession.sparkContext.defaultParallelism, "g")  # few bytes, much work
    exact = F.round(row_similarity([(F.get("a", F.lit(i)), F.get("b", F.lit(i))) for i in range(n)]), 9)
    wrong = both.where(exact != F.col("score")).groupBy("grp").agg(F.min("g").alias("wrong"))
    return picks.join(wrong, "grp", "left").where("wrong is null or g < wrong").select("grp", "g", "m", "score")


def match_rows(gold: DataFrame, made: DataFrame, fields: Sequence[str], group: str | None = None, least: float = LEAST_SIMILARITY, listed: int = LISTED) -> DataFrame:
    """(grp, g, m, score): gold rows in order take their best unused made row; columns _seq (unique) and fields.

    Null and empty cells are alike.  A table without gold or without made rows has no matches; a null group
    is the table ''.
    """
    if not fields:
        raise ValueError("rows without common fields cannot be matched")
    gold, made = (shared_table(_contents(d, fields, group), "match-rows") for d in (gold, made))
    n, depth = len(fields), DEPTH
    done = shared_table(_stand(shared_table(_indexed(gold, made, n, least), "match-index"), gold, made, n), "match-done")
    found, few = [done], None
    while True:
        gold = _left(gold, done.select("grp", F.col("g").alias("seq")))
        if not gold.head(1):
            return reduce(DataFrame.union, found).where("m is not null")
        made = _left(made, done.where("m is not null").select("grp", F.col("m").alias("seq")))
        few = _few_texts(gold, made, n) if few is None else few
        lists = shared_table(_lists(gold, made, listed, least, few), "match-lists")
        picks = shared_table(_walk(_scored(lists, gold, made, n, depth, least), gold, made), "match-walk")
        done = shared_table(_verified(picks, lists, gold, made, n), "match-done")
        found.append(done)
        listed, depth = listed * 4, depth * 4


def _left(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The rows that are left; contents are named by the first of them."""
    some = rows.join(used, ["grp", "seq"], "left_anti")
    first = some.groupBy("grp", F.col("c").alias("old")).agg(F.min("seq").alias("c"))
    return shared_table(some.withColumnRenamed("c", "old").join(first, ["grp", "old"]).select("grp", "seq", "c", "v"), "match-left")
