"""Documents: chunks, batches, boundaries, spans, segments."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import values as V
from ..functions.empties import strip
from ..functions.values import word_estimate
from ..sources.numbering import with_row_number, with_running_total
from .matching import containing
from .merge import number_batches

# Sizes of chunks and batches.
CHUNK, OVERLAP, BATCH_WORDS, BATCH_CHARS, LOCATE_WORDS = 100_000, 500, 50_000, 100_000, 30_000
SENTENCE_ENDS = "。！？.!?"
#: Documents packed by one task.
SHARD_DOCS = 100_000
#: Bytes of texts that Python cuts at once.
HELD_BYTES = 2**20


def chunk_bounds(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ends at the last blank line past the middle, else after the last sentence end past it, else at size."""
    if overlap >= size // 2:
        raise ValueError("the overlap must be under half a chunk, or chunks would not advance")
    bounds, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            return [*bounds, (start, len(text))]
        middle = start + size // 2
        if (at := text.rfind("\n\n", start, end)) > middle:
            end = at + 2
        elif (at := max(text.rfind(c, start, end) for c in SENTENCE_ENDS)) > middle:
            end = at + 1
        bounds.append((start, end))
        if end >= len(text):
            return bounds
        start = end - overlap


def chunks(docs: DataFrame, id_col: str, text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """One row a chunk: id, columns to keep, idx, start, stop, chunk.  Bounds come from Python, the texts are cut by Spark.

    Works on streams as well; a null text is one empty chunk.
    """

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def bounds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b} for a, b in chunk_bounds(t, size, overlap)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.when(F.length(text) <= size, F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("stop")))).otherwise(bounds(text))
    rows = docs.select(F.col(id_col), *keep, text.alias("_t"), F.posexplode(cut).alias("idx", "b"))
    return rows.select(id_col, *keep, "idx", "b.start", "b.stop", F.substring(F.col("_t"), F.col("b.start") + 1, F.col("b.stop") - F.col("b.start")).alias("chunk"))


def split_paragraphs(text: str, words: int = BATCH_WORDS, chars: int = BATCH_CHARS) -> list[str]:
    """Parts within both limits made of whole paragraphs; a part begins with the last tenth of the one before."""
    import re

    parts, now = [], []
    size = lambda ps: (sum(len(re.findall(r"[一-龥]|[a-zA-Z]+", p)) for p in ps), sum(map(len, ps)))
    for p in re.split(r"\n\s*\n", text):
        w, c = size([*now, p])
        if now and (w > words or c > chars):
            parts.append("\n\n".join(now))
            back = max(1, len(now) // 10)
            tail = now[-back:]
            now = tail if size([*tail, p])[1] <= chars and size([*tail, p])[0] <= words else []
        now.append(p)
    return [*parts, "\n\n".join(now)] if now else parts


def _successors(w: np.ndarray, c: np.ndarray, words: int, chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch that begins at each document, where the next one begins; and the sizes before each document.

    A batch takes documents up to its first one of any size, whatever that is, then while both limits hold.
    """
    before_w, before_c = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(c)])
    n = len(w)
    fits = np.minimum(np.searchsorted(before_w[1:], before_w[:-1] + words, "right"), np.searchsorted(before_c[1:], before_c[:-1] + chars, "right"))
    sized = np.where((w > 0) | (c > 0), np.arange(n), n)
    first = np.minimum.accumulate(sized[::-1])[::-1]
    return np.minimum(np.maximum(fits, first + 1), n), before_w, before_c


def batches(docs: DataFrame, id_col: str, order: str, text_col: str = "text", words: int = BATCH_WORDS, chars: int = BATCH_CHARS, shard: int = SHARD_DOCS) -> DataFrame:
    """id, batch: documents in order, a new batch wherever both limits would not hold.

    The packing is sequential by definition.  Documents (only their sizes) are dealt into shards of consecutive
    ones.  The batch that is open where a shard begins takes some of its first documents; for every number of
    them that can occur, the shard's task reports how many batches follow and what is open at its end, all from
    one backward pass over the places where the next batch would begin.  An open batch ends at a document of
    some size, so a shard reports at most as many rows as sized documents go into one batch, however many
    empty ones there are.  The driver walks from shard to shard over these reports, and a second pass numbers
    the batches.  Time is linear in the documents.
    """
    sized = docs.select(id_col, F.col(order).alias("_o"), word_estimate(F.coalesce(F.col(text_col), F.lit(""))).alias("w"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("c"))
    rows = with_row_number(sized, "_o").withColumn("_s", F.floor(F.col("_row") / shard).cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["_s", "entry", "n", "a", "b", "w", "c", "before_w", "before_c", "size"]

    def report(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        w, c = part["w"].to_numpy(), part["c"].to_numpy()
        size, (successor, before_w, before_c) = len(w), _successors(w, c, words, chars)
        count, last = [0] * (size + 1), [size] * (size + 1)  # batches from here on, and where the last begins
        for i, j in zip(range(size - 1, -1, -1), successor[::-1].tolist()):
            count[i], last[i] = count[j] + 1, i if j == size else last[j]
        most = int(successor[0])  # an open batch takes at most as many as an empty one
        some = np.flatnonzero((w[: most + 1] > 0) | (c[: most + 1] > 0))
        entries = sorted({0, most, *some.tolist(), *(some[:1] + 1).tolist()} - set(range(most + 1, size + 2)))
        full = lambda x, e: int(x[e]) if e < size else 0
        out = [(part["_s"].iloc[0], e, count[e], int(before_w[-1] - before_w[last[e]]), int(before_c[-1] - before_c[last[e]]), full(w, e), full(c, e), int(before_w[e]), int(before_c[e]), size) for e in entries]
        return pd.DataFrame(out, columns=columns)

    reports = rows.groupBy("_s").applyInPandas(report, ", ".join(f"{c} long" for c in columns))
    plan, a, b, base, now, entries = [], 0, 0, 0, None, []

    def walked() -> None:
        """One shard: where its first new batch begins, and the number of the batch that is open before."""
        nonlocal a, b, base
        size = entries[0]["size"]
        for r in entries:
            x, y = a + r["before_w"], b + r["before_c"]
            if r["entry"] < size and (x or y) and (x + r["w"] > words or y + r["c"] > chars):
                break
        else:  # all documents go into the open batch
            r = None
        k = r["entry"] if r else size
        plan.append((now, k, max(base, 1)))
        if r:
            base = max(base, 1) if k else base
            base, a, b = base + r["n"], r["a"], r["b"]
        else:
            base, a, b = max(base, 1), a + entries[0]["total_w"], b + entries[0]["total_c"]

    totals = rows.groupBy("_s").agg(F.sum("w").alias("total_w"), F.sum("c").alias("total_c"))
    for r in reports.join(totals, "_s").orderBy("_s", "entry").toLocalIterator():
        if r["_s"] != now and now is not None:
            walked()
            entries = []
        now = r["_s"]
        entries.append(r)
    if now is not None:
        walked()

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        k, open_batch = int(part["_k"].iloc[0]), int(part["_n"].iloc[0])
        successor = _successors(part["w"].to_numpy(), part["c"].to_numpy(), words, chars)[0].tolist()
        starts, at = [], k
        while at < len(successor):
            starts.append(at)
            at = successor[at]
        before = open_batch if k or part["_s"].iloc[0] else 0
        place = np.searchsorted(np.array(starts, dtype="int64"), np.arange(len(part)), "right")
        return pd.DataFrame({id_col: part[id_col], "batch": np.where(np.arange(len(part)) < k, open_batch, before + place)})

    if not plan:
        return docs.select(id_col, F.lit(None).cast("long").alias("batch")).limit(0)
    places = docs.sparkSession.createDataFrame(plan, "_s long, _k long, _n long")
    return rows.join(F.broadcast(places), "_s").groupBy("_s").applyInPandas(number, f"{id_col} {kind}, batch long")


def merge_texts(docs: DataFrame, name: str, text_col: str, order: str, group: str) -> DataFrame:
    """One text a group: documents in order, each under a banner with its name."""
    body = F.concat(F.lit("=== "), F.col(name).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(text_col), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(order, body.alias("b"))))
    return docs.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("text"))


def boundaries(docs: DataFrame, name: str, order: str, text_col: str = "text", separator: int = 2, group: str | None = None) -> DataFrame:
    """name, start, stop, length of each document in the concatenation (of its group; without one, of all).

    Without a group the running sum goes over range partitions and their totals, with one over its documents.
    """
    length = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    sized = docs.select(*([group] if group else []), name, F.col(order).alias("_o"), length.alias("length"), (length + separator).alias("_step"))
    if group:
        w = Window.partitionBy(group).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
        rows = sized.withColumn("start", F.coalesce(F.sum("_step").over(w), F.lit(0)).cast("long"))
    else:
        rows = with_running_total(sized, "_o", "_step", "start").withColumn("start", F.col("start").cast("long"))
    return rows.withColumn("stop", F.col("start") + F.col("length")).select(*([group] if group else []), name, "start", "stop", "length")


def needs_location(docs: DataFrame, text_col: str = "text", words: int = LOCATE_WORDS) -> DataFrame:
    return docs.where(word_estimate(F.coalesce(F.col(text_col), F.lit(""))) > words)


# What shows, in a span's first 200 characters, that the prompt was copied.
PROMPT_MARKS = ("=== 目标表格信息", "=== 任务要求", "=== 文档内容", "=== 输出要求", "字段定义:", "relevance_score")


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", " ")


def _loosely(span: Column) -> Column:
    """A pattern for the span in any case and with any white space where it has some."""
    words = F.transform(F.split(span, r"\s+"), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iu)"), F.array_join(words, "\\s+"))


def span_position(text: Column, span: Column, anchor: int = 100, least: int = 21) -> Column:
    """struct(start, stop) in the text as it is: exact, else stripped, else in any case and white space, else by
    the span's first characters (if it has at least least), else the whole text.

    The first occurrence counts.  A place by first characters is as long as the span, or ends with the text.
    """
    bare = strip(span)
    whole = F.struct(F.lit(0).alias("start"), F.length(text).alias("stop"))
    found = lambda at, n: F.struct((at - 1).cast("int").alias("start"), F.least(at - 1 + n, F.length(text)).cast("int").alias("stop"))

    def loose(pattern: Column, size: Column | None, otherwise: Column) -> Column:
        hit = lambda p: F.when(p["at"] > 0, found(p["at"], F.length(p["hit"]) if size is None else size)).otherwise(otherwise)
        return V.let(F.struct(F.regexp_instr(text, pattern).alias("at"), F.call_function("regexp_extract", text, pattern, F.lit(0)).alias("hit")), hit)

    by_head = F.when(F.length(bare) >= least, loose(_loosely(F.substring(bare, 1, anchor)), F.length(bare), whole)).otherwise(whole)
    return (
        F.when(bare == "", whole).when(F.contains(text, span), found(F.instr(text, span), F.length(span)))
        .when(F.contains(text, bare), found(F.instr(text, bare), F.length(bare))).otherwise(loose(_loosely(bare), None, by_head))
    )


def span_valid(text: Column, span: Column, anchor: int = 100, short: int = 30) -> Column:
    """The span occurs in the text, up to case and white space; a span of at least short characters need only
    begin so, with its first anchor characters.  A span that begins with marks of the prompt is refused, an empty one too.
    """
    bare = strip(span)
    marked = F.exists(F.array(*(F.lit(m) for m in PROMPT_MARKS)), lambda m: F.contains(F.substring(span, 1, 200), m))
    folded = _folded(bare)
    wanted = F.when(F.length(folded) < short, folded).otherwise(F.substring(folded, 1, anchor))
    return F.coalesce((bare != "") & ~marked & (F.contains(text, bare) | F.contains(_folded(text), wanted)), F.lit(False))


def segment_source(segments: DataFrame, bounds: DataFrame, group: str) -> DataFrame:
    """Segments with the document whose [start, stop) holds their start; both sides share a group.

    An interval is keyed by its level, the least power of two that is as long, and by the one or two blocks of
    that width which it touches; a start meets, at each level that occurs, the intervals of its own block.
    Disjoint intervals are at most three in a block, whatever a group's size; overlapping ones are all found.
    """
    start = F.col("start").cast("long")
    b = bounds.where("start < stop").select(F.col(group).alias("_g"), F.col("start").cast("long").alias("_s"), F.col("stop").cast("long").alias("_e"), F.col("name").alias("source"))
    # the binary digits of length - 1
    b = b.withColumn("_l", F.when(F.col("_e") - F.col("_s") == 1, 0).otherwise(F.length(F.bin(F.col("_e") - F.col("_s") - 1))))
    block = lambda c: F.call_function("shiftright", c, F.col("_l"))
    b = b.withColumn("_b", F.explode(F.sequence(block(F.col("_s")), block(F.col("_e") - 1))))
    levels = sorted(r["_l"] for r in b.select("_l").distinct().collect())  # at most 64 numbers
    at = segments.select(F.col(group).alias("_g"), start.alias("_at")).where("_g is not null and _at is not null").distinct()
    at = at.select("_g", "_at", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_l")).withColumn("_b", block(F.col("_at")))
    held = at.join(b, ["_g", "_l", "_b"]).where("_s <= _at and _at < _e").select("_g", "_at", "source")
    return segments.join(held, (F.col(group) == F.col("_g")) & (start == F.col("_at")), "left").drop("_g", "_at")


def too_vague(segments: DataFrame, group: str, most: float = 0.5) -> DataFrame:
    """Groups of which over half the segments are whole texts (start 0, stop = length)."""
    whole = F.avg(((F.col("start") == 0) & (F.col("stop") == F.col("length"))).cast("int"))
    return segments.groupBy(group).agg(whole.alias("share")).where(F.col("share") > most)


def merge_segments(segments: DataFrame, group: str) -> DataFrame:
    """One text a group: by relevance, then place (unknown places last), under headers, between rules."""
    place = F.when(F.col("start") < 0, F.lit(2**62)).otherwise(F.col("start").cast("long"))
    body = F.concat(F.lit("[relevance "), F.format_string("%.2f", F.col("relevance")), F.lit("]\n"), F.col("content"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), place.alias("p"), body.alias("b"))))
    return segments.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n" + "=" * 80 + "\n").alias("text"))


def segment_stats(segments: DataFrame, group: str) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    r = F.col("relevance")
    return segments.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.round(F.avg(r), 6).alias("relevance"), n(r >= 0.8).alias("high"), n((r >= 0.5) & (r < 0.8)).alias("medium"), n(r < 0.5).alias("low"))


def evidence_documents(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """(evidence, name) where one's base name holds the other, in any case; empty base names match nothing."""
    low = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]+)$", 1))
    e = evidence.select("evidence", low(F.col("evidence")).alias("a")).where("a <> ''").distinct()
    d = names.select("name", low(F.col("name")).alias("b")).where("b <> ''").distinct()
    held = containing(e.select(F.col("a").alias("value")), d.select(F.col("b").alias("value")))
    pairs = held.select(F.col("longer").alias("a"), F.col("shorter").alias("b"))
    held = containing(d.select(F.col("b").alias("value")), e.select(F.col("a").alias("value")))
    pairs = pairs.union(held.select(F.col("shorter").alias("a"), F.col("longer").alias("b"))).distinct()
    return pairs.join(e, "a").join(d, "b").select("evidence", "name").distinct()


def filter_documents(docs: DataFrame, name: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    has = lambda ps: F.exists(F.array(*(F.lit(p) for p in ps)), lambda p: F.contains(F.col(name), p))
    out = docs.where(has(include)) if include else docs
    return out.where(~has(exclude)) if exclude else out


def entity_chunks(spans: DataFrame, most: int = 10, chars: int = 800) -> DataFrame:
    """entity, chunk, n: the first chunks of an entity, each cut to a length (a report feature)."""
    w = Window.partitionBy("entity").orderBy("ord")
    return spans.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= most).select("entity", F.substring("chunk", 1, chars).alias("chunk"), "n")


def map_extract(docs: DataFrame, extract, schema: str) -> DataFrame:
    """Runs an injected extractor (iterator of pandas frames -> iterator of pandas frames) over documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from extract(parts)

    return docs.mapInPandas(run, schema)


def map_warm(docs: DataFrame, snapshot: DataFrame, violations: DataFrame, anchor: str, extract, schema: str) -> DataFrame:
    """Runs an injected extractor again, warm: with what it extracted before and what was found wrong with it.

    extract(documents, rows, violations), three pandas frames of one anchor (such as an entity's id), gives the
    anchor's new rows.  All three sides have the column anchor.  Anchors without documents keep out: there is
    nothing to read again; those without earlier rows or violations get empty frames (a cold start).
    """
    tagged = lambda df, kind: df.select(anchor, F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
    columns = {"row": snapshot.columns, "violation": violations.columns}
    told = tagged(snapshot, "row").union(tagged(violations, "violation")).join(docs.select(anchor).distinct(), anchor, "left_semi")

    def run(own: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        frames = (pd.DataFrame(list(map(json.loads, earlier["json"][earlier["kind"] == k])), columns=names) for k, names in columns.items())
        return extract(own, *frames)

    return docs.groupBy(anchor).cogroup(told.groupBy(anchor)).applyInPandas(run, schema)


def map_relations(anchors: DataFrame, key: str, extract, schema: str, size: int = 20) -> DataFrame:
    """Runs an injected relation extractor on anchored batches: a pandas frame of size anchors (or fewer) at a time.

    anchors: rows of entities with the texts that go with them; key puts them in order.  Every call sees one
    batch whole, in order, with its number in the column batch.
    """
    numbered = number_batches(anchors, key, size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return extract(part.sort_values(key).reset_index(drop=True))

    return numbered.groupBy("batch").applyInPandas(run, schema)


def _cut(batches: Iterator[pa.RecordBatch], words: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of the texts of (_id, _t), a batch for at most HELD_BYTES of texts or for one."""
    for b in batches:
        sizes, at = pc.binary_length(b.column(1)).to_pylist(), 0
        while at < b.num_rows:
            n, held = 1, sizes[at]
            while at + n < b.num_rows and held + sizes[at + n] <= HELD_BYTES:
                held += sizes[at + n]
                n += 1
            parts = [split_paragraphs(t.as_py(), words, chars) or [""] for t in b.column(1).slice(at, n)]
            ids = b.column(0).take(pa.array([at + i for i, ps in enumerate(parts) for _ in ps], pa.int64()))
            places = pa.array([k for ps in parts for k in range(len(ps))], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, places, pa.array([p for ps in parts for p in ps], pa.string())], names=["_id", "part", "text"])
            at += n


def split_long(docs: DataFrame, id_col: str, text_col: str = "text", words: int = BATCH_WORDS, chars: int = BATCH_CHARS) -> DataFrame:
    """id, part, text: documents over a limit in parts of whole paragraphs, others as they are.

    A task's Python holds an Arrow batch (64 MB by Spark's default) and the parts of HELD_BYTES of its texts, or of one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = (word_estimate(text) > words) | (F.length(text) > chars)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), long.alias("_long"))
    kind = docs.schema[id_col].dataType
    out = StructType([StructField("_id", kind), StructField("part", IntegerType()), StructField("text", StringType())])
    parts = rows.where("_long").select("_id", "_t").mapInArrow(lambda batches: _cut(batches, words, chars), out)
    whole = rows.where("not _long").select("_id", F.lit(0).alias("part"), F.col("_t").alias("text"))
    return whole.unionByName(parts).withColumnRenamed("_id", id_col)
