"""Queries of the document operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import documents as D
from .base import frame, query, table


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) - length(replace(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' ', '')) + 1 - CASE WHEN regexp_matches(text, '^[^a-zA-Z]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(text, '[^a-zA-Z]$') OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS words FROM documents")
def doc_word_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", V.word_estimate(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'zh' ELSE 'en' END AS language FROM documents")
def doc_language(spark, d):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.repeat(F.lit("本文介绍数据"), F.length("text")), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", V.language(text).alias("language"))


@query("SELECT source, doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS length FROM documents")
def doc_boundaries(spark, d):
    return D.boundaries(table(spark, d, "documents"), "doc_id", "doc_id", group="source").select("source", "doc_id", "start", "length")


SPANS = "SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 11, 40) WHEN doc_id % 3 = 1 THEN 'no such span' ELSE '' END AS span FROM {documents}"


@query(f"SELECT doc_id, CAST(CASE WHEN span <> '' AND contains(text, span) THEN instr(text, span) - 1 ELSE 0 END AS INT) AS start, CAST(CASE WHEN span <> '' AND contains(text, span) THEN instr(text, span) - 1 + length(span) ELSE length(text) END AS INT) AS stop FROM ({SPANS}) q")
def doc_locate_span(spark, d):
    return frame(spark, d, SPANS).select("doc_id", D.span_position(F.col("text"), F.col("span")).alias("p")).select("doc_id", "p.start", "p.stop")


@query(f"SELECT doc_id, span <> '' AND contains(text, span) AS valid FROM ({SPANS}) q")
def doc_validate_span(spark, d):
    return frame(spark, d, SPANS).select("doc_id", D.span_valid(F.col("text"), F.col("span")).alias("valid"))


# spans in capitals with doubled blanks, beginnings of spans, and spans after a mark of the prompt
VARIANTS = """SELECT doc_id, text, raw, CASE WHEN doc_id % 5 = 0 THEN concat('relevance_score ', raw) WHEN doc_id % 5 = 1 THEN concat(' ', raw, '  @@@ ~~~') WHEN doc_id % 5 = 2 THEN 'zzz no such span in here zzz' ELSE upper(replace(raw, ' ', '  ')) END AS span
FROM (SELECT doc_id, text, trim(substr(text, 11, 140)) AS raw FROM {documents}) q WHERE length(raw) >= 110 AND NOT contains(raw, chr(10)) AND NOT contains(raw, '  ') AND NOT contains(raw, 'ß')"""


@query(f"""SELECT doc_id, doc_id % 5 NOT IN (0, 2) AS valid, CASE WHEN doc_id % 5 IN (0, 2) THEN 0 ELSE instr(lower(text), lower(CASE WHEN doc_id % 5 = 1 THEN substr(raw, 1, 100) ELSE raw END)) - 1 END AS start,
CASE WHEN doc_id % 5 IN (0, 2) THEN length(text) WHEN doc_id % 5 = 1 THEN least(instr(lower(text), lower(substr(raw, 1, 100))) - 1 + length(trim(span)), length(text)) ELSE instr(lower(text), lower(raw)) - 1 + length(raw) END AS stop FROM ({VARIANTS}) q""", start="INT", stop="INT")
def doc_span_variants(spark, d):
    """Spans that differ from the text in case and white space, with their true places."""
    v = frame(spark, d, VARIANTS)
    at = v.select("doc_id", D.span_valid(F.col("text"), F.col("span")).alias("valid"), D.span_position(F.col("text"), F.col("span")).alias("p"))
    return at.select("doc_id", "valid", "p.start", "p.stop")


BOUNDS = "SELECT source, CAST(doc_id AS STRING) AS name, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS n FROM {documents}"


@query(f"WITH b AS ({BOUNDS}), s AS (SELECT source, doc_id AS seg, CAST(doc_id * 17 AS BIGINT) AS start FROM documents) SELECT s.source AS src, seg, s.start, b.name AS document FROM s LEFT JOIN b ON s.source = b.source AND s.start >= b.start AND s.start < b.start + b.n")
def doc_segment_source(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "src")  # a null text takes no place
    bounds = D.boundaries(docs.where("text is not null").withColumn("name", F.col("doc_id").cast("string")), "name", "doc_id", group="src")  # sorts lengths, not texts
    seg = docs.select("src", F.col("doc_id").alias("seg"), (F.col("doc_id") * 17).alias("start"))
    return D.segment_source(seg, bounds, "src").select("src", "seg", "start", F.col("source").alias("document"))


# a chunk ends after the last blank line past its middle, else after the last sentence end there, else at its size
_PART = "substr(text, start + 1, 2000)"
_BLANK = f"(CASE WHEN instr(reverse({_PART}), chr(10) || chr(10)) > 0 THEN 2000 - instr(reverse({_PART}), chr(10) || chr(10)) - 1 ELSE -1 END)"
_STOP = f"CASE WHEN length(text) <= start + 2000 THEN length(text) WHEN {_BLANK} > 1000 THEN start + {_BLANK} + 2 WHEN 1999 - length(regexp_extract({_PART}, '[^。！？.!?]*$')) > 1000 THEN start + 2000 - length(regexp_extract({_PART}, '[^。！？.!?]*$')) ELSE start + 2000 END"


CHUNKS_SQL = f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS idx, CAST(0 AS BIGINT) AS start, CAST({_STOP.replace('start', '0')} AS BIGINT) AS stop FROM documents
UNION ALL SELECT doc_id, text, idx, start, CAST({_STOP} AS BIGINT) FROM (SELECT doc_id, text, idx + 1 AS idx, stop - 100 AS start FROM c WHERE stop < length(text)) n)
SELECT doc_id, CAST(idx AS INT) AS idx, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, substr(text, start + 1, stop - start) AS chunk FROM c"""


@query(CHUNKS_SQL)
def doc_chunk(spark, d):
    return D.chunks(table(spark, d, "documents"), "doc_id", size=2000, overlap=100)


_FITS = "NOT ((b.w > 0 OR b.c > 0) AND (b.w + d.w > 5000 OR b.c + d.c > 20000))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, CAST(len(regexp_extract_all(text, '[a-zA-Z]+')) AS BIGINT) AS w, CAST(length(text) AS BIGINT) AS c FROM documents),
b AS (SELECT doc_id, r, w, c, CAST(1 AS BIGINT) AS batch FROM d WHERE r = 1 UNION ALL
SELECT d.doc_id, d.r, CASE WHEN {_FITS} THEN b.w ELSE 0 END + d.w, CASE WHEN {_FITS} THEN b.c ELSE 0 END + d.c, b.batch + CASE WHEN {_FITS} THEN 0 ELSE 1 END FROM b JOIN d ON d.r = b.r + 1) SELECT doc_id, batch FROM b""")
def doc_batch(spark, d):
    return D.batches(table(spark, d, "documents"), "doc_id", "doc_id", words=5000, chars=20000)


@query("SELECT conv_id, string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_merge(spark, d):
    return D.merge_texts(table(spark, d, "conversations"), "role", "text", "turn", "conv_id")


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[a-zA-Z]+')) > 2000")
def doc_needs_location(spark, d):
    return D.needs_location(table(spark, d, "documents"), words=2000).select("doc_id")


SEGMENTS = "SELECT source, CAST(doc_id * 7 % 100 AS DOUBLE) / 100 AS relevance, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE doc_id END AS start, CASE WHEN doc_id % 10 = 0 THEN length(text) ELSE doc_id + 50 END AS stop, length(text) AS length FROM {documents}"


@query(f"SELECT source, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS chars, round(avg(relevance), 6) AS relevance, count(*) FILTER (relevance >= 0.8) AS high, count(*) FILTER (relevance >= 0.5 AND relevance < 0.8) AS medium, count(*) FILTER (relevance < 0.5) AS low FROM ({SEGMENTS}) q GROUP BY source")
def doc_segment_stats(spark, d):
    return D.segment_stats(frame(spark, d, SEGMENTS), "source")


@query(f"SELECT source FROM ({SEGMENTS}) q GROUP BY source HAVING avg(CASE WHEN start = 0 AND stop = length THEN 1 ELSE 0 END) > 0.1")
def doc_fallback_ratio(spark, d):
    return D.too_vague(frame(spark, d, SEGMENTS), "source", 0.1).select("source")


@query("SELECT conv_id, string_agg('[relevance ' || CASE WHEN role = 'user' THEN '0.90' ELSE '0.50' END || ']' || chr(10) || text, chr(10) || repeat('=', 80) || chr(10) ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS text FROM conversations GROUP BY conv_id")
def doc_merge_segments(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", 0.9).otherwise(0.5).alias("relevance"), F.col("turn").alias("start"), F.col("text").alias("content"))
    return D.merge_segments(c, "conv_id")


@query("SELECT 'see ' || 'files/' || n_name || '.txt' AS evidence, n_name || '.txt' AS name FROM nation WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 'see files/' || n_name || '.txt', n_name || '.txt' FROM nation WHERE n_nationkey IN (1, 2)")
def doc_evidence_source(spark, d):
    n = table(spark, d, "nation")
    return D.evidence_documents(n.select(F.concat(F.lit("see files/"), "n_name", F.lit(".txt")).alias("evidence")), n.select(F.concat("n_name", F.lit(".txt")).alias("name")))


@query("SELECT page_id FROM pages WHERE (contains(url, 'blog') OR contains(url, 'www')) AND NOT contains(url, 'casino')")
def doc_filter(spark, d):
    return D.filter_documents(table(spark, d, "pages"), "url", ["blog", "www"], ["casino"]).select("page_id")


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]+)$', 1) AS base FROM pages")
def doc_base_name(spark, d):
    return table(spark, d, "pages").select("page_id", V.base_name(F.col("url")).alias("base"))


@query("SELECT CAST(user_id % 50 AS STRING) AS entity, substr(props, 1, 6) AS chunk, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events) q WHERE n <= 10")
def doc_entity_chunks(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("entity"), F.col("event_id").alias("ord"), F.col("props").alias("chunk"))
    return D.entity_chunks(e, 10, 6)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type AS constraint_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, d):
    """Extension: tumbling windows over events, the plan that also runs on streams."""
    from ..streaming.verify_stream import window_counts as count

    return count(table(spark, d, "events").withColumnRenamed("event_type", "constraint_type"), "ts").select("start", "constraint_type", "n")
