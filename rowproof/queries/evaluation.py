"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import evaluate as E
from ..operators.rowmatch import match_rows
from .base import frame, query, table

GOLD = "SELECT c_custkey AS _seq, c_name, CAST(c_nationkey AS STRING) AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) AS c_acctbal, c_mktsegment FROM {customer}"
MADE = """SELECT c_custkey AS _seq, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS c_nationkey,
CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) || '0' END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 3 <> 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM {customer} WHERE c_custkey % 13 <> 0"""
FIELDS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PAIRS = f"SELECT g._seq AS k, g.c_name AS n1, m.c_name AS n2, g.c_nationkey AS x1, m.c_nationkey AS x2, g.c_acctbal AS b1, m.c_acctbal AS b2, g.c_mktsegment AS s1, m.c_mktsegment AS s2 FROM ({GOLD}) g JOIN ({MADE}) m ON g._seq = m._seq"


@query(f"""SELECT k, lower(n1) = lower(n2) AS name_match, (CASE WHEN x2 IS NULL THEN false ELSE x1 = x2 END) AS nation_match, CAST(b1 AS DOUBLE) = CAST(b2 AS DOUBLE) AS balance_match,
round(CASE WHEN CAST(b1 AS DOUBLE) = CAST(b2 AS DOUBLE) THEN 1.0 WHEN CAST(b1 AS DOUBLE) = 0 THEN 0.0 ELSE greatest(0.0, 1 - abs(CAST(b1 AS DOUBLE) - CAST(b2 AS DOUBLE)) / abs(CAST(b1 AS DOUBLE))) END, 6) AS balance_similarity FROM ({PAIRS}) q""")
def eval_cell_compare(spark, d):
    p = frame(spark, d, PAIRS)
    c = lambda a, b: E.compare(F.col(a), F.col(b))
    return p.select("k", c("n1", "n2")["match"].alias("name_match"), c("x1", "x2")["match"].alias("nation_match"), c("b1", "b2")["match"].alias("balance_match"), F.round(c("b1", "b2")["similarity"], 6).alias("balance_similarity"))


@query(f"""SELECT k, CASE WHEN k % 3 = 0 THEN round(1 - levenshtein(lower(n1), lower(n2)) / greatest(length(n1), length(n2)), 6) WHEN lower(n1) = lower(n2) THEN 1.0 ELSE 0.95 END AS s FROM (SELECT k, n1, CASE WHEN k % 3 = 0 THEN 'ab' || k WHEN k % 2 = 0 THEN n2 || ' Ltd' ELSE n2 END AS n2 FROM ({PAIRS}) z) q""")
def eval_string_similarity(spark, d):
    p = frame(spark, d, PAIRS)
    return p.select("k", F.round(V.string_similarity(F.col("n1"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("ab"), F.col("k").cast("string"))).when(F.col("k") % 2 == 0, F.concat("n2", F.lit(" Ltd"))).otherwise(F.col("n2"))), 6).alias("s"))


def _matched(spark, d, block=()):
    g, m = frame(spark, d, GOLD), frame(spark, d, MADE)
    return g, m, E.greedy_match(E.score_matrix(g, m, FIELDS, block=block))


# all names share the keyword before their number and so match; other cells by number or by edits
_NUMERIC = "CASE WHEN {1} IS NULL THEN 0.0 WHEN CAST({0} AS DOUBLE) = CAST({1} AS DOUBLE) THEN 1.0 WHEN CAST({0} AS DOUBLE) = 0 THEN 0.0 ELSE greatest(0.0, 1 - abs(CAST({0} AS DOUBLE) - CAST({1} AS DOUBLE)) / abs(CAST({0} AS DOUBLE))) END"
_EDITS = "CASE WHEN {0} = {1} THEN 1.0 ELSE greatest(0.0, 1 - levenshtein(lower({0}), lower({1})) / greatest(length({0}), length({1}))) END"
#: The walk in SQL: one gold row a step, the used made rows as bits.
WALK = f"""q AS (SELECT g._seq AS g, m._seq AS m, round((1.0 + {_NUMERIC.format('g.c_nationkey', 'm.c_nationkey')} + {_NUMERIC.format('g.c_acctbal', 'm.c_acctbal')} + {_EDITS.format('g.c_mktsegment', 'm.c_mktsegment')}) / 4, 9) AS score FROM ({GOLD}) g, ({MADE}) m),
p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY g) AS r FROM q WHERE score >= 0.3 ORDER BY g),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS g, CAST(NULL AS STRUCT(s DOUBLE, m BIGINT)) AS x, CAST(repeat('0', (SELECT CAST(max(m) + 1 AS INT) FROM p)) AS BIT) AS used
  UNION ALL SELECT r, g, x, CASE WHEN x IS NULL THEN used ELSE set_bit(used, CAST(-x.m AS INT), 1) END FROM
  (SELECT p.r, any_value(p.g) AS g, any_value(w.used) AS used, max({{'s': score, 'm': -p.m}}) FILTER (get_bit(w.used, CAST(p.m AS INT)) = 0) AS x FROM w JOIN p ON p.r = w.r + 1 GROUP BY p.r) n)"""


@query(f"WITH RECURSIVE {WALK} SELECT '' AS grp, g, -x.m AS m, x.s AS score FROM w WHERE x IS NOT NULL")
def eval_row_match(spark, d):
    """Greedy matching of all gold rows with all made rows."""
    return match_rows(frame(spark, d, GOLD), frame(spark, d, MADE), FIELDS)


@query(f"""WITH RECURSIVE {WALK} SELECT sum(1 + coalesce(CAST(x.c_nationkey = y.c_nationkey AS INT), 0) + CAST(CAST(x.c_acctbal AS DOUBLE) = CAST(y.c_acctbal AS DOUBLE) AS INT) + CAST(x.c_mktsegment = y.c_mktsegment AS INT)) AS correct, any_value(e) AS expected, any_value(n) AS generated
 FROM w JOIN ({GOLD}) x ON w.g = x._seq JOIN ({MADE}) y ON -w.x.m = y._seq, (SELECT count(*) * 4 AS e FROM ({GOLD}) g), (SELECT sum(4 - CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END) AS n FROM ({MADE}) m)""", expected="BIGINT", generated="BIGINT", correct="BIGINT")
def eval_matched_cells(spark, d):
    """Cell counts after greedy matching over whole tables, without a block."""
    g, m = frame(spark, d, GOLD), frame(spark, d, MADE)
    return E.cell_counts(g, m, match_rows(g, m, FIELDS), FIELDS).select("expected", "generated", "correct")


@query(f"""SELECT sum(4 - (CASE WHEN _seq < 0 THEN 1 ELSE 0 END)) AS expected, (SELECT sum(4 - (CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END)) FROM ({MADE}) m) AS generated,
(SELECT sum(1 + (CASE WHEN x2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN CAST(b1 AS DOUBLE) = CAST(b2 AS DOUBLE) THEN 1 ELSE 0 END) + (CASE WHEN s1 = s2 THEN 1 ELSE 0 END)) FROM ({PAIRS}) p) AS correct FROM ({GOLD}) g""", expected="BIGINT", generated="BIGINT", correct="BIGINT")
def eval_cell_metrics(spark, d):
    g, m, match = _matched(spark, d, block=["c_name"])  # the SQL pairs rows by their key
    return E.cell_counts(g, m, match, FIELDS).select("expected", "generated", "correct")


# the tables that events of a day name, and their fields, as an extraction of the next day has them
NAMES = "SELECT concat('t', CAST(user_id % 143 AS STRING)) AS tbl, concat(event_type, '_', CAST(user_id % 7 AS STRING)) AS field FROM {events} WHERE event_id % 3 <> "
_GOLD_NAMES, _MADE_NAMES = (f"SELECT DISTINCT tbl, field FROM ({NAMES}{k} AND user_id % {m} <> 1) n" for k, m in ((0, 11), (1, 13)))
_LEVEL = "SELECT '{0}' AS level, (SELECT count(*) FROM (SELECT DISTINCT {1} FROM g)) AS expected, (SELECT count(*) FROM (SELECT DISTINCT {1} FROM m)) AS generated, (SELECT count(*) FROM (SELECT {1} FROM g INTERSECT SELECT {1} FROM m)) AS correct"


@query(f"WITH g AS ({_GOLD_NAMES}), m AS ({_MADE_NAMES}) {_LEVEL.format('table', 'tbl')} UNION ALL {_LEVEL.format('field', 'tbl, field')}")
def eval_structural(spark, d):
    out = E.structural(frame(spark, d, _GOLD_NAMES), frame(spark, d, _MADE_NAMES))
    return out.select("level", "expected", "generated", "correct")


CELLS = lambda t, src: " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS attr, {c} AS value FROM ({src}) q" for c in FIELDS)
_SIDE = lambda s: f"SELECT tbl, attr, lower(trim(value)) AS v, count(*) AS n FROM ({s}) z WHERE value IS NOT NULL AND lower(value) NOT IN ('null', 'none', 'n/a', '') GROUP BY ALL"


@query(f"""WITH g AS ({_SIDE(CELLS('customer', GOLD))}), m AS ({_SIDE(CELLS('customer', MADE))}), s AS (SELECT tbl, coalesce(g.n, 0) AS e, coalesce(m.n, 0) AS k, least(coalesce(g.n, 0), coalesce(m.n, 0)) AS c FROM g FULL JOIN m USING (tbl, attr, v)),
t AS (SELECT tbl, sum(e) AS expected, sum(k) AS generated, sum(c) AS correct FROM s GROUP BY ROLLUP (tbl))
SELECT tbl, expected, generated, correct, round(100 * correct / generated, 4) AS precision, round(100 * correct / expected, 4) AS recall, round(2 * (100 * correct / generated) * (100 * correct / expected) / (100 * correct / generated + 100 * correct / expected), 4) AS f1 FROM t""", expected="BIGINT", generated="BIGINT", correct="BIGINT")
def eval_multiset(spark, d):
    return E.multiset_scores(frame(spark, d, CELLS("customer", GOLD)), frame(spark, d, CELLS("customer", MADE)))


SCORES = "SELECT concat('m', CAST(s_suppkey % 4 AS STRING)) AS method, CAST(s_suppkey AS STRING) AS case, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS precision, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS recall, CAST(s_suppkey * 29 % 89 AS DOUBLE) AS f1 FROM {supplier}"
_S = SCORES.replace("AS case", 'AS "case"')


@query(f"SELECT method, round(avg(precision), 2) AS precision, round(avg(recall), 2) AS recall, round(avg(f1), 2) AS f1, count(*) AS n_cases FROM ({_S}) q GROUP BY method")
def eval_method_macro(spark, d):
    return E.method_averages(frame(spark, d, SCORES))


@query(f"WITH a AS (SELECT method, round(avg(precision), 2) AS precision, round(avg(recall), 2) AS recall, round(avg(f1), 2) AS f1 FROM ({_S}) q GROUP BY method) SELECT metric, method, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, method) AS n FROM (UNPIVOT a ON precision, recall, f1 INTO NAME metric VALUE value) u) w WHERE n = 1")
def eval_best_method(spark, d):
    return E.best_methods(E.method_averages(frame(spark, d, SCORES)))


@query(f"""SELECT CASE WHEN f1 >= 90 THEN 'excellent' WHEN f1 >= 75 THEN 'good' WHEN f1 >= 60 THEN 'acceptable' ELSE 'poor' END AS level, count(*) AS n FROM (SELECT CAST(o_orderkey % 101 AS DOUBLE) AS f1 FROM orders) q GROUP BY 1""")
def eval_quality_level(spark, d):
    return table(spark, d, "orders").select(E.quality_level((F.col("o_orderkey") % 101).cast("double")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT c_mktsegment AS grp, count(*) AS expected, count(*) FILTER (c_custkey % 3 <> 0) AS generated, count(*) FILTER (c_custkey % 6 = 1) AS correct FROM customer GROUP BY 1),
t AS (SELECT grp, sum(correct) AS correct, sum(generated) AS generated, sum(expected) AS expected FROM c GROUP BY ROLLUP (grp))
SELECT grp, correct, generated, expected, round(100 * correct / generated, 4) AS precision, round(100 * correct / expected, 4) AS recall, round(2 * (100 * correct / generated) * (100 * correct / expected) / (100 * correct / generated + 100 * correct / expected), 4) AS f1 FROM t""", expected="BIGINT", generated="BIGINT", correct="BIGINT")
def eval_table_scores(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("expected"), F.count_if(F.col("c_custkey") % 3 != 0).alias("generated"), F.count_if(F.col("c_custkey") % 6 == 1).alias("correct"))
    return E.table_scores(c)


# names of tables in two spellings: gold in capitals for some, made in plural for some
_GOLD_TABLES = "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE replace(p_name, ' ', '_') END AS name FROM {part}"
_MADE_TABLES = "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN concat(replace(p_name, ' ', '_'), 's') ELSE concat(upper(replace(p_name, ' ', '_')), '_old') END AS name FROM {part}"


@query(f"""SELECT gold, made FROM (SELECT g.name AS gold, m.name AS made, row_number() OVER (PARTITION BY g.name ORDER BY CASE WHEN lower(g.name) = lower(m.name) THEN 0 ELSE 1 END, m.name) AS n
FROM ({_GOLD_TABLES}) g JOIN ({_MADE_TABLES}) m ON rtrim(lower(g.name), 's') = rtrim(lower(m.name), 's')) q WHERE n = 1""")
def eval_table_match(spark, d):
    return E.match_tables(frame(spark, d, _GOLD_TABLES), frame(spark, d, _MADE_TABLES))


@query("""SELECT v, CASE WHEN v = '' THEN 'null' WHEN regexp_matches(replace(replace(v, ',', ''), ' ', ''), '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'numeric' WHEN regexp_matches(v, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}') THEN 'date' WHEN lower(v) IN ('true', 'false', 'yes', 'no') THEN 'boolean' ELSE 'string' END AS kind
FROM (SELECT DISTINCT o_orderdate AS v FROM {ORD} t UNION SELECT DISTINCT o_open FROM {ORD} t UNION SELECT DISTINCT o_totalprice FROM {ORD} t WHERE o_totalprice IS NOT NULL) q""")
def value_type(spark, d):
    from .verification import orders

    o = orders(spark, d)
    v = o.select(F.col("o_orderdate").alias("v")).union(o.select("o_open")).union(o.select("o_totalprice").where("o_totalprice is not null")).distinct()
    return v.select("v", V.value_type(F.col("v")).alias("kind"))


@query("SELECT CAST(n AS STRING) AS case, CASE WHEN n % 3 = 0 THEN 87.5 WHEN n % 3 = 1 THEN 100.0 ELSE 62.0 END AS score FROM (SELECT n_nationkey AS n FROM nation) q".replace("AS case", 'AS "case"'), score="DOUBLE")
def parse_rating(spark, d):
    n = F.col("n_nationkey")
    text = F.when(n % 3 == 0, "Evaluation evidence: fine\nRating: [[87.5]]").when(n % 3 == 1, '{"overall_score": 170}').otherwise("大约 62 分")
    return table(spark, d, "nation").select(n.cast("string").alias("case"), V.rating(text).alias("score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def parse_json_fixes(spark, d):
    wrapped = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", F.get_json_object(V.json_payload(wrapped), "$.k").cast("long").alias("k")).where("k is not null")


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS STRING) AS size FROM part")
def parse_markdown_table(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("Result\n<TABLE BEGIN>\n| name | size |\n|---|:-:|\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n<TABLE END>"))
    return p.select("p_partkey", F.explode(V.markdown_rows(text)).alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["size"].alias("size"))


@query("SELECT p_partkey, 'e1' AS entity, p_name AS chunk FROM part UNION ALL SELECT p_partkey, 'e1', p_brand FROM part UNION ALL SELECT p_partkey, 'e2', p_type FROM part")
def parse_tagged_spans(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("<entity id=e1><chunk>"), "p_name", F.lit("</chunk><chunk> "), "p_brand", F.lit(" </chunk></entity>\n<entity id=e2><chunk>"), "p_type", F.lit("</chunk></entity>"))
    return p.select("p_partkey", F.explode(V.tagged_spans(text)).alias("s")).select("p_partkey", "s.entity", "s.chunk")


@query("SELECT p_partkey, 'name' AS field, p_name AS old, p_brand AS new FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS STRING), '0' FROM part")
def parse_changes(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("Changes\n- name: "), "p_name", F.lit(" -> "), "p_brand", F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit(" -> 0"))
    return p.select("p_partkey", F.explode(V.changes(text)).alias("c")).select("p_partkey", "c.field", "c.old", "c.new")
