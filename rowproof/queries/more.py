"""Queries of lookups, entity spellings, score groups and typed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import evaluate as E
from ..operators import repair as P
from ..operators import setchecks as S
from ..plans import api
from ..plans.schema import parse_schema
from .base import frame, query, table
from .verification import customers, orders

SPELLED = "SELECT CAST(p_partkey AS STRING) AS tuple_id, CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' Corp.') WHEN p_partkey % 9 = 0 THEN concat(p_name, ' Inc.') WHEN p_partkey % 5 = 0 THEN concat('only ', p_brand, CAST(p_partkey % 3 AS STRING)) ELSE p_name END AS maker FROM {part}"
NAMED = "SELECT DISTINCT concat('d-', p_name) AS tuple_id, CASE WHEN length(p_name) % 2 = 0 THEN concat(p_name, ' Ltd.') ELSE p_name END AS maker FROM {part}"
_SIMILAR = """(contains(a.x, b.x) AND length(b.x) >= 3 OR contains(b.x, a.x) AND length(a.x) >= 3 OR contains(a.core, b.core) OR contains(b.core, a.core) OR (1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)) > 0.9 AND least(length(a.x), length(b.x)) >= 5))"""


@query(f"""WITH RECURSIVE r AS ({SPELLED}), s AS ({NAMED}), v AS (SELECT x, row_number() OVER (ORDER BY x) AS i, trim(replace(replace(replace(x, 'Corp.', ''), 'Inc.', ''), 'Ltd.', '')) AS core FROM (SELECT maker AS x FROM r UNION SELECT maker FROM s) u),
p AS (SELECT a.i AS a, list(b.i) AS bs FROM v a, v b WHERE a.x <> b.x AND {_SIMILAR} GROUP BY a.i),
w(i, led) AS (SELECT CAST(0 AS BIGINT), CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) UNION ALL SELECT w.i + 1, CASE WHEN list_contains(map_keys(led), w.i + 1) THEN led
  ELSE map_concat(MAP([w.i + 1] || list_filter(coalesce(bs, []), lambda b: NOT list_contains(map_keys(led), b)), list_transform([w.i + 1] || list_filter(coalesce(bs, []), lambda b: NOT list_contains(map_keys(led), b)), lambda z: w.i + 1)), led) END
  FROM w LEFT JOIN p ON p.a = w.i + 1 WHERE w.i < (SELECT count(*) FROM v)),
g AS (SELECT v.x, m.value AS leader, v.x IN (SELECT maker FROM r) AS in_r, v.x IN (SELECT maker FROM s) AS in_s FROM (SELECT unnest(map_entries(led)) AS m FROM w ORDER BY i DESC LIMIT (SELECT count(*) FROM v)) l JOIN v ON v.i = l.m.key),
c AS (SELECT leader, arg_min(x, {{'n': -length(x), 'x': x}}) AS canon FROM g GROUP BY leader HAVING bool_or(in_r) AND bool_or(in_s)),
f AS (SELECT x, canon FROM g JOIN c USING (leader) WHERE x <> canon)
SELECT 'part' AS tbl, tuple_id, canon AS suggested_fix FROM r JOIN f ON maker = x UNION ALL SELECT 'names', tuple_id, canon FROM s JOIN f ON maker = x""")
def verify_entity_spelling(spark, d):
    """Two tables that name the same makers, and names that one table has alone."""
    return S.entity_consistency({"part": frame(spark, d, SPELLED), "names": frame(spark, d, NAMED)}, "maker").select("tbl", "tuple_id", "suggested_fix")


@query("SELECT tuple_id FROM {CUS} t WHERE _seq % 40 = 0")
def lookup_rows(spark, d):
    c = customers(spark, d)
    return P.lookup_rows(c, c.where("_seq % 40 = 0").select(F.concat(F.lit("["), "tuple_id", F.lit("] ")).alias("tuple_id"))).select("tuple_id")


@query("SELECT tuple_id FROM {CUS} t ORDER BY _seq LIMIT 5")
def sample_rows(spark, d):
    return E.first_rows(customers(spark, d), "_seq", 5).select("tuple_id")


@query("""SELECT kind, correct, generated, expected FROM (SELECT CASE WHEN c_mktsegment < 'F' THEN 'entity' ELSE 'relation' END AS kind, count(*) FILTER (c_custkey % 6 = 1) AS correct, count(*) FILTER (c_custkey % 3 <> 0) AS generated, count(*) AS expected FROM customer GROUP BY 1) q""")
def eval_kind_scores(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("expected"), F.count_if(F.col("c_custkey") % 3 != 0).alias("generated"), F.count_if(F.col("c_custkey") % 6 == 1).alias("correct"))
    kinds = table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp")).distinct().withColumn("kind", F.when(F.col("grp") < "F", "entity").otherwise("relation"))
    return E.kind_scores(c, kinds).select("kind", "correct", "generated", "expected")


@query("SELECT c_nationkey AS k, 'c' AS src FROM customer UNION SELECT s_nationkey, 's' FROM supplier")
def eval_merge_outputs(spark, d):
    return E.merge_outputs([table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")), table(spark, d, "supplier").select(F.lit("s").alias("src"), F.col("s_nationkey").alias("k"))])


TYPED = parse_schema({"table_name": "orders", "columns": {"o_orderkey": "INT", "o_totalprice": "float", "o_orderdate": "date", "o_open": "boolean", "o_orderpriority": "TEXT"}}).tables[0]


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(replace(replace(o_totalprice, ',', ''), '$', '') AS DOUBLE) AS o_totalprice, CAST(TRY_CAST(replace(o_orderdate, '/', '-') AS DATE) AS STRING) AS o_orderdate, CASE o_open WHEN 'Yes' THEN true WHEN 'false' THEN false END AS o_open, o_orderpriority FROM {ORD} t""")
def materialise_types(spark, d):
    return api.materialise(orders(spark, d), TYPED).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query()
def doc_split_long(spark, d):
    return D.split_long(table(spark, d, "documents"), "doc_id", words=300, chars=2000)

