"""Queries of repairs, merging, de-duplication and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import history as H
from ..operators import merge as M
from ..operators import repair as P
from ..operators import setchecks as S
from ..operators import verify as R
from .base import frame, query, table
from .verification import _raw, customers, orders

NAMES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
FIXES = """SELECT concat('t-', CAST(c_custkey AS STRING)) AS tuple_id, 'c_mktsegment' AS attr, 'FIRST' AS new, CAST(1 AS BIGINT) AS ord FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT concat('t-', CAST(c_custkey AS STRING)), 'c_mktsegment', 'LAST', CAST(2 AS BIGINT) FROM {customer} WHERE c_custkey % 6 = 0
UNION ALL SELECT concat('t-', CAST(c_custkey AS STRING)), 'c_name', CASE WHEN c_custkey % 25 = 0 THEN '__DELETED__' ELSE 'named' END, CAST(1 AS BIGINT) FROM {customer} WHERE c_custkey % 5 = 0"""


@query("""SELECT tuple_id, CASE WHEN k % 5 = 0 THEN 'named' ELSE c_name END AS c_name, CASE WHEN k % 6 = 0 THEN 'LAST' WHEN k % 3 = 0 THEN 'FIRST' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, CAST(c_custkey AS BIGINT) AS k FROM {CUS} t) q WHERE k % 25 <> 0""")
def repair_apply(spark, d):
    return P.apply_fixes(customers(spark, d), frame(spark, d, FIXES), NAMES).select("tuple_id", "c_name", "c_mktsegment")


@query("SELECT tuple_id FROM {CUS} t WHERE CAST(c_custkey AS BIGINT) % 25 <> 0")
def repair_delete(spark, d):
    marked = customers(spark, d).withColumn("c_name", F.when(F.col("_seq") % 25 == 0, P.DELETED).otherwise(F.col("c_name")))
    return P.purge_deleted(marked, NAMES).select("tuple_id")


@query("""SELECT tuple_id, 'o_orderstatus' AS attr, o_orderstatus AS old, CASE WHEN trim(o_orderstatus) = '' THEN '待处理' WHEN upper(o_orderstatus) = 'O' THEN 'O' WHEN upper(o_orderstatus) = 'F' THEN 'F' ELSE 'P' END AS new,
CASE WHEN trim(o_orderstatus) = '' THEN 'default_value' ELSE 'domain_mapping' END AS fix_type FROM {ORD} t WHERE o_orderstatus NOT IN ('F', 'O', 'P')""")
def repair_suggest(spark, d):
    v = _raw(spark, d).where("rule_code <> 'VALUE_ENUM'")
    return P.suggest(v, orders(spark, d), ["o_orderstatus"]).select("tuple_id", "attr", "old", "new", "fix_type")


_HIT = "tuple_id IN (SELECT 't-' || CAST(c_custkey AS STRING) FROM customer WHERE c_custkey % 3 = 0)"


def _vio(spark, d):
    v = customers(spark, d).where("c_name is null or lower(c_name) = 'null'")
    return v.select("tuple_id", F.lit("c_mktsegment").alias("attr"), F.concat(F.lit("v-"), "tuple_id").alias("id"))


@query(f"SELECT tuple_id, attr FROM (SELECT tuple_id, 'c_mktsegment' AS attr FROM {{CUS}} t WHERE c_name IS NULL OR lower(c_name) = 'null') q WHERE NOT {_HIT}")
def repair_unfixable(spark, d):
    return R.unfixable(_vio(spark, d), frame(spark, d, FIXES)).select("tuple_id", "attr")


@query(f"SELECT tuple_id, attr FROM (SELECT tuple_id, 'c_mktsegment' AS attr FROM {{CUS}} t WHERE c_name IS NULL OR lower(c_name) = 'null') q WHERE {_HIT}")
def repair_repeated(spark, d):
    return R.repeated(_vio(spark, d), frame(spark, d, FIXES)).select("tuple_id", "attr")


@query("SELECT tuple_id FROM {CUS} t WHERE (c_name IS NULL OR lower(c_name) = 'null') AND _seq % 4 <> 0")
def filter_unfixable_ids(spark, d):
    return R.without(_vio(spark, d), customers(spark, d).where("_seq % 4 = 0").select(F.concat(F.lit("v-"), "tuple_id").alias("id"))).select("tuple_id")


@query("""SELECT tuple_id, CASE WHEN c_mktsegment = 'BUILDNG' THEN 'BUILDING' ELSE upper(c_mktsegment) END AS c_mktsegment FROM {CUS} t""")
def repair_nearest_fk(spark, d):
    rows = customers(spark, d)
    return P.fill_nearest(rows, "c_mktsegment", S.nearest_reference(rows, "c_mktsegment", table(spark, d, "customer"), "c_mktsegment")).select("tuple_id", "c_mktsegment")


PARTS = "SELECT p_partkey AS _seq, p_name, p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE p_type END AS p_type, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS p_size FROM {part}"


@query(f"""WITH p AS ({PARTS}) SELECT p_name, p_brand, arg_min(p_type, _seq) FILTER (p_type <> '') AS p_type, arg_min(p_size, _seq) FILTER (p_size <> '') AS p_size FROM p GROUP BY p_name, p_brand""")
def repair_merge_rows(spark, d):
    return P.merge_by_key(frame(spark, d, PARTS), ["p_name", "p_brand"], ["p_name", "p_brand", "p_type", "p_size"])


@query(f"""WITH p AS ({PARTS}), n AS (SELECT *, (CASE WHEN p_type <> '' THEN 1 ELSE 0 END) + (CASE WHEN p_size <> '' THEN 1 ELSE 0 END) AS f FROM p) SELECT _seq, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY f DESC, _seq) AS r FROM n) q WHERE r = 1""")
def repair_keep_dominant(spark, d):
    return P.keep_dominant(frame(spark, d, PARTS), ["p_name", "p_brand"], ["p_type", "p_size"]).select("_seq", "p_name", "p_brand")


@query("SELECT tuple_id, CASE WHEN o_orderstatus IS NULL OR trim(o_orderstatus) = '' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM {ORD} t")
def repair_defaults(spark, d):
    return P.fill_defaults(orders(spark, d), {"o_orderstatus": "P"}).select("tuple_id", "o_orderstatus")


@query("""SELECT 'o_open' AS attr, 'TYPE_BOOLEAN' AS rule_code, count(*) AS n FROM {ORD} t WHERE o_open = 'maybe' HAVING count(*) > 0
UNION ALL SELECT 'o_totalprice', 'VALUE_MISSING_INFERRED', count(*) FROM {ORD} t WHERE o_totalprice IS NULL HAVING count(*) > 0""")
def repair_loop(spark, d):
    """Verify and fix orders' status until nothing tool-fixable is left: the violations that remain."""
    from ..plans.schema import parse_schema
    from ..sources.shared import shared_table

    s = parse_schema({"tables": [{"name": "orders", "attributes": {"o_orderstatus": {"type": "string", "domain": ["F", "O", "P"]}, "o_open": {"type": "boolean"}, "o_totalprice": {"type": "float", "min": 0}}}]})
    _, left, _ = P.repair_loop(shared_table(orders(spark, d), "orders"), lambda rows: R.verify(rows, s, "orders"), ["o_orderstatus", "o_open", "o_totalprice"], shared_table)
    return left.groupBy("attr", "rule_code").agg(F.count("*").alias("n"))


@query("SELECT tuple_id, attr, business_rule_id, CASE business_rule_id WHEN 'phi_1' THEN 'manual_review' WHEN 'phi_3' THEN 'insert_row' END AS fix_action FROM (SELECT DISTINCT least(o_custkey % 9, o_orderkey % 7) || '|' || greatest(o_custkey % 9, o_orderkey % 7) AS tuple_id, 'x' AS attr, CASE WHEN o_custkey % 2 = 0 THEN 'phi_1' ELSE 'phi_3' END AS business_rule_id FROM orders) q")
def repair_rule_actions(spark, d):
    v = frame(spark, d, "SELECT DISTINCT 'orders' AS tbl, concat(CAST(least(o_custkey % 9, o_orderkey % 7) AS STRING), '|', CAST(greatest(o_custkey % 9, o_orderkey % 7) AS STRING)) AS tuple_id, 'x' AS attr, CASE WHEN o_custkey % 2 = 0 THEN 'phi_1' ELSE 'phi_3' END AS business_rule_id, CAST(NULL AS STRING) AS suggested_fix FROM {orders}")
    return P.rule_fixes(v).select("tuple_id", "attr", "business_rule_id", "fix_action")


# De-duplication and merging

CASED = "SELECT c_custkey AS _seq, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE concat(' ', lower(c_mktsegment)) END AS seg, CAST(c_nationkey AS STRING) AS nat, CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '' END AS note FROM {customer}"


@query(f"SELECT min(_seq) AS _seq FROM ({CASED}) q GROUP BY lower(trim(seg)), nat")
def dedup_signature(spark, d):
    return M.dedup_signature(frame(spark, d, CASED), ["seg", "nat", "note"]).select("_seq")


@query("SELECT DISTINCT p_name, p_type FROM part")
def dedup_exact(spark, d):
    return M.dedup_rows(table(spark, d, "part").select("p_name", "p_type"))


SPARSE = "SELECT concat('t-', CAST(p_partkey AS STRING)) AS tuple_id, p_partkey AS _seq, p_name AS a, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS b, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN '' END AS c FROM {part}"
_EQ = lambda x: f"(nullif(p.{x}, '') IS NULL OR p.{x} = q.{x})"
_CNT = lambda t: "+".join(f"(CASE WHEN nullif({t}.{x}, '') IS NULL THEN 0 ELSE 1 END)" for x in "abc")


@query(f"""WITH r AS ({SPARSE}) SELECT tuple_id FROM r p WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.tuple_id <> p.tuple_id AND {_EQ('a')} AND {_EQ('b')} AND {_EQ('c')} AND ({_CNT('p')} < {_CNT('q')} OR ({_CNT('p')} = {_CNT('q')} AND q._seq < p._seq)))""")
def dedup_subset(spark, d):
    return M.dedup_subset(frame(spark, d, SPARSE), ["a", "b", "c"]).select("tuple_id")


@query("SELECT k, least(x, y) AS n FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY 1) b USING (k)")
def multiset_intersection(spark, d):
    return M.multiset_intersection(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query("""SELECT tuple_id, CASE WHEN _seq % 4 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN _seq % 4 = 0 THEN 'doc1|[Warm Start Fix] doc2' ELSE 'doc1' END AS ev FROM {ORD} t""")
def warm_start_merge(spark, d):
    o = orders(spark, d).select("tuple_id", "_seq", "o_orderstatus", F.array(F.lit("doc1")).alias("ev"))
    new = o.where("_seq % 2 = 0").select("tuple_id", F.when(F.col("_seq") % 4 == 0, "R").otherwise("null").alias("o_orderstatus"), F.when(F.col("_seq") % 4 == 0, F.array(F.lit("doc2"))).alias("ev"))
    return M.warm_start(o, new, ["o_orderstatus"], evidence="ev").select("tuple_id", "o_orderstatus", F.array_join("ev", "|").alias("ev"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, o_custkey AS a, 'old' AS v FROM orders WHERE o_custkey % 10 <> 0 UNION SELECT o_orderkey + 1000000, o_custkey, 'new' FROM orders WHERE o_custkey % 10 = 0""")
def anchor_merge(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), F.lit("old").alias("v"))
    new = old.where("a % 10 = 0").select((F.col("k") + 1000000).alias("k"), "a", F.lit("new").alias("v"))
    return M.anchor_merge(old, new.union(new), "a", old.where("a % 10 = 0").select("a"), ["k", "a", "v"])


@query("SELECT tuple_id, CASE WHEN _seq % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM {CUS} t")
def snapshot_overlay(spark, d):
    base = customers(spark, d).select("tuple_id", "_seq", F.lit("old").alias("v"))
    return M.overlay(base, base.where("_seq % 3 = 0").withColumn("v", F.lit("new"))).select("tuple_id", "v")


@query("SELECT c_custkey, NULL AS s_suppkey, c_nationkey AS nk FROM customer UNION ALL SELECT NULL, s_suppkey, s_nationkey FROM supplier")
def batch_concat(spark, d):
    return M.concat([table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nk")), table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))])


@query("SELECT c_custkey, CAST(ceil((row_number() OVER (ORDER BY c_custkey)) / 20.0) AS BIGINT) AS batch FROM customer")
def anchor_batches(spark, d):
    return M.number_batches(table(spark, d, "customer").select("c_custkey"), "c_custkey", 20)


@query("""SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0)""")
def affected_anchors(spark, d):
    rows = table(spark, d, "orders").withColumn("tuple_id", F.col("o_orderkey").cast("string"))
    v = rows.where("o_orderkey % 101 = 0").select("tuple_id", F.lit(None).cast("array<string>").alias("affected_tuple_ids")).union(rows.where("o_orderkey % 103 = 0").select(F.lit("group"), F.array("tuple_id")))
    return R.affected_anchors(v, rows, "o_custkey", table(spark, d, "customer"), "c_custkey").select("c_custkey")


# History

LOG = "SELECT concat('run-', CAST(user_id % 5 AS STRING)) AS run_id, concat('t', CAST(user_id % 7 AS STRING)) AS tbl, CASE event_type WHEN 'click' THEN 'extraction' WHEN 'view' THEN 'verification' WHEN 'purchase' THEN 'fixing' ELSE 'final' END AS stage, CASE WHEN event_id % 10 = 0 THEN 'Batch验证 1' ELSE '' END AS description, CAST(floor(value * 100) AS BIGINT) AS rows_count, ts AS created_at, event_id FROM {events}"


@query(f"SELECT run_id, tbl, stage, arg_max(event_id, created_at) AS event_id FROM ({LOG}) q GROUP BY ALL")
def latest_snapshot(spark, d):
    return H.latest_snapshots(frame(spark, d, LOG)).select("run_id", "tbl", "stage", "event_id")


@query(f"""SELECT tbl, stage, rows_count FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY CASE WHEN stage = 'final' THEN 0 ELSE 1 END, CASE WHEN stage = 'final' THEN 0 ELSE -rows_count END,
 CASE stage WHEN 'verification' THEN 1 WHEN 'fixing' THEN 2 WHEN 'extraction' THEN 3 ELSE 0 END, created_at DESC) AS n FROM (SELECT * FROM ({LOG}) q WHERE NOT contains(description, 'Batch验证')) w) z WHERE n = 1""")
def best_snapshot(spark, d):
    from ..operators.evaluate import best_snapshot as best

    return best(frame(spark, d, LOG)).select("tbl", "stage", "rows_count")


@query("""SELECT tbl, max(n_rows) AS n_rows, max(n_violations) AS n_violations, max(n_errors) AS n_errors, max(n_fixes) AS n_fixes FROM (
SELECT c_mktsegment AS tbl, count(*) AS n_rows, 0 AS n_violations, 0 AS n_errors, 0 AS n_fixes FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 0, count(*), count(*) FILTER (c_custkey % 2 = 0), 0 FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT c_mktsegment, 0, 0, 0, count(*) FROM customer WHERE c_acctbal > 9000 GROUP BY 1) q GROUP BY tbl""")
def run_summary(spark, d):
    c = table(spark, d, "customer").withColumn("tbl", F.col("c_mktsegment"))
    v = c.where("c_acctbal < 0").withColumn("severity", F.when(F.col("c_custkey") % 2 == 0, "error").otherwise("warn"))
    return H.run_summary(c, v, c.where("c_acctbal > 9000"))


@query("""SELECT event_id FROM (SELECT event_id, st, lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, CASE event_type WHEN 'click' THEN 'extracting' WHEN 'view' THEN 'extracted' ELSE 'verifying' END AS st FROM events) q) w
WHERE b IS NOT NULL AND (b, st) NOT IN (('extracting', 'extracted'), ('extracted', 'verifying'))""")
def illegal_transitions(spark, d):
    st = F.when(F.col("event_type") == "click", "extracting").when(F.col("event_type") == "view", "extracted").otherwise("verifying")
    return H.illegal_steps(table(spark, d, "events").withColumn("st", st), "user_id", "st", ["ts", "event_id"]).select("event_id")


@query("SELECT tuple_id, attr, value FROM (SELECT tuple_id, 'c_name' AS attr, c_name AS value FROM {CUS} t UNION ALL SELECT tuple_id, 'c_acctbal', c_acctbal FROM {CUS} t) q")
def flat_cells(spark, d):
    return H.flat_cells(customers(spark, d), ["c_name", "c_acctbal"])


# Normal forms

QMAP = {"q1": "第一季度", "q2": "第二季度", "1": "第一季度"}


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '第一季度' WHEN 1 THEN '第二季度' WHEN 2 THEN '第三季度' WHEN 3 THEN '第一季度' END AS q FROM orders")
def quarter_normalize(spark, d):
    o = table(spark, d, "orders")
    raw = F.element_at(F.array(*(F.lit(x) for x in ("Q1", " q2 ", "2024年第三季度", "1", "spring"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", V.normalise_quarter(raw, QMAP, ("第一季度", "第二季度", "第三季度", "第四季度")).alias("q"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '12.5万元' WHEN 1 THEN '12.5万元' WHEN 2 THEN '30元' END AS amount FROM orders")
def amount_normalize(spark, d):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("12.5万元", "12.5 万", "30", "much"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", V.normalise_amount(raw, r"\d+(?:\.\d+)?(?:万元|元)$", [(r"(\d+(?:\.\d+)?)\s*万$", "{0}万元"), (r"(\d+(?:\.\d+)?)$", "{0}元")]).alias("amount"))


@query("""SELECT p_partkey, length(CAST(p_retailprice AS STRING)) > 0 AND NOT contains('确认,请', p_name) AS ok FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey % 2 = 1""")
def fix_value_validity(spark, d):
    p = table(spark, d, "part")
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("?"))).otherwise(F.lit("请确认数据源"))
    return p.select("p_partkey", V.valid_fix(value).alias("ok"))


@query("""SELECT tuple_id, 't-orders-' || CASE WHEN length(o_orderkey) < 3 THEN lpad(o_orderkey, 3, '0') ELSE o_orderkey END || '-' || substr(md5(o_custkey), 1, 8) AS tid, 'run-' || substr(sha256('s:' || o_custkey || ':p:' || o_orderkey), 1, 16) AS rid, 'f-' || substr(md5('orders:' || tuple_id || ':a:domain_mapping:' || coalesce(o_totalprice, 'None')), 1, 8) AS fid FROM {ORD} t""")
def content_ids(spark, d):
    from ..functions import ids

    return orders(spark, d).select("tuple_id", ids.tuple_id(F.lit("orders"), F.col("o_orderkey"), F.col("o_custkey")).alias("tid"), ids.run_id(F.lit("s"), F.col("o_custkey"), F.lit("p"), F.col("o_orderkey")).alias("rid"), ids.fix_id(F.lit("orders"), F.col("tuple_id"), F.lit("a"), F.lit("domain_mapping"), F.col("o_totalprice")).alias("fid"))


@query("""SELECT c_custkey, v IS NULL OR trim(v) = '' AS blank, v IS NULL OR lower(trim(v)) IN ('', 'null') AS nullword, v IS NULL OR v IN ('', 'null', 'NULL') AS row_void, v IS NULL OR v = '' AS eval_null, v IS NULL OR lower(v) IN ('null', 'none', 'n/a', '') AS llm_null FROM
(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Null' WHEN 3 THEN 'n/a' WHEN 4 THEN '' ELSE c_name END AS v FROM customer) q""")
def empty_predicates(spark, d):
    from ..functions import empties as E

    v = F.when(F.col("c_custkey") % 6 == 0, None).when(F.col("c_custkey") % 6 == 1, "  ").when(F.col("c_custkey") % 6 == 2, "Null").when(F.col("c_custkey") % 6 == 3, "n/a").when(F.col("c_custkey") % 6 == 4, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", v.alias("v")).select("c_custkey", E.is_blank(F.col("v")).alias("blank"), E.is_blank_or_nullword(F.col("v")).alias("nullword"), E.is_row_void(F.col("v")).alias("row_void"), E.is_eval_null(F.col("v")).alias("eval_null"), E.is_llm_null(F.col("v")).alias("llm_null"))
