"""Queries of the verification operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checks as C
from ..operators import setchecks as S
from ..operators import verify as R
from ..plans.schema import parse_schema
from ..sources.numbering import spread
from ..sources.shared import shared_table
from .base import DIRTY_CUSTOMER, DIRTY_ORDERS, LINES, frame, query, table

AS_OF = dt.date(2001, 1, 1)
ORDERS = parse_schema({
    "tables": [
        {"name": "orders", "attributes": {
            "o_orderkey": {"type": "INT", "primary_key": True, "unique": True}, "o_custkey": {"type": "INT", "foreign_key": {"table": "customer", "field": "c_custkey"}},
            "o_orderstatus": {"type": "VARCHAR(2)", "domain": ["F", "O", "P"], "not_null": True}, "o_totalprice": {"type": "float", "min": 0, "max": 450000},
            "o_orderdate": {"type": "date", "min_date": "1995-01-01", "max_date": "2000-06-30", "no_future": True}, "o_open": {"type": "boolean"}, "o_items": {"type": "integer"},
            "o_orderpriority": {"type": "string", "pattern": r"\d-[A-Z]+", "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
        }},
        {"name": "customer", "attributes": {"c_custkey": {"type": "INT", "primary_key": True}, "c_name": {"type": "string", "required": True}, "c_acctbal": {"type": "float"}}},
    ],
    "relations": [{"type": "many-to-one", "from": {"table": "orders", "field": "o_custkey"}, "to": {"table": "customer", "field": "c_custkey"}}],
})
V_COLS = ("tuple_id", "attr", "rule_code", "severity", "suggested_fix")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(frame(spark, d, DIRTY_ORDERS))


def staged_orders(spark: SparkSession, d: str) -> DataFrame:
    """The same as a table: for checks that read it several times, each a few columns."""
    return shared_table(orders(spark, d), "orders")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, DIRTY_CUSTOMER)


def _schema(**attrs) -> C.Table:
    return parse_schema({"tables": [{"name": "t", "attributes": attrs}]}).tables[0]


def _run(df: DataFrame, checks: list, cols=V_COLS) -> DataFrame:
    return R.apply_checks(df, "t", checks).select(*cols)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders against their schema: all row-local checks in one scan, key, reference; de-duplicated, categorised, counted."""
    v = R.verify(staged_orders(spark, d), ORDERS, "orders", {"customer": table(spark, d, "customer")}, as_of=AS_OF)
    v = R.categorise(R.dedup(R.normalise(v)))
    return v.groupBy("constraint_type", "severity", "processing_category").agg(F.count("*").alias("n"))


NUM = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
STRIPPED = "regexp_replace(regexp_replace({0}, '[,¥$€£]', '', 'g'), '^\\s+|\\s+$', '', 'g')"
PRICE = STRIPPED.format("o_totalprice")
KEPT = "coalesce(nullif(regexp_replace({0}, '[^0-9.\\-]', '', 'g'), ''), '0')"


@query(rf"""SELECT tuple_id, 'o_totalprice' AS attr, 'TYPE_FLOAT' AS rule_code, 'warn' AS severity, {KEPT.format('o_totalprice')} AS suggested_fix FROM {{ORD}} t
WHERE o_totalprice IS NOT NULL AND NOT regexp_matches({PRICE}, {NUM})
UNION ALL SELECT tuple_id, 'o_items', 'TYPE_INTEGER', 'warn', {KEPT.format('o_items')} FROM {{ORD}} t WHERE NOT regexp_matches(o_items, '^[+-]?[0-9]+$')""")
def verify_type_numeric(spark, d):
    return _run(orders(spark, d), C.type_checks(_schema(o_totalprice="float", o_items="integer")))


@query("""SELECT tuple_id, 'o_orderdate' AS attr, 'TYPE_DATE' AS rule_code, 'warn' AS severity, o_orderdate AS suggested_fix FROM {ORD} t
WHERE NOT regexp_matches(o_orderdate, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{8})$')""")
def verify_type_date(spark, d):
    return _run(orders(spark, d), C.type_checks(_schema(o_orderdate="date")))


@query("""SELECT tuple_id, 'ts' AS attr, 'TYPE_DATETIME' AS rule_code FROM (SELECT tuple_id, CASE WHEN _seq % 3 = 0 THEN o_orderdate || 'T10:00' ELSE o_orderdate || ' 10:00:00' END AS ts FROM {ORD} t) q
WHERE NOT regexp_matches(split_part(ts, ' ', 1), '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{8})$')""")
def verify_type_datetime(spark, d):
    df = orders(spark, d).withColumn("ts", F.when(F.col("_seq") % 3 == 0, F.concat("o_orderdate", F.lit("T10:00"))).otherwise(F.concat("o_orderdate", F.lit(" 10:00:00"))))
    return _run(df, C.type_checks(_schema(ts="datetime")), ("tuple_id", "attr", "rule_code"))


@query("SELECT tuple_id, 'o_open' AS attr, 'TYPE_BOOLEAN' AS rule_code, 'warn' AS severity, o_open AS suggested_fix FROM {ORD} t WHERE lower(o_open) NOT IN ('true','false','1','0','yes','no','y','n','on','off')")
def verify_type_boolean(spark, d):
    return _run(orders(spark, d), C.type_checks(_schema(o_open="boolean")))


@query(rf"""SELECT tuple_id, 'o_totalprice' AS attr, 'TYPE_DECIMAL' AS rule_code FROM {{ORD}} t WHERE o_totalprice IS NOT NULL AND NOT regexp_matches(o_totalprice, '^[0-9]+\.[0-9]+$')""")
def verify_type_plain_decimal(spark, d):
    return _run(orders(spark, d), C.type_checks(_schema(o_totalprice="decimal")), ("tuple_id", "attr", "rule_code"))


@query(r"""SELECT tuple_id, 'p' AS attr, 'TYPE_SCALE' AS rule_code, 'warn' AS severity, CAST(CAST(p AS DECIMAL(20,2)) AS STRING) AS suggested_fix FROM
(SELECT tuple_id, CASE WHEN _seq % 5 = 0 THEN CAST(_seq AS STRING) WHEN _seq % 5 = 1 THEN CAST(_seq AS STRING) || '.5' ELSE CAST(_seq AS STRING) || '.25' END AS p FROM {ORD} t) q
WHERE CASE WHEN contains(p, '.') THEN length(split_part(p, '.', 2)) ELSE 0 END <> 2""")
def verify_decimal_scale(spark, d):
    n = F.col("_seq").cast("string")
    df = orders(spark, d).withColumn("p", F.when(F.col("_seq") % 5 == 0, n).when(F.col("_seq") % 5 == 1, F.concat(n, F.lit(".5"))).otherwise(F.concat(n, F.lit(".25"))))
    return _run(df, C.type_checks(_schema(p="DECIMAL(20,2)")))


@query("""SELECT tuple_id, 'c_name' AS attr, 'VALUE_MISSING' AS rule_code, 'error' AS severity, '未知' AS suggested_fix FROM {CUS} t WHERE c_name IS NULL OR trim(c_name) = '' OR lower(trim(c_name)) = 'null'""")
def verify_missing_declared(spark, d):
    return _run(customers(spark, d), C.value_checks(_schema(c_name={"type": "VARCHAR(30)", "constraints": ["NOT NULL"]})))


@query("""SELECT tuple_id, 'c_acctbal' AS attr, 'VALUE_MISSING_INFERRED' AS rule_code, 'error' AS severity, '0' AS suggested_fix FROM {CUS} t WHERE c_acctbal IS NULL AND EXISTS (SELECT 1 FROM {CUS} u WHERE c_acctbal IS NOT NULL)""")
def verify_missing_inferred(spark, d):
    return S.inferred_missing(customers(spark, d), "customer", "c_acctbal", "0").select(*V_COLS)


@query("""SELECT tuple_id, 'c_acctbal' AS attr, 'VALUE_RANGE' AS rule_code, 'warn' AS severity, CASE WHEN CAST(c_acctbal AS DOUBLE) < 0 THEN '0' ELSE '9000' END AS suggested_fix FROM {CUS} t WHERE CAST(c_acctbal AS DOUBLE) < 0 OR CAST(c_acctbal AS DOUBLE) > 9000""")
def verify_range(spark, d):
    return _run(customers(spark, d), C.value_checks(_schema(c_acctbal={"type": "float", "min": 0, "max": 9000})))


@query("""SELECT tuple_id, 'o_orderstatus' AS attr, 'VALUE_DOMAIN' AS rule_code, CASE WHEN upper(trim(o_orderstatus)) IN ('F', 'O', 'P') THEN upper(trim(o_orderstatus)) ELSE 'P' END AS suggested_fix
FROM {ORD} t WHERE trim(o_orderstatus) <> '' AND trim(o_orderstatus) NOT IN ('F', 'O', 'P')""")
def verify_domain(spark, d):
    return _run(orders(spark, d), C.value_checks(_schema(o_orderstatus={"domain": ["F", "O", "P"]})), ("tuple_id", "attr", "rule_code", "suggested_fix"))


@query("""SELECT tuple_id, 'c_mktsegment' AS attr, 'VALUE_ENUM' AS rule_code, CASE WHEN c_mktsegment = 'BUILDNG' THEN 'BUILDING' ELSE upper(c_mktsegment) END AS suggested_fix
FROM {CUS} t WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')""")
def verify_enum(spark, d):
    return _run(customers(spark, d), C.value_checks(_schema(c_mktsegment={"enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]})), ("tuple_id", "attr", "rule_code", "suggested_fix"))


CHARS = "list_distinct(string_split(lower({0}), ''))"
JAC = f"len(list_intersect({CHARS.format('value')}, {CHARS.format('r')})) / len(list_distinct(list_concat({CHARS.format('value')}, {CHARS.format('r')})))"


@query(f"""SELECT value, nearest, round(s, 6) AS score FROM (SELECT value, r AS nearest, s, row_number() OVER (PARTITION BY value ORDER BY s DESC, r) AS n FROM
(SELECT value, r, CASE WHEN lower(value) = lower(r) THEN 2.0 ELSE {JAC} END AS s FROM (SELECT DISTINCT c_mktsegment AS value FROM {{CUS}} t) a, (SELECT DISTINCT c_mktsegment AS r FROM customer) b) q) w WHERE n = 1""")
def suggest_nearest_domain(spark, d):
    return S.nearest_reference(customers(spark, d), "c_mktsegment", table(spark, d, "customer"), "c_mktsegment")


@query("""SELECT tuple_id, 'o_orderstatus' AS attr, 'STRUCTURE_NOT_NULL' AS rule_code, 'error' AS severity, '待处理' AS suggested_fix FROM {ORD} t WHERE o_orderstatus IS NULL OR trim(o_orderstatus) = ''""")
def verify_not_null(spark, d):
    return _run(orders(spark, d), C.structure_checks(_schema(o_orderstatus={"not_null": True}), AS_OF))


@query("""SELECT tuple_id, 'l_partkey' AS attr, 'occurs ' || CAST(n AS STRING) || ' times' AS description FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM {LIN} t) q WHERE n > 1""")
def verify_unique(spark, d):
    return S.duplicates(frame(spark, d, LINES), "lineitem", "l_partkey").select("tuple_id", "attr", "description")


@query("""SELECT tuple_id, a AS attr, 'repeats the key of ' || first AS description FROM (SELECT tuple_id, _seq, first_value(tuple_id) OVER w AS first, first_value(_seq) OVER w AS fs FROM {LIN} t
WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY _seq, tuple_id)) q, (VALUES ('l_orderkey'), ('l_linenumber')) k(a) WHERE (tuple_id, _seq) <> (first, fs)""")
def verify_primary_key(spark, d):
    return S.duplicate_keys(frame(spark, d, LINES), "lineitem", ["l_orderkey", "l_linenumber"]).select("tuple_id", "attr", "description")


@query("""SELECT tuple_id, 'o_custkey' AS attr, 'STRUCTURE_KEY_NULL' AS rule_code FROM (SELECT tuple_id, CASE WHEN _seq % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM {ORD} t) q WHERE o_custkey IS NULL""")
def verify_primary_key_null(spark, d):
    df = orders(spark, d).withColumn("o_custkey", F.when(F.col("_seq") % 11 == 0, None).otherwise(F.col("o_custkey")))
    return _run(df, C.structure_checks(_schema(o_custkey={"primary_key": True}), AS_OF), ("tuple_id", "attr", "rule_code"))


@query("""SELECT tuple_id, 'c_name' AS attr, 'FORMAT_PATTERN' AS rule_code, 'warn' AS severity FROM {CUS} t WHERE c_name IS NOT NULL AND trim(c_name) <> '' AND NOT regexp_matches(c_name, '^(?:Customer#[0-9]{9})')""")
def verify_pattern(spark, d):
    return _run(customers(spark, d), C.format_checks(_schema(c_name={"pattern": r"Customer#\d{9}"})), ("tuple_id", "attr", "rule_code", "severity"))


@query("""SELECT tuple_id, 'o_orderpriority' AS attr, 'FORMAT_CONFIG' AS rule_code FROM {ORD} t WHERE NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)')""")
def verify_pattern_config(spark, d):
    return _run(orders(spark, d), C.format_checks(_schema(o_orderpriority="string"), {"o_orderpriority": "[1-3]-"}), ("tuple_id", "attr", "rule_code"))


@query("""SELECT tuple_id, 'o_orderdate' AS attr, 'TEMPORAL_PARSE' AS rule_code FROM {ORD} t WHERE o_orderdate IN ('2024-13-45', 'soon')""")
def verify_temporal_parse(spark, d):
    return _run(orders(spark, d), [c for c in C.temporal_checks(_schema(o_orderdate="date"), AS_OF) if c.code == "TEMPORAL_PARSE"], ("tuple_id", "attr", "rule_code"))


@query("""SELECT tuple_id, 'o_orderdate' AS attr, code AS rule_code, fix AS suggested_fix FROM (SELECT tuple_id, TRY_CAST(replace(o_orderdate, '/', '-') AS DATE) AS dd FROM {ORD} t) q,
(VALUES ('TEMPORAL_MIN_DATE', '1995-01-01'), ('TEMPORAL_MAX_DATE', '2000-06-30'), ('TEMPORAL_FUTURE', '2001-01-01')) k(code, fix)
WHERE CASE WHEN code = 'TEMPORAL_MIN_DATE' THEN dd < CAST(fix AS DATE) ELSE dd > CAST(fix AS DATE) END""")
def verify_temporal_bounds(spark, d):
    t = _schema(o_orderdate={"type": "date", "min_date": "1995-01-01", "max_date": "2000-06-30", "no_future": True})
    return _run(orders(spark, d), [c for c in C.temporal_checks(t, AS_OF) if c.code != "TEMPORAL_PARSE"], ("tuple_id", "attr", "rule_code", "suggested_fix"))


@query("""SELECT concat('t-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS tuple_id, 'shipdate' AS attr, CAST(CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS STRING) AS suggested_fix
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)""")
def verify_temporal_order_delivery(spark, d):
    df = frame(spark, d, """SELECT concat('t-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS tuple_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS orderdate,
        CAST(CAST(l_shipdate AS DATE) AS STRING) AS shipdate FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""")
    return _run(df, [c for c in C.temporal_checks(_schema(orderdate="date", shipdate="date"), AS_OF) if c.code == "TEMPORAL_ORDER_DELIVERY"], ("tuple_id", "attr", "suggested_fix"))


@query("""SELECT tuple_id, 'enddate' AS attr, 'TEMPORAL_START_END' AS rule_code FROM (SELECT tuple_id, TRY_CAST(replace(o_orderdate, '/', '-') AS DATE) AS s, CASE WHEN _seq % 3 = 0 THEN DATE '1996-01-01' ELSE DATE '2003-01-01' END AS e FROM {ORD} t) q WHERE e < s""")
def verify_temporal_start_end(spark, d):
    df = orders(spark, d).select("tuple_id", F.col("o_orderdate").alias("startdate"), F.when(F.col("_seq") % 3 == 0, "1996-01-01").otherwise("2003-01-01").alias("enddate"))
    return _run(df, [c for c in C.temporal_checks(_schema(startdate="date", enddate="date"), AS_OF) if c.code == "TEMPORAL_START_END"], ("tuple_id", "attr", "rule_code"))


GAPPED = "SELECT CAST(o_orderkey AS STRING) AS tuple_id, o_orderkey AS _seq, CASE WHEN year(o_orderdate) IN (1995, 1997, 2000) THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS dd FROM {orders}"


@query(f"""SELECT tuple_id, 'dd' AS attr, CAST(g AS STRING) || ' days after the date before' AS description FROM (SELECT tuple_id, date_diff('day', lag(CAST(dd AS DATE)) OVER (ORDER BY dd, _seq), CAST(dd AS DATE)) AS g FROM ({GAPPED}) q WHERE dd IS NOT NULL) w WHERE g > 365""")
def verify_temporal_gap(spark, d):
    return S.sequence_gaps(frame(spark, d, GAPPED), "orders", "dd").select("tuple_id", "attr", "description")


@query("SELECT tuple_id, 'o_custkey' AS attr, 'no such value: ' || o_custkey AS description FROM {ORD} t WHERE o_custkey NOT IN (SELECT CAST(c_custkey AS STRING) FROM customer)")
def verify_foreign_key(spark, d):
    return S.foreign_key(orders(spark, d), "orders", "o_custkey", table(spark, d, "customer"), "c_custkey").select("tuple_id", "attr", "description")


@query("SELECT CAST(doc_id AS STRING) AS tuple_id, 'doc_id' AS attr, 'REFERENCE_RELATION' AS rule_code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def verify_relation(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("tuple_id"))
    return S.relation(p, "documents", "doc_id", table(spark, d, "labels"), "doc_id").select("tuple_id", "attr", "rule_code")


@query("SELECT tuple_id, 'c_acctbal' AS attr, 'REFERENCE_NULL' AS rule_code FROM {CUS} t WHERE c_acctbal IS NULL")
def verify_relation_nulls(spark, d):
    return S.relation_nulls(customers(spark, d), "customer", "c_acctbal").select("tuple_id", "attr", "rule_code")


def _lines_calc(spark, d, expr: str):
    return frame(spark, d, f"SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS tuple_id, l_quantity AS a, l_tax AS b, {expr} AS c FROM {{lineitem}}")


_CALC = "SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS tuple_id, 'c' AS attr, round({0}, 6) AS fix FROM lineitem WHERE abs({1} - ({0})) > 0.01"


@query(_CALC.format("l_quantity + l_tax", "(CASE WHEN l_orderkey % 9 = 0 THEN l_quantity ELSE l_quantity + l_tax END)"))
def verify_calculated_sum(spark, d):
    df = _lines_calc(spark, d, "CASE WHEN l_orderkey % 9 = 0 THEN l_quantity ELSE l_quantity + l_tax END")
    return _run(df, C.aggregation_checks(_schema(a="float", b="float", c={"type": "float", "calculated": True, "calculation": {"type": "sum", "fields": ["a", "b"]}}))).select("tuple_id", "attr", F.col("suggested_fix").cast("double").alias("fix"))


@query(_CALC.format("l_quantity * l_tax", "(CASE WHEN l_orderkey % 9 = 0 THEN l_quantity ELSE l_quantity * l_tax END)"))
def verify_calculated_multiply(spark, d):
    df = _lines_calc(spark, d, "CASE WHEN l_orderkey % 9 = 0 THEN l_quantity ELSE l_quantity * l_tax END")
    return _run(df, C.aggregation_checks(_schema(a="float", b="float", c={"type": "float", "calculated": True, "calculation": {"type": "multiply", "fields": ["a", "b"]}}))).select("tuple_id", "attr", F.col("suggested_fix").cast("double").alias("fix"))


@query(_CALC.format("l_tax / l_quantity * 100", "(CASE WHEN l_orderkey % 9 = 0 THEN l_quantity ELSE l_tax / l_quantity * 100 END)"))
def verify_calculated_percentage(spark, d):
    df = _lines_calc(spark, d, "CASE WHEN l_orderkey % 9 = 0 THEN l_quantity ELSE l_tax / l_quantity * 100 END")
    return _run(df, C.aggregation_checks(_schema(a="float", b="float", c={"type": "float", "calculated": True, "calculation": {"type": "percentage", "numerator": "b", "denominator": "a"}}))).select("tuple_id", "attr", F.col("suggested_fix").cast("double").alias("fix"))


@query("SELECT 'total' AS tuple_id, 'p_size' AS attr, CAST(sum(p_size) AS DOUBLE) AS fix FROM part HAVING sum(p_size) <> 7")
def verify_total_row(spark, d):
    df = frame(spark, d, "SELECT CAST(p_partkey AS STRING) AS tuple_id, p_name AS label, CAST(p_size AS STRING) AS p_size FROM {part} UNION ALL SELECT 'total', 'Total', '7'")
    return S.summary_rows(df, "part", ["label", "p_size"]).select("tuple_id", "attr", F.col("suggested_fix").cast("double").alias("fix"))


@query("SELECT 'average' AS tuple_id, 'p_size' AS attr, round(avg(p_size), 1) AS fix FROM part")
def verify_average_row(spark, d):
    df = frame(spark, d, "SELECT CAST(p_partkey AS STRING) AS tuple_id, p_name AS label, CAST(p_size AS STRING) AS p_size FROM {part} UNION ALL SELECT 'average', 'Average', '7'")
    return S.summary_rows(df, "part", ["label", "p_size"], average=True).select("tuple_id", "attr", F.round(F.col("suggested_fix").cast("double"), 1).alias("fix"))


@query("SELECT 'AGGREGATION_' || CAST(l_orderkey AS STRING) AS tuple_id, count(*) AS n, string_agg(tuple_id, ',' ORDER BY tuple_id) AS members FROM {LIN} t GROUP BY l_orderkey HAVING count(*) > 6")
def verify_group_cardinality(spark, d):
    return S.group_limit(frame(spark, d, LINES), "lineitem", "l_orderkey", 6).select("tuple_id", F.size("affected_tuple_ids").cast("long").alias("n"), F.array_join("affected_tuple_ids", ",").alias("members"))


@query("SELECT 'GROUP_' || CAST(l_orderkey AS STRING) AS tuple_id FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING sum(p_size) > 150")
def verify_join_aggregate(spark, d):
    return S.join_limit(frame(spark, d, LINES), "lineitem", "l_orderkey", "l_partkey", table(spark, d, "part"), "p_partkey", "p_size", 150).select("tuple_id")


@query("SELECT CAST(s_suppkey AS STRING) AS tuple_id, 'end_cash' AS attr, 'phi_2' AS business_rule_id FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_acctbal <> 0 AND abs(c_acctbal / s_acctbal) >= 10")
def verify_cash_ratio(spark, d):
    df = frame(spark, d, "SELECT CAST(s_suppkey AS STRING) AS tuple_id, s_acctbal AS begin_cash, c_acctbal AS end_cash FROM {supplier} JOIN {customer} ON s_suppkey = c_custkey")
    return _run(df.withColumns({c: F.format_string("%.2f", c) for c in ("begin_cash", "end_cash")}), [C.cash_ratio("begin_cash", "end_cash")], ("tuple_id", "attr", "business_rule_id"))


@query("SELECT tuple_id, 'c_acctbal' AS attr, 'LOGIC_RANGE' AS rule_code FROM {CUS} t WHERE CAST(c_acctbal AS DOUBLE) NOT BETWEEN 100 AND 8000 UNION ALL SELECT tuple_id, 'c_name', 'LOGIC_PATTERN' FROM {CUS} t WHERE c_name IS NOT NULL AND NOT starts_with(c_name, 'Customer')")
def verify_business_rules(spark, d):
    t = _schema(c_acctbal={"business_rules": [{"type": "range", "min": 100, "max": 8000}]}, c_name={"business_rules": [{"type": "pattern", "pattern": "Customer"}]})
    return _run(customers(spark, d), C.logic_checks(t), ("tuple_id", "attr", "rule_code"))


EDGES = "SELECT DISTINCT CAST(o_custkey AS STRING) AS src, CAST(o_orderkey % 1000 AS STRING) AS dst FROM {orders}"


def _edges(spark, d):
    return S.edges(frame(spark, d, EDGES), "src", "dst")


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT least(x.src, x.dst) AS a, greatest(x.src, x.dst) AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src")
def graph_mutual(spark, d):
    return S.mutual(_edges(spark, d))


@query(f"SELECT src FROM ({EDGES}) e WHERE src = dst")
def graph_self(spark, d):
    return S.loops(_edges(spark, d))


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT x.src AS a, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.src AND z.dst = y.dst)")
def graph_missing_transitive(spark, d):
    return S.missing_transitive(_edges(spark, d))


CHAIN = "SELECT CAST(n_nationkey AS STRING) AS src, CAST(n_nationkey + 1 + n_regionkey AS STRING) AS dst FROM {nation}"


@query(f"WITH RECURSIVE e AS ({CHAIN}), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src) SELECT src, dst FROM p")
def graph_closure(spark, d):
    return S.closure(S.edges(frame(spark, d, CHAIN), "src", "dst"))


@query("SELECT 'b' AS tbl, 'CROSS_TABLE' AS tuple_id, 'k' AS attr, 'CROSS_TYPE' AS rule_code")
def crosstable_type(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    b = table(spark, d, "region").select(F.col("r_name").alias("k"))
    return S.type_consistency({"a": a, "b": b}, "k").select("tbl", "tuple_id", "attr", "rule_code")


@query("""WITH v AS (SELECT DISTINCT 'customer' AS tbl, c_nationkey AS k FROM customer UNION ALL SELECT DISTINCT 'supplier', s_nationkey FROM supplier), t AS (SELECT k, count(*) AS t FROM v GROUP BY k)
SELECT tbl, count(*) AS n_values, count(*) FILTER (t = 2) AS n_common, count(*) FILTER (t = 1) AS n_exclusive, round(count(*) FILTER (t = 1) / count(*), 6) AS exclusive_share FROM v JOIN t USING (k) GROUP BY tbl""")
def crosstable_domain_report(spark, d):
    return S.domain_report({"customer": table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "supplier": table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))}, "k")


@query(r"""SELECT tbl, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date_iso' WHEN regexp_matches(v, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(v, '^[A-Z]+$') THEN 'uppercase' WHEN regexp_matches(v, '^[a-z]+$') THEN 'lowercase' ELSE 'mixed' END AS pattern, count(*) AS n
FROM (SELECT 'o' AS tbl, o_orderdate AS v FROM {ORD} t UNION ALL SELECT 'c', c_mktsegment FROM {CUS} t) q GROUP BY ALL""")
def crosstable_format_report(spark, d):
    return S.format_report({"o": orders(spark, d).select(F.col("o_orderdate").alias("v")), "c": customers(spark, d).select(F.col("c_mktsegment").alias("v"))}, "v")


@query(r"""SELECT v, CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(v, '^[0-9]+\.[0-9]+$') THEN 'decimal' WHEN regexp_matches(v, '^[A-Z][a-z]+$') THEN 'capitalized_word'
 WHEN regexp_matches(v, '^[A-Z]+$') THEN 'uppercase' WHEN regexp_matches(v, '^[a-z]+$') THEN 'lowercase' ELSE 'mixed' END AS pattern FROM (SELECT DISTINCT p_type AS v FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT CAST(p_size AS STRING) FROM part) q""")
def string_pattern_class(spark, d):
    p = table(spark, d, "part")
    v = p.select(F.col("p_type").alias("v")).union(p.select(F.substring_index("p_name", " ", 1))).union(p.select(F.col("p_size").cast("string"))).distinct()
    return v.select("v", V.string_pattern(F.col("v")).alias("pattern"))


@query("""WITH v AS (SELECT DISTINCT p_name AS x FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)
SELECT p.x AS a, q.x AS b FROM v p, v q WHERE p.x <> q.x AND p.x <> '' AND q.x <> '' AND (
 ((contains(p.x, q.x) OR contains(q.x, p.x)) AND least(length(p.x), length(q.x)) >= 2)
 OR (1 - levenshtein(p.x, q.x) / greatest(length(p.x), length(q.x)) > 0.9 AND least(length(p.x), length(q.x)) >= 5))""")
def similar_entities(spark, d):
    p = table(spark, d, "part")
    v = p.select(F.col("p_name").alias("value")).union(p.select(F.substring_index("p_name", " ", -1))).distinct()
    return S.similar_pairs(v, v)


_DATE = "TRY_CAST(replace(o_orderdate, '/', '-') AS DATE)"
_NEAREST = f"""SELECT value, arg_min(r, (-s, r)) AS fix FROM (SELECT value, r, {JAC} AS s FROM (SELECT DISTINCT o_custkey AS value FROM {{ORD}} t WHERE o_custkey NOT IN (SELECT CAST(c_custkey AS STRING) FROM customer)) a, (SELECT CAST(c_custkey AS STRING) AS r FROM customer) b) q GROUP BY value"""
_TYPES = rf"""SELECT tuple_id, 'o_totalprice' AS attr, 'TYPE_FLOAT' AS rule_code, 'warn' AS severity, {KEPT.format('o_totalprice')} AS fix, 'TYPE' AS kind FROM {{ORD}} t WHERE o_totalprice IS NOT NULL AND NOT regexp_matches({PRICE}, {NUM})
UNION ALL SELECT tuple_id, 'o_items', 'TYPE_INTEGER', 'warn', {KEPT.format('o_items')}, 'TYPE' FROM {{ORD}} t WHERE NOT regexp_matches(o_items, '^[+-]?[0-9]+$')
UNION ALL SELECT tuple_id, 'o_open', 'TYPE_BOOLEAN', 'warn', o_open, 'TYPE' FROM {{ORD}} t WHERE lower(o_open) NOT IN ('true','false','1','0','yes','no','y','n','on','off')
UNION ALL SELECT tuple_id, 'o_orderdate', 'TYPE_DATE', 'warn', o_orderdate, 'TYPE' FROM {{ORD}} t WHERE o_orderdate = 'soon'"""
_ALL = rf"""{_TYPES}
UNION ALL SELECT tuple_id, 'o_orderstatus', 'STRUCTURE_NOT_NULL', 'error', '待处理', 'STRUCTURE' FROM {{ORD}} t WHERE o_orderstatus IS NULL OR trim(o_orderstatus) = ''
UNION ALL SELECT tuple_id, 'o_orderstatus', 'VALUE_DOMAIN', 'warn', CASE WHEN upper(trim(o_orderstatus)) IN ('F', 'O', 'P') THEN upper(trim(o_orderstatus)) ELSE 'P' END, 'VALUE' FROM {{ORD}} t WHERE trim(o_orderstatus) <> '' AND trim(o_orderstatus) NOT IN ('F', 'O', 'P')
UNION ALL SELECT tuple_id, 'o_totalprice', 'VALUE_MISSING_INFERRED', 'error', '0', 'VALUE' FROM {{ORD}} t WHERE o_totalprice IS NULL
UNION ALL SELECT tuple_id, 'o_totalprice', 'VALUE_RANGE', 'warn', CASE WHEN p < 0 THEN '0' ELSE '450000' END, 'VALUE' FROM (SELECT tuple_id, TRY_CAST({PRICE} AS DOUBLE) AS p FROM {{ORD}} t) q WHERE p < 0 OR p > 450000
UNION ALL SELECT tuple_id, 'o_orderdate', 'TEMPORAL_PARSE', 'warn', o_orderdate, 'TEMPORAL' FROM {{ORD}} t WHERE {_DATE} IS NULL
UNION ALL SELECT tuple_id, 'o_orderdate', CASE WHEN dd > DATE '2001-01-01' THEN 'TEMPORAL_FUTURE' WHEN dd > DATE '2000-06-30' THEN 'TEMPORAL_MAX_DATE' ELSE 'TEMPORAL_MIN_DATE' END, 'warn',
 CASE WHEN dd > DATE '2001-01-01' THEN '2001-01-01' WHEN dd > DATE '2000-06-30' THEN '2000-06-30' ELSE '1995-01-01' END, 'TEMPORAL' FROM (SELECT tuple_id, {_DATE} AS dd FROM {{ORD}} t) q WHERE dd > DATE '2000-06-30' OR dd < DATE '1995-01-01'
UNION ALL SELECT tuple_id, 'o_custkey', 'REFERENCE_FOREIGN_KEY', 'error', fix, 'REFERENCE' FROM {{ORD}} t JOIN ({_NEAREST}) n ON o_custkey = value"""
_ID = "'v-' || substr(md5('orders:' || tuple_id || ':' || attr || ':' || lower(kind)), 1, 8)"


def _violations(spark, d):
    return R.verify(staged_orders(spark, d), ORDERS, "orders", {"customer": table(spark, d, "customer")}, as_of=AS_OF)


@query(f"SELECT {_ID} AS id, 'orders' AS tbl, tuple_id, attr, rule_code, severity, fix AS suggested_fix, kind AS constraint_type, 'tool_fixable' AS processing_category FROM ({_ALL}) v")
def verify_table(spark, d):
    """Everything the schema declares on orders, as rows."""
    return R.categorise(R.dedup(R.normalise(_violations(spark, d)))).select("id", "tbl", *V_COLS, "constraint_type", "processing_category")


@query(f"SELECT {_ID} AS id, tuple_id, attr, rule_code, severity, fix AS suggested_fix FROM ({_TYPES}) v")
def verify_basic(spark, d):
    return R.verify_basic(orders(spark, d), ORDERS, "orders", AS_OF).select("id", *V_COLS)


@query(f"SELECT {_ID} AS id, 'orders' AS tbl, tuple_id, attr, rule_code FROM (SELECT tuple_id, 'o_custkey' AS attr, 'REFERENCE_RELATION' AS rule_code, 'REFERENCE' AS kind FROM {{ORD}} t WHERE o_custkey NOT IN (SELECT CAST(c_custkey AS STRING) FROM customer)) v")
def verify_multi_table(spark, d):
    return R.verify_multi({"orders": orders(spark, d), "customer": customers(spark, d)}, ORDERS).select("id", "tbl", "tuple_id", "attr", "rule_code")


_RAW = """SELECT 'orders' AS tbl, tuple_id, attr, kind, code, 'v-' || substr(md5('orders:' || tuple_id || ':' || attr || ':' || lower(kind)), 1, 8) AS id FROM (
 SELECT tuple_id, 'o_orderstatus' AS attr, 'VALUE' AS kind, 'VALUE_DOMAIN' AS code FROM {ORD} t WHERE trim(o_orderstatus) <> '' AND trim(o_orderstatus) NOT IN ('F', 'O', 'P')
 UNION ALL SELECT tuple_id, 'o_orderstatus', 'STRUCTURE', 'STRUCTURE_NOT_NULL' FROM {ORD} t WHERE trim(o_orderstatus) = ''
 UNION ALL SELECT tuple_id, 'o_orderstatus', 'VALUE', 'VALUE_ENUM' FROM {ORD} t WHERE trim(o_orderstatus) <> '' AND trim(o_orderstatus) NOT IN ('F', 'O')) q"""


def _raw(spark, d):
    t = parse_schema({"tables": [{"name": "orders", "attributes": {"o_orderstatus": {"type": "string", "domain": ["F", "O", "P"], "enum": ["F", "O"], "not_null": True}}}]}).tables[0]
    return R.with_ids(R.apply_checks(orders(spark, d), "orders", C.value_checks(t) + C.structure_checks(t, AS_OF)))


@query(f"SELECT id, tuple_id, min(code) AS rule_code FROM ({_RAW}) r GROUP BY id, tuple_id, attr, kind")
def dedup_violations(spark, d):
    return R.dedup(_raw(spark, d)).select("id", "tuple_id", "rule_code")


@query(f"SELECT CASE WHEN kind = 'VALUE' OR code = 'STRUCTURE_NOT_NULL' THEN 'tool_fixable' ELSE 'reextraction' END AS processing_category, code AS rule_code, count(*) AS n FROM ({_RAW}) r GROUP BY ALL")
def categorize_violations(spark, d):
    return R.categorise(_raw(spark, d)).groupBy("processing_category", "rule_code").agg(F.count("*").alias("n"))


@query(f"""SELECT kind AS constraint_type, NULL AS severity, NULL AS tbl, count(*) AS n FROM ({_RAW}) r GROUP BY kind UNION ALL SELECT NULL, CASE WHEN kind = 'VALUE' THEN 'warn' ELSE 'error' END, NULL, count(*) FROM ({_RAW}) r GROUP BY 2
UNION ALL SELECT NULL, NULL, tbl, count(*) FROM ({_RAW}) r GROUP BY tbl""")
def violation_summary(spark, d):
    return R.summary(_raw(spark, d))


@query(f"SELECT kind AS constraint_type, attr, count(*) AS n FROM ({_RAW}) r GROUP BY ALL")
def violations_by_attribute(spark, d):
    return R.by_attribute(_raw(spark, d))
