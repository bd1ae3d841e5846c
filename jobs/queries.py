"""The jobs as queries: each runs twice into a new folder, and its whole output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import document_intake, nightly_verification
from jobs.settings import load
from rowproof.queries.documents import CHUNKS_SQL
from rowproof.sources.shared import shared_folder

OUT = ("doc_id", "name", "language", "words", "locate", "idx", "start", "stop", "chunk_key")


def job1_document_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, taken by a stream whose second run finds nothing new."""
    to = shared_folder(spark, "job1")
    for _ in range(2):
        document_intake.intake(spark, f"{sf_dir}/documents.parquet", f"{to}/chunks", f"{to}/checkpoint", load("document_intake"))
    return spark.read.parquet(f"{to}/chunks").select(*OUT)


def job2_nightly_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations, fixes and repaired cells of orders and customers; the second run overwrites the first."""
    to, settings = shared_folder(spark, "job2"), load("nightly_verification")
    for _ in range(2):
        nightly_verification.verify_run(spark, sf_dir, to, settings)
    return nightly_verification.read_back(spark, to, settings)


_HAN = "length(regexp_replace(text, '[^一-龥]', '', 'g'))"
_D = f"SELECT doc_id, source, coalesce(text, '') AS text, {_HAN} AS han, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+')) AS runs FROM documents"

SQL = {
    "job1_document_intake": f"""WITH d AS ({_D}), c AS ({CHUNKS_SQL})
SELECT d.doc_id, source AS name, CASE WHEN coalesce(han, 0) / greatest(length(text), 1) > 0.1 THEN 'zh' ELSE 'en' END AS language, CAST(coalesce(han, 0) + runs AS BIGINT) AS words, coalesce(han, 0) + runs > 2000 AS locate,
  idx, start, stop, sha256(chunk) AS chunk_key FROM c JOIN d USING (doc_id)""",
    "job2_nightly_verification": """
WITH o AS (SELECT 'orders-' || o_orderkey AS tuple_id, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders),
c AS (SELECT 'customer-' || c_custkey AS tuple_id, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS c_acctbal FROM customer),
v AS (SELECT 'orders' AS tbl, tuple_id, 'o_totalprice' AS attr, 'VALUE_RANGE' AS code, 'domain_mapping' AS kind, '450000' AS fix FROM o WHERE CAST(o_totalprice AS DOUBLE) > 450000
  UNION ALL SELECT 'orders', tuple_id, 'o_orderdate', 'TEMPORAL_MIN_DATE', 'temporal_correction', '1995-01-01' FROM o WHERE o_orderdate < '1995-01-01'
  UNION ALL SELECT 'orders', tuple_id, 'o_orderdate', 'TEMPORAL_MAX_DATE', 'temporal_correction', '2000-06-30' FROM o WHERE o_orderdate > '2000-06-30'
  UNION ALL SELECT 'customer', tuple_id, 'c_acctbal', 'VALUE_RANGE', 'domain_mapping', '0' FROM c WHERE CAST(c_acctbal AS DOUBLE) < 0),
cells AS (SELECT 'orders' AS tbl, tuple_id, unnest([{'a': 'o_orderkey', 'v': o_orderkey}, {'a': 'o_custkey', 'v': o_custkey}, {'a': 'o_orderstatus', 'v': o_orderstatus}, {'a': 'o_totalprice', 'v': o_totalprice}, {'a': 'o_orderdate', 'v': o_orderdate}]) AS x FROM o
  UNION ALL SELECT 'customer', tuple_id, unnest([{'a': 'c_custkey', 'v': c_custkey}, {'a': 'c_name', 'v': c_name}, {'a': 'c_acctbal', 'v': c_acctbal}]) FROM c)
SELECT 'violations' AS output, tbl, tuple_id, attr, code || ' tool_fixable' AS code, fix AS value FROM v
UNION ALL SELECT 'fixes', tbl, tuple_id, attr, kind, fix FROM v
UNION ALL SELECT 'rows', r.tbl, r.tuple_id, r.x.a, NULL, coalesce(v.fix, r.x.v) FROM cells r LEFT JOIN v ON v.tbl = r.tbl AND v.tuple_id = r.tuple_id AND v.attr = r.x.a""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_document_intake, job2_nightly_verification)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
