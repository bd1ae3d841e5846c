"""Sources: documents, JSON row logs, gold tables, reference tables, dataset cases."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import Rule, Schema, parse_schema

EXTENSIONS = ("pdf", "txt", "md", "docx", "doc")
CELL = "STRUCT<value: STRING, evidences: ARRAY<STRING>, best: STRUCT<value: STRING>>"
SNAPSHOT = f"run_id STRING, table STRING, table_id STRING, created_at STRING, processing_stage STRING, stage_description STRING, rows_count BIGINT, rows ARRAY<STRUCT<tuple_id: STRING, cells: MAP<STRING, {CELL}>>>"


def read_schema(spark: SparkSession, path: str) -> Schema:
    """One small file, through Spark's readers so that any store will do."""
    return parse_schema(spark.read.text(path, wholetext=True).first()[0])


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, length of the files with a document extension, recursively, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    return files.select("path", "length").orderBy("path")


def read_documents(spark: SparkSession, root: str, parse: Callable | None = None) -> DataFrame:
    """path, text: UTF-8, else GBK; other formats through parse (iterator of pandas frames) or as ''."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    plain = F.col("path").rlike(r"(?i)\.(txt|md)$")
    valid = F.expr("is_valid_utf8(cast(content as string))")
    out = files.where(plain & valid).select("path", F.expr("cast(content as string)").alias("text"))

    def gbk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"path": p["path"], "text": [bytes(c).decode("gbk", "replace") for c in p["content"]]})

    out = out.unionByName(files.where(plain & ~valid).select("path", "content").mapInPandas(gbk, "path string, text string"))
    other = files.where(~plain)
    made = other.select("path", "content").mapInPandas(parse, "path string, text string") if parse else other.select("path", F.lit("").alias("text"))
    return out.unionByName(made)


def cell_value(cell: Column) -> Column:
    """value, else best.value."""
    return F.coalesce(cell["value"], cell["best"]["value"])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (blank ones skipped): run_id, table, stage, tuple_id, cells as map of texts.

    A broken line fails the read; broken_lines tells which ones they are.
    """
    log = spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path)
    rows = log.select("run_id", "table", F.col("processing_stage").alias("stage"), "created_at", F.inline("rows"))
    return rows.withColumn("cells", F.transform_values("cells", lambda _, c: cell_value(c)))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line of the lines that are no JSON of a snapshot."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    bad = F.from_json("line", SNAPSHOT + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"]
    return lines.where(bad.isNotNull())


HISTORY = {
    "snapshots": "run_id STRING, tbl STRING, stage STRING, stage_description STRING, rows_count BIGINT, created_at STRING",
    "violations": "run_id STRING, id STRING, tbl STRING, tuple_id STRING, attr STRING, constraint_type STRING, rule_code STRING, severity STRING, description STRING, suggested_fix STRING, processing_category STRING",
    "fixes": "run_id STRING, id STRING, tbl STRING, tuple_id STRING, attr STRING, old STRING, new STRING, fix_type STRING, round INT",
}


def read_history(spark: SparkSession, root: str, kind: str, **wanted: str) -> DataFrame:
    """snapshots, violations or fixes of a run folder: its Parquet table, else its JSON lines, else no rows.

    wanted: values that columns must have, such as run_id or tbl.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    if there(f"{root}/{kind}"):
        rows = spark.read.parquet(f"{root}/{kind}")
    elif there(f"{root}/{kind}.jsonl"):
        rows = spark.read.schema(HISTORY[kind]).option("mode", "FAILFAST").json(f"{root}/{kind}.jsonl")
    else:
        rows = spark.createDataFrame([], HISTORY[kind])
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    return rows


def history_views(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Registers the three tables and run_summary (counts by run and table) as views to be asked in SQL."""
    for kind in HISTORY:
        read_history(spark, root, kind).createOrReplaceTempView(prefix + kind)
    spark.sql(f"""SELECT run_id, tbl, sum(v) AS n_violations, sum(e) AS n_errors, sum(f) AS n_fixes FROM (
        SELECT run_id, tbl, 1 AS v, CAST(severity = 'error' AS INT) AS e, 0 AS f FROM {prefix}violations UNION ALL SELECT run_id, tbl, 0, 0, 1 FROM {prefix}fixes
    ) GROUP BY run_id, tbl""").createOrReplaceTempView(f"{prefix}run_summary")
    return [prefix + k for k in (*HISTORY, "run_summary")]


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """{table: [{attr: value}]}: tbl, _seq, cells as map of texts (absent cells stay absent)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, ARRAY<MAP<STRING, STRING>>>").alias("t"))
    return text.select(F.explode("t").alias("tbl", "rows")).select("tbl", F.posexplode("rows").alias("_seq", "cells"))


def wide(cells: DataFrame, names: list[str]) -> DataFrame:
    """Map form to wide form."""
    return cells.select(*(c for c in cells.columns if c != "cells"), *(F.try_element_at("cells", F.lit(n)).alias(n) for n in names))


def read_reference(spark: SparkSession, path: str, fields: list[str], view: str | None = None) -> DataFrame:
    """A JSON table (list of rows) reduced to its key fields, with tuple ids by position."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "ARRAY<MAP<STRING, STRING>>").alias("rows"))
    out = text.select(F.posexplode("rows").alias("n", "cells")).select(F.concat(F.lit("ref-"), F.col("n").cast("string")).alias("tuple_id"), *(F.try_element_at("cells", F.lit(f)).alias(f) for f in fields))
    if view:
        out.createOrReplaceTempView(view)
    return out


def entity_references(schema: Schema, table: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For every attribute like XxxID the table Xxx, where there is one."""
    found = {a.name: schema.reference_of(a.name) for a in schema.table(table).attrs}
    return {a: tables[t] for a, t in found.items() if t and t != table and t in tables}


def table_sources(schema: Schema, table: str, default: list[str]) -> list[str]:
    """Documents of a table: its own declaration, else the common ones."""
    return list(schema.table(table).extraction.get("document_sources") or default)


def _cases(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def dataset_cases(spark: SparkSession, root: str) -> DataFrame:
    """db, case of the folders <root>/<db>/<case> that hold schema.json, answer.json and at least one document."""
    at = lambda df, depth: df.select(*(F.element_at(F.split("path", "/"), -depth + k).alias(n) for k, n in enumerate(("db", "case"))))
    schema, answer = at(_cases(spark, root, "schema.json"), 3).distinct(), at(_cases(spark, root, "answer.json"), 3).distinct()
    docs = _cases(spark, root, "*.{" + ",".join(EXTENSIONS) + "}").where(F.contains("path", F.lit("/docs/")))
    parts = F.split(F.substring_index(F.col("path"), "/docs/", 1), "/")
    docs = docs.select(F.element_at(parts, -2).alias("db"), F.element_at(parts, -1).alias("case")).distinct()
    return schema.join(answer, ["db", "case"], "left_semi").join(docs, ["db", "case"], "left_semi").orderBy("db", "case")


def method_outputs(spark: SparkSession, root: str) -> DataFrame:
    """db, case, method, path of <root>/<db>/<case>/<method>/*.json, by name."""
    parts = F.split("path", "/")
    return _cases(spark, root, "*.json").select(F.element_at(parts, -4).alias("db"), F.element_at(parts, -3).alias("case"), F.element_at(parts, -2).alias("method"), "path").orderBy("db", "case", "method")


def aggregation_rules(text: str) -> list[Rule]:
    """Aggregation rules of a rule file's JSON: a list, or a dict by id, with group_by and a limit each."""
    spec = json.loads(text)
    spec = spec.get("aggregation_rules", spec) if isinstance(spec, dict) else spec
    named = [{"id": k, **r} for k, r in spec.items() if isinstance(r, dict)] if isinstance(spec, dict) else spec
    logic = lambda r: r.get("validation_logic") or {k: v for k, v in r.items() if k not in ("id", "type", "severity", "scope", "tables", "enabled", "name")}
    return [Rule(r.get("id", ""), "aggregation", str(r.get("severity", "error")).lower(), r.get("scope", ""), tuple(r.get("tables") or ()), r.get("enabled", True), logic(r), r.get("name", "")) for r in named]


def config_rules(text: str) -> dict[str, str]:
    """attribute -> pattern from a rule file's JSON."""
    spec = json.loads(text)
    return {a: r["pattern"] if isinstance(r, dict) else r for a, r in (spec.get("format_rules") or spec).items() if (isinstance(r, str)) or (isinstance(r, dict) and r.get("pattern"))}
