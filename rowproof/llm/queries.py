"""The twelve operators as queries over the standard tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_grammar, decontam, exact_dedup, html_blocks, license_scan, mixing, pii_crf, quality_zstd, simhash_bk, target_resample, toxicity_fm, url_reputation
from .common import fold

# The contract's host rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (document, benchmark item) that the document leaks."""
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    leak = found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("l"))
    return leak.select("doc_id", "l.item_id", "l.score", "l.first_word", "l.last_word")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document its url numbers: bad if of low quality or toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("n")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)")
    outcomes = pages.select("url", number.alias("n")).where("n is not null").join(labels.where("bad is not null"), "n")
    return url_reputation.url_filter(pages, outcomes.select("url", "bad"), URL_RULES, keep=("page_id",))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and places of the base phrases, base labels, labels and score; a null text is empty."""
    return license_scan.license_digest(license_scan.license_scan(_table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, score and predicted at 0.3; the model sees only labelled rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_zstd.train_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality_zstd.score_quality(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the id that stays for its text, the group's size and the digest of the normalised text; null is empty."""
    out = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), digest=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text (empty if none) and the text's length in code points."""
    return html_blocks.extract_main_text(_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest id reachable over links; the empty text has fingerprint zero."""
    out = simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash_bk.hex_fingerprint(F.col("fp0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, score and predicted at 0.7; the model sees only labelled rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity_fm.train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity_fm.score_toxicity(docs, machine)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per use of a document in the mixture of sources, with its epoch, block and position."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans with those that the field adds; a null text is empty."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.find_personal_data(docs, pii_crf.train_field(docs))
    rank = F.create_map(*(x for i, k in enumerate(pii_crf.KINDS) for x in (F.lit(k), F.lit(i))))
    ordered = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    text = lambda a: F.array_join(F.transform(ordered(a), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))


def op11_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: features, weight towards the benchmark texts, noisy score and rank among those drawn."""
    drawn = target_resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, and one for a conversation -1 whose texts hold marks: digests of what is read back."""
    said = "</s>[INST] ok [/INST]"
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return chat_grammar.chat_digest(chat_grammar.format_chat(given.union(own))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontamination, op2_url_reputation, op3_license_scan, op4_quality, op5_exact_dedup, op6_html_extraction, op7_simhash, op8_toxicity, op9_mixing, op10_personal_data, op11_target_resample, op12_chat_format]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
