"""Incremental intake of documents for extraction: what is new is filtered, measured, cut and written.

    python -m jobs.document_intake --documents DIR --chunks DIR --checkpoint DIR [--config FILE]

documents is read as a file stream: each run takes the files that no run before has taken, in batches of at
most files_per_batch files, and ends.  A document's chunks carry its id, name, language, words, whether it is
so long that spans should be located in it first, and their own key (the digest of their text), under which
an extractor's answers are cached.  Chunks are partitioned by language, so that an extraction run reads only
the prompts' language that it has.

The checkpoint and the sink's own log make each file count once: a run that died is taken up where it stood,
and a run without new files writes nothing.  The names of all files seen are kept in the checkpoint
(maxFileAge is long), so a file that arrives late with an old time is taken as well.

A null text is one empty chunk; a null name passes the filters only if there are none to include.  A file
that is rewritten under its old name isn't read again: corrections come as new files.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import main
from rowproof.functions import values as V
from rowproof.operators import documents as D

LOG = logging.getLogger(__name__)


def prepare(docs: DataFrame, settings: dict) -> DataFrame:
    """The job's plan on a batch or a stream of documents."""
    name, text = settings["name"], F.coalesce(F.col(settings["text"]), F.lit(""))
    named = docs.withColumn("_name", F.coalesce(F.col(name), F.lit("")))
    kept = D.filter_documents(named, "_name", settings["include"], settings["exclude"])
    words = V.word_estimate(text)
    measured = kept.select(settings["id"], F.col(name).alias("name"), text.alias("text"), V.language(text).alias("language"), words.alias("words"))
    located = measured.withColumn("locate", F.col("words") > settings["locate_words"])
    cut = D.chunks(located, settings["id"], "text", settings["chunk_chars"], settings["overlap_chars"], keep=("name", "language", "words", "locate"))
    return cut.withColumn("chunk_key", F.sha2("chunk", 256))


def intake(spark: SparkSession, documents: str, chunks: str, checkpoint: str, settings: dict) -> int:
    """Takes the new files of documents; the number of documents read."""
    source = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", settings["files_per_batch"]).option("maxFileAge", "36500d")
    place = documents.rstrip("/")  # as a pattern, a stream takes one file as well as a folder
    prepared = prepare(source.parquet(f"{place[:-1]}[{place[-1]}]"), settings)
    sink = prepared.writeStream.format("parquet").outputMode("append").partitionBy("language").option("path", chunks).option("checkpointLocation", checkpoint)
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()  # raises what ended the stream
    read = 0
    for p in query.recentProgress:
        if p.numInputRows:
            read += p.numInputRows
            LOG.info("batch %s: %s documents read from %s", p.batchId, p.numInputRows, documents)
    LOG.info("%s documents read; %s now holds %s chunks", read, chunks, _held(spark, chunks))
    return read


def _held(spark: SparkSession, chunks: str) -> int:
    return spark.read.schema("idx INT").parquet(chunks).count()


if __name__ == "__main__":
    main("document_intake", {"documents": "folder of Parquet files that grows", "chunks": "folder of the output", "checkpoint": "folder of the stream's progress"}, intake)
