"""Keep a table of chunks in step with a growing folder of document files.

Each run takes the files that came since the last one, up to then, and ends.  Spark's file stream
and its checkpoint remember which files were taken.  A document that comes again with another
text gives way to its newest version; one that comes again unchanged is passed over.

Below ``output`` are two tables, partitioned by the batch that wrote them, chunks by language too:

* ``documents``: (doc_id, path, lang, digest, n_chunks, batch), a row for each version taken;
* ``chunks``: (doc_id, path, ord, id, type, language, symbol, start_line, end_line, text, n_tokens,
  batch, lang).

A batch overwrites its own partitions and no others, and its documents are written last and
compared with earlier batches only, so one that failed half way is done again with the same result.
:func:`current` reads the newest version of every document.

Rows without an id are passed over; a null text is an empty one, which has no chunks; of several
rows of an id in one batch the one of the newest file counts.

    python -m jobs.ingest_documents --config jobs/ingest_documents.json --input IN --output OUT --checkpoint MARK
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import Settings, command_line
from siltstone.functions import text as T
from siltstone.operators import chunk as C
from siltstone.plans import store as K
from siltstone.plans.deploy import ship

log = logging.getLogger("jobs.ingest_documents")

#: ``input``: a folder, or a pattern of files or folders; Spark's file stream takes a single file by
#: a pattern only.  ``path``: an expression over the input's columns; its ending says how a text is cut.
#: ``files``: files that one batch takes at most.
KNOWN: Settings = {
    "input": "", "output": "", "checkpoint": "", "collection": "docs", "files": 1000,
    "schema": "doc_id long, text string, lang string, source string", "path": "concat(source, '/', doc_id, '.txt')",
}
_DOCUMENTS = "path string, digest string, n_chunks long, batch long, lang string"
_CHUNKS = "path string, ord int, id string, type string, language string, symbol string, start_line int, end_line int, text string, n_tokens long, batch long, lang string"


def _schema(spark: SparkSession, settings: Settings, name: str) -> str:
    kind = spark.createDataFrame([], (KNOWN | settings)["schema"]).schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, {_DOCUMENTS if name == 'documents' else _CHUNKS}"


def _stored(spark: SparkSession, settings: Settings, name: str) -> DataFrame:
    return spark.read.schema(_schema(spark, settings, name)).parquet(f"{settings['output']}/{name}")


def _newest(documents: DataFrame) -> DataFrame:
    """(doc_id, batch, digest) of each document's newest version."""
    return documents.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("digest", "batch").alias("digest"))


def current(spark: SparkSession, settings: Settings) -> DataFrame:
    """The chunks of the newest version of every document."""
    newest = _newest(_stored(spark, settings, "documents")).select("doc_id", "batch")
    return _stored(spark, settings, "chunks").join(newest, ["doc_id", "batch"], "left_semi").drop("batch")


def _take(arrived: DataFrame, number: int, settings: Settings) -> dict[str, int]:
    """Chunk what is new or changed in one batch and write its partitions."""
    spark = arrived.sparkSession
    rows = arrived.where("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("id"), F.expr(settings["path"]).alias("path"), F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"), F.col("_metadata.file_modification_time").alias("came"),
    )
    last = K.last_by_id(rows, "came").select(F.col("id").alias("doc_id"), "path", "lang", "content", F.sha1("content").alias("digest"))
    known = _newest(_stored(spark, settings, "documents").where(F.col("batch") < number)).select("doc_id", "digest")
    fresh = last.join(known, ["doc_id", "digest"], "left_anti").where("path IS NOT NULL").persist()  # read and compared once
    to = fresh.select("doc_id", "path", "lang", "digest")
    made = C.chunk_files(fresh.select("path", "content")).join(to.drop("digest"), "path")
    key = C.chunk_id(F.lit(settings["collection"]), F.col("path"), F.col("type"), F.col("symbol"), F.col("start_line"), F.col("end_line"))
    seen = {"documents": Observation(), "chunks": Observation()}
    chunks = made.select(
        "doc_id", "path", "ord", key.alias("id"), "type", "language", "symbol", "start_line", "end_line", "text",
        F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.lit(number).cast("long").alias("batch"), "lang",
    ).observe(seen["chunks"], F.count("*").alias("n"))
    put = lambda df, name, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{settings['output']}/{name}")
    put(chunks, "chunks", ["batch", "lang"])
    counts = _stored(spark, settings, "chunks").where(F.col("batch") == number).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    done = to.join(counts, "doc_id", "left").select("doc_id", "path", "lang", "digest", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(number).cast("long").alias("batch"))
    put(done.observe(seen["documents"], F.count("*").alias("n")), "documents", ["batch"])
    fresh.unpersist()
    found = {name: x.get["n"] for name, x in seen.items()}
    log.info("batch %d: %d new or changed documents, %d chunks written to %s", number, found["documents"], found["chunks"], settings["output"])
    return found


def run(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """Take all files that are there and not yet taken; returns rows read, documents and chunks written."""
    settings = KNOWN | settings
    ship(spark)
    for name, by in (("documents", ["batch"]), ("chunks", ["batch", "lang"])):  # so that the first batch finds tables to read
        spark.createDataFrame([], _schema(spark, settings, name)).write.mode("append").partitionBy(*by).parquet(f"{settings['output']}/{name}")
    total = {"read": 0, "documents": 0, "chunks": 0}

    def batch(arrived: DataFrame, number: int) -> None:
        for name, n in _take(arrived, number, settings).items():
            total[name] += n

    files = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", settings["files"]).parquet(settings["input"])
    stream = files.select("*", "_metadata").writeStream.foreachBatch(batch).option("checkpointLocation", settings["checkpoint"]).trigger(availableNow=True).start()
    stream.awaitTermination()
    total["read"] = sum(p["numInputRows"] for p in stream.recentProgress)
    log.info("%s: read %d new rows; wrote %d documents and %d chunks", settings["input"], total["read"], total["documents"], total["chunks"])
    return total


if __name__ == "__main__":
    sys.exit(command_line(__doc__, KNOWN, run))
