"""Find the passages that answer each of a set of questions, and write them for review.

Documents are cut into passages, questions are searched in them by BM25, and the best
``candidates`` of each are put in order by the words that they share with the question.  Output:
(qid, rank, bm25_rank, score, overlap, id, doc_id, symbol, start_line, end_line, preview), partitioned by
the passage's language.  Every run reads all of both tables and replaces its output as a whole,
so running it again gives the same.

    python -m jobs.find_passages --config jobs/find_passages.json --documents DOCS --questions QUESTIONS --output OUT
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import Settings, command_line
from siltstone.functions import text as T
from siltstone.operators import chunk as C
from siltstone.operators import search as S
from siltstone.plans.deploy import ship
from siltstone.plans.layout import spread

log = logging.getLogger("jobs.find_passages")

#: ``k``: passages kept of a question, ``candidates`` passages put in order by shared words.
KNOWN: Settings = {"documents": "", "questions": "", "output": "", "collection": "docs", "k": 5, "candidates": 20, "preview": 400, "path": "concat(source, '/', doc_id, '.txt')"}


def passages(docs: DataFrame, settings: Settings) -> DataFrame:
    """(id, doc_id, lang, symbol, start_line, end_line, text): the blocks of ``docs``, each cut inside its row."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.expr(settings["path"]).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.select("doc_id", "lang", "path", T.each(C.text_blocks(F.col("path"), F.col("text"))).alias("c")).where("c IS NOT NULL")
    key = C.chunk_id(F.lit(settings["collection"]), F.col("path"), F.col("c.type"), F.col("c.symbol"), F.col("c.start_line"), F.col("c.end_line"))
    return cut.select(key.alias("id"), "doc_id", "lang", "c.symbol", "c.start_line", "c.end_line", "c.text")


def run(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """Returns the questions and documents read and the rows written."""
    settings = KNOWN | settings
    ship(spark)
    written = Observation()
    docs = spread(spark.read.parquet(settings["documents"])).select("doc_id", "text", "lang", "source")
    asked = spark.read.parquet(settings["questions"]).select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = passages(docs, settings)
    found = S.bm25_topk(pieces.select("id", "text"), asked, settings["candidates"])
    # A join by id in place of a second search: only texts of found passages go further, and none is shuffled for it.
    n_hits = settings["candidates"] * S.bounded(asked, S.BROADCAST_HITS)
    hits = S.maybe_broadcast(found, n_hits, S.BROADCAST_HITS).join(pieces.withColumnRenamed("text", "doc"), "id")
    ranked = S.rerank_lexical(asked, hits).where(F.col("new_rank") <= settings["k"])
    out = ranked.select(
        "qid", F.col("new_rank").alias("rank"), F.col("rank").alias("bm25_rank"), F.round("score", 6).alias("score"), "overlap", "id", "doc_id",
        "symbol", "start_line", "end_line", F.substring("doc", 1, settings["preview"]).alias("preview"), "lang",
    )
    out = out.observe(written, F.count("*").alias("n")).hint("rebalance", "lang").sortWithinPartitions("lang", "qid", "rank")
    out.write.mode("overwrite").partitionBy("lang").parquet(settings["output"])
    n = {"documents": docs.count(), "questions": asked.count(), "written": written.get["n"]}
    log.info("read %d documents of %s and %d questions of %s", n["documents"], settings["documents"], n["questions"], settings["questions"])
    log.info("wrote %d passages to %s", n["written"], settings["output"])
    return n


def result(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.read.parquet(settings["output"])


if __name__ == "__main__":
    sys.exit(command_line(__doc__, KNOWN, run))
