"""The jobs as registered queries: each runs twice into one new folder and returns its whole output.

The folder is below ``spark.checkpoint.dir`` and stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans.layout import scratch
from siltstone.queries import _BATCH, _WORDS, bm25_sql, lines_sql, strip_sql, tokens_sql

from . import find_passages, ingest_documents


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "job1")
    settings = ingest_documents.KNOWN | {"input": f"{sf_dir}/document[s].parquet", "output": f"{base}/out", "checkpoint": f"{base}/mark"}
    for _ in range(2):
        ingest_documents.run(spark, settings)
    return ingest_documents.current(spark, settings)


def job2_find_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = find_passages.KNOWN | {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/benchmark.parquet", "output": f"{scratch(spark, 'job2')}/out"}
    for _ in range(2):
        find_passages.run(spark, settings)
    return find_passages.result(spark, settings)


#: (doc_id, path, lang, ord, type, symbol, start_line, end_line, text) of the blocks of all documents.
_BLOCKS = f"""
bf AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, concat(source, '/', doc_id, '.txt') AS path, coalesce(text, '') AS content FROM documents),
bl AS (SELECT doc_id, path, lang, unnest({lines_sql("content")}) AS line, unnest(range(1, len({lines_sql("content")}) + 1)) AS n FROM bf),
bs AS (SELECT *, {strip_sql("line")} = '' AS blank, sum(CASE WHEN {strip_sql("line")} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM bl),
bg AS (SELECT doc_id, path, lang, sec, min(n) AS start_line, max(n) AS end_line, {strip_sql("string_agg(line, chr(10) ORDER BY n)")} AS body FROM bs WHERE NOT blank GROUP BY doc_id, path, lang, sec),
bb AS (SELECT *, substr({lines_sql("body")}[1], 1, 80) AS symbol FROM bg),
blocks AS (
  SELECT doc_id, path, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS ord, 'doc_block' AS type, symbol,
    CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, concat('Document: ', path, chr(10), 'Block: ', symbol, chr(10), chr(10), body) AS text,
    sha1(concat('docs:', path, ':doc_block:', symbol, ':', start_line, ':', end_line)) AS id
  FROM bb)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_ingest_documents": job1_ingest_documents, "job2_find_passages": job2_find_passages}
ORACLES: dict[str, str] = {
    "job1_ingest_documents": f"""
WITH {_BLOCKS}
SELECT doc_id, path, ord, id, type, 'text' AS language, symbol, start_line, end_line, text, CAST(len({tokens_sql("text")}) AS BIGINT) AS n_tokens, lang FROM blocks""",
    "job2_find_passages": bm25_sql(_BATCH, "blocks", "id", _BLOCKS) + f""",
m AS (
  SELECT lex.qid, lex.rank, lex.score, d.*, len(list_intersect({_WORDS.format("q.text")}, {_WORDS.format("d.text")})) AS overlap
  FROM lex JOIN q ON q.qid = lex.qid JOIN blocks d ON d.id = lex.id WHERE lex.rank <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank) AS new_rank FROM m)
SELECT qid, CAST(new_rank AS INT) AS rank, CAST(rank AS INT) AS bm25_rank, round(score, 6) AS score, CAST(overlap AS INT) AS overlap, id, doc_id, symbol, start_line, end_line,
  substr(text, 1, 400) AS preview, lang
FROM r WHERE new_rank <= 5""",
}
