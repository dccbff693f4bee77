"""A corpus through five training-data stages, each written and read again.

Counted with ``siltstone.llm``: it needs that subpackage and goes with it.  Every stage takes
(spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of ``documents`` and no others, whatever else their input has.

Ids may be null, strings or repeated, texts null, empty or very long; an empty table stays one.
Null and empty texts are judged like any other, and count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, exact_substring, near_copies, packing, quality
from siltstone.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line classifier predicts to be good."""
    field = quality.fit_sample(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, field).where("quality_score >= 0.5").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word Jaccard of 0.8 or more): the
    one with the smallest id."""
    return near_copies.one_of_each(docs).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 200-byte strings that occur more than once out of all texts.

    Documents of which nothing is left go; a text that was empty or null before stays.
    """
    cut = exact_substring.without_repeats(docs)
    return cut.where("length(text) > 0 OR coalesce(n_chars, 0) = 0").select(
        "doc_id", "text", "lang", "source", F.coalesce(F.length("text").cast("long"), "n_chars").alias("n_chars")
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a whole shorter one."""
    hits = decontaminate.phrase_hits(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return hits.where("coalesce(size(found), 0) <= 0").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the token ids of every document in training sequences: one row a sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs


#: Fitted and hash-based stages have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None
