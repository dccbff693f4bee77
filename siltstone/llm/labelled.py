"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: crc32 of the id as text, mod 3, is 1."""
    return crc_mod(doc_id, 3) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(id, text, label) of at most ``limit`` labelled ids outside the held-out third.

    The ids with the smallest hashes are taken, so the same table gives the same sample.
    Null labels and ids are left out; of several labels for one id the largest counts.  Ids are
    compared as text, so the two tables may hold them in different types.
    The labels side is ``limit`` rows at most, hence the broadcast.
    """
    picked = (
        labels.select(F.col("doc_id").cast("string").alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(limit)
    )
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), F.col("id").cast("string") == F.col("key")).select("id", "text", "label")
