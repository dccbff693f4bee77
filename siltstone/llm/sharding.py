"""Shards by weighted rendezvous hashing: a record's key and the list of shards decide.

Every shard draws a number for every key, and the record goes to the shard of the largest: with
a uniform draw u in (0, 1) from a digest of key and shard, and the shard's weight w, the number
is -w / ln u, so that a shard wins in proportion to its weight.  A new shard takes only the
records that it wins; one that goes gives up only its own; one whose weight changes trades with
the others and nothing else moves.

Finding the shard is an expression in the row.  Slots, which number the rows of a shard without
gaps, take one shuffle of narrow rows by ranges of (shard, digest of the key): a row's slot is
its place within its range plus what the ranges before it hold of the shard, a table of a row a
range.  Rows that agree in all of it are dealt over several ranges by where they stood.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, parts_for
from .crc_sql import CRC_TABLE, crc32_sql

#: Weights of the shards 0, 1, ...: eight alike.
WEIGHTS = (1.0,) * 8
#: Bits of a draw: what a double holds in full, in whole hexadecimal digits.
DIGITS = 13
#: Bytes of a narrow row, about.
_ROW = 64


def key_text(key: Column) -> Column:
    """A key as text; a null one is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def _number(text: Column) -> Column:
    """The first ``DIGITS`` hexadecimal digits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def strength(key: Column, shard: Column, weight: Column) -> Column:
    """What the shard draws for the key."""
    return -weight / F.ln((_number(F.concat(key, F.lit("/"), shard.cast("string"))) + 0.5) / float(16**DIGITS))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """(strength, less) of the shard that the key goes to, ``less`` its negated number: of equal
    draws the smallest shard wins.  Shards of no weight get nothing."""
    rivals = [(s, float(w)) for s, w in enumerate(weights) if w > 0]
    if not rivals or min(weights) < 0:
        raise ValueError("weights are not below zero, and one is above it")
    listed = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(w).alias("weight")) for s, w in rivals])
    return F.array_max(F.transform(listed, lambda x: F.struct(strength(key, x.shard, x.weight).alias("strength"), (-x.shard).alias("less"))))


def shard(key: Column, weights: Sequence[float] = WEIGHTS) -> Column:
    """The number of the shard that each key goes to."""
    return -winner(key_text(key), weights)["less"]


def assign(docs: DataFrame, weights: Sequence[float] = WEIGHTS, key_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the column ``name``, without a shuffle.

    Keys may be of any kind that casts to text, null (all null keys go to one shard) or repeated
    (rows of a key stay together); a column that is called ``name`` already, in any case, gives way
    to the new one, all others stay.  Texts are not looked at.  An empty table gives no rows.
    """
    return docs.withColumn(name, shard(F.col(f"`{key_col}`"), weights))


def write(docs: DataFrame, folder: str, weights: Sequence[float] = WEIGHTS, key_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet below ``folder``, one directory ``shard=N`` a shard, each in as many
    files as its size asks for: Spark splits large shards over tasks and joins small ones."""
    assign(docs, weights, key_col).hint("rebalance", "shard").write.partitionBy("shard").parquet(folder)


def place(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", grown: float | None = 1.0) -> DataFrame:
    """(id column, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``size``: bytes of the text (none for null) and 1; ``slot`` counts the rows of a shard from 0 in
    the order of a digest of the key, then of key, checksum and size; ``grown_shard``: where the row
    goes if one more shard of weight ``grown`` joins, which is its own shard or the new one (null
    if ``grown`` is None).

    Rows equal in id and text get slots of their own; one key may hold any share of all rows. Ids
    may be null or strings, texts of any length; other columns are not used, so their names may
    clash.  An empty table gives none.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
    ).withColumn("key", key_text(F.col("id")))
    rows = rows.withColumn("best", winner(F.col("key"), weights))
    new = strength(F.col("key"), F.lit(len(weights)), F.lit(grown)) if grown else F.lit(float("-inf"))
    larger = F.when(new > F.col("best.strength"), len(weights)).otherwise(-F.col("best.less")) if grown is not None else F.lit(None).cast("int")
    narrow = rows.select("id", "key", "size", "crc", (-F.col("best.less")).alias("shard"), larger.alias("grown"), _number(F.col("key")).alias("digest"))
    stored = materialize(narrow, "shard-rows")
    order = ["shard", "digest", "key", "crc", "size", "stood"]
    parts = parts_for(docs.sparkSession, _ROW * stored.count())
    ranges = stored.withColumn("stood", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = materialize(ranges.select("id", "size", "crc", "shard", "grown", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "shard-laid")
    discard(stored)
    pieces = laid.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))  # a row for each range, and for each shard that a range begins
    return laid.join(F.broadcast(starts), ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).alias("slot"), F.col("grown").alias("grown_shard"),
    )


_KEY = "coalesce(CAST(doc_id AS VARCHAR), '')"
_DRAW = f"(CAST('0x' || substr(md5({{0}}), 1, {DIGITS}) AS BIGINT))"
ORACLE = f"""
WITH crc AS MATERIALIZED {CRC_TABLE},
d AS (SELECT doc_id, {_KEY} AS key, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
s AS (SELECT n, s, -1.0 / ln(({_DRAW.format("key || '/' || s")} + 0.5) / {float(16**DIGITS)!r}) AS strength FROM d, range(9) r(s)),
w AS (
  SELECT n, arg_max(s, strength) FILTER (s < 8) AS shard, arg_max(s, strength) AS grown FROM s GROUP BY n),
f AS (
  SELECT doc_id, key, CAST(strlen(text) + 1 AS BIGINT) AS size, {crc32_sql("text")} AS crc, shard, grown FROM d JOIN w USING (n), crc)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY {_DRAW.format("key")}, key, crc, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM f"""
