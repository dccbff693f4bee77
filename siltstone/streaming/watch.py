"""Changes of a source tree as micro-batches, and the same on a log of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tree

DEBOUNCE = "4 seconds"


def changes(spark: SparkSession, root: str, options: dict[str, str] | None = None) -> DataFrame:
    """Streaming (kind, path, mtime_ns, size): created, modified and deleted files."""
    tree.register(spark)
    return spark.readStream.format("source_tree_changes").options(**(options or {})).load(root)


def watch(spark: SparkSession, root: str, apply: Callable[[list[str], DataFrame], None], checkpoint: str, *, trigger: dict | None = None, options: dict[str, str] | None = None) -> StreamingQuery:
    """Call ``apply(paths, batch)`` for each batch of changed paths, each path once.

    Events of one debounce interval are one batch.  ``apply`` must be idempotent: after a
    failure the last batch is given again.  The paths of one batch are what changed in one
    interval and are handed on as a list, as an incremental ingest takes them.
    """

    def batch(df: DataFrame, number: int) -> None:
        once = df.groupBy("path").agg(F.max_by("kind", F.coalesce("mtime_ns", F.lit(2**62))).alias("kind"))
        paths = sorted(r["path"] for r in once.select("path").collect())
        if paths:
            apply(paths, once)

    trigger = trigger or {"processingTime": DEBOUNCE}
    return changes(spark, root, options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def debounce(events: DataFrame, gap: str = DEBOUNCE, *keys: str) -> DataFrame:
    """(start, end, paths, n) of each burst: events no further apart than ``gap``.

    Works on batches and, with a watermark on ``ts``, on streams.  Without ``keys`` a burst
    is over all paths, as one debounce timer is.
    """
    window = F.session_window("ts", gap)
    out = events.groupBy(window, *keys).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "paths", "n")
