"""Keeping a collection equal to a source tree: snapshot, manifest, difference, modes."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators.code import code_errors
from ..operators.embed import HashingEmbedder, with_embedding
from ..sources import tree
from .files import Files
from .store import BUCKETS, ChunkStore

log = logging.getLogger(__name__)
_ERRORS = "path string, stage string, exc_type string, message string"
#: Ranges of path hashes that a level of digests has.
RANGES = 1024
MANIFEST = "path string, mtime_ns long, size long"
#: Files that a full ingest stores before it saves the manifest and may be stopped.
FLUSH_FILES = 20_000
Progress = Callable[[str, dict], None]


# -- plans ----------------------------------------------------------------------


def _range(n: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(n))


def _unequal(current: DataFrame, previous: DataFrame, ranges: int) -> DataFrame:
    """(r): ranges of path hashes whose rows differ, by digests of all rows of a range."""

    def digests(rows: DataFrame) -> DataFrame:
        row = F.xxhash64("path", "mtime_ns", F.col("mtime_ns").isNull(), "size", F.col("size").isNull())
        made = rows.select(_range(ranges).alias("r"), row.alias("h"))
        return made.groupBy("r").agg(F.struct(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 32))).alias("s")).alias("d"))

    both = digests(current).join(digests(previous).withColumnRenamed("d", "e"), "r", "full_outer")
    return both.where(~F.col("d").eqNullSafe(F.col("e"))).select("r")


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change) with change ``new``, ``changed``, ``deleted`` or ``same``.

    A tree of digests over ranges of path hashes says where the snapshot and the manifest differ:
    first over ``RANGES``, then over as many within each of those that differ.  Only rows of ranges
    that differ are joined on the path; of a tree that is as it was nothing but digests is shuffled.
    """
    top = [r["r"] for r in _unequal(current, previous, RANGES).collect()]  # RANGES numbers at most
    if not top:
        return current.select("path", F.lit("same").alias("change"))
    within = lambda rows: rows.where(_range(RANGES).isin(top)) if len(top) < RANGES else rows
    leaves = F.broadcast(_unequal(within(current), within(previous), RANGES * RANGES))  # RANGES squared numbers at most
    leaf = lambda rows, how: rows.withColumn("r", _range(RANGES * RANGES)).join(leaves, "r", how)
    a = leaf(within(current), "left_semi").select("path", F.struct("mtime_ns", "size").alias("now"))
    b = leaf(within(previous), "left_semi").select("path", F.struct("mtime_ns", "size").alias("then"))
    change = (
        F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted")
        .when(F.col("now").eqNullSafe(F.col("then")), "same").otherwise("changed")
    )
    joined = a.join(b, "path", "full_outer").select("path", change.alias("change"))
    return joined.unionByName(leaf(current, "left_anti").select("path", F.lit("same").alias("change")))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: n_new, n_changed, n_deleted, n_previous and changed_ratio."""
    is_ = lambda *names: F.count_if(F.col("change").isin(*names))
    out = changes.agg(
        is_("new").alias("n_new"), is_("changed").alias("n_changed"), is_("deleted").alias("n_deleted"),
        is_("changed", "deleted", "same").alias("n_previous"),
    )
    ratio = (F.col("n_new") + F.col("n_changed") + F.col("n_deleted")) / F.greatest(F.lit(1), F.col("n_previous"))
    return out.withColumn("changed_ratio", ratio)


def scan_summary(files: DataFrame) -> DataFrame:
    """(ext, files, bytes): counts by suffix, most first."""
    ext = T.suffix(F.col("path"))
    return files.groupBy(F.when(ext == "", "(no ext)").otherwise(ext).alias("ext")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    ).orderBy(F.desc("files"), "ext")


def scan_totals(files: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(F.count("*").alias("files_found"), size.alias("total_bytes"), F.round(size / 1048576.0, 2).alias("total_mb"))


def rebuild_manifest(stored: DataFrame, snapshot: DataFrame, old: DataFrame) -> DataFrame:
    """Files on disk that have stored chunks, over what the old manifest says of others."""
    found = snapshot.join(stored.select("path").distinct(), "path", "left_semi")
    return old.join(found.select("path"), "path", "left_anti").unionByName(found)


def prepare(files: DataFrame, collection: str, root: str = "", project: str = "") -> DataFrame:
    """``files`` (path, content) -> rows of the store, without embeddings."""
    made = C.chunk_files(files).drop("ord")
    parts = [F.col(c) for c in ("path", "type", "symbol", "start_line", "end_line")]
    return made.withColumns({
        "id": C.chunk_id(F.lit(collection), *parts), "repo_root": F.lit(root), "project": F.lit(project),
    }).dropDuplicates(["id"])


def plan_of(files: DataFrame, cap: int, *keys: str) -> DataFrame:
    """Dry run over ``files`` (path, size, content): by ``keys`` the files scanned, planned and
    skipped, and the chunks that an ingest would store; nothing is embedded."""
    # Not as a plain comparison: the tree source would take it for both uses of ``files``.
    made = C.chunk_files(files.where(-F.col("size") >= -cap).select("path", "content")).groupBy("path").agg(F.count("*").alias("made"))
    return files.select("path", *keys).join(made, "path", "left").groupBy(*keys).agg(
        F.count("*").alias("files_scanned"), F.count("made").alias("files_planned"), F.count_if(F.col("made").isNull()).alias("files_skipped"),
        F.coalesce(F.sum("made"), F.lit(0)).alias("chunks"),
    )


# -- the driver's side ----------------------------------------------------------


@dataclass
class Report:
    mode: str
    reason: str
    counts: dict = field(default_factory=dict)
    files: int = 0
    chunks: int = 0
    seen: int = 0
    skipped: int = 0
    errors: int = 0
    seconds: float = 0.0


class Stopped(Exception):
    """A cooperative stop between steps."""


class Sync:
    """Sync of one project's collections with its tree."""

    def __init__(
        self, spark: SparkSession, store: ChunkStore, root: str, embedder=HashingEmbedder, *, max_file_bytes: int = tree.MAX_FILE_BYTES,
        extensions: list[str] | None = None, includes: list[str] | None = None, exclude_roots: list[str] | None = None,
        flush_files: int = FLUSH_FILES, progress: Progress | None = None, should_stop: Callable[[], bool] = lambda: False,
    ) -> None:
        self.spark, self.store, self.root, self.embedder = spark, store, root, embedder
        self.cap, self.files, self.should_stop = max_file_bytes, Files(spark), should_stop
        self.extensions, self.includes, self.flush = extensions, includes, flush_files
        self.exclude = list(exclude_roots or ()) + [x for x in [_local(store.root.rpartition("/")[0])] if x]
        self.progress = progress or (lambda stage, payload: None)

    def _side(self, collection: str, name: str) -> str:
        return f"{self.store.root}/_{name}/{collection}"

    def manifest(self, collection: str) -> DataFrame:
        found = self.files.read_json(self._side(collection, "manifest") + "/_current.json")
        if not isinstance(found, dict):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self._side(collection, 'manifest')}/{found['folder']}")

    def save_manifest(self, collection: str, rows: DataFrame) -> None:
        folder = self._side(collection, "manifest")
        found = self.files.read_json(f"{folder}/_current.json")
        g, old = (int(found["generation"]), found.get("folder")) if isinstance(found, dict) else (0, None)
        name = f"g={g + 1}-{uuid.uuid4().hex[:8]}"
        rows.select("path", "mtime_ns", "size").write.parquet(f"{folder}/{name}")
        self.files.write_json(f"{folder}/_current.json", {"generation": g + 1, "folder": name, "before": old})
        if isinstance(found, dict) and found.get("before"):
            self.files.delete(f"{folder}/{found['before']}")

    def pause(self, collection: str, **state) -> None:
        self.files.write_json(self._side(collection, "pause") + ".json", {"collection": collection, "paused": True, "paused_at": time.time()} | state)

    def paused(self, collection: str) -> dict | None:
        found = self.files.read_json(self._side(collection, "pause") + ".json")
        return found if isinstance(found, dict) and found.get("paused") else None

    def clear_pause(self, collection: str) -> None:
        self.files.delete(self._side(collection, "pause") + ".json")

    def snapshot(self, includes: list[str] | None = None, limit: int | None = None, extensions: list[str] | None = None) -> DataFrame:
        return tree.list_files(self.spark, self.root, includes, limit=limit, extensions=extensions or self.extensions, exclude_roots=self.exclude)

    def tree_options(self) -> dict[str, str]:
        """What a change stream of the same files is opened with."""
        return {"exclude_roots": json.dumps(self.exclude)} | ({"extensions": json.dumps(self.extensions)} if self.extensions else {})

    def _items(self, collection: str, files: DataFrame) -> DataFrame:
        """Rows of the store for ``files`` (path); those that cannot be parsed are noted beside."""
        contents = tree.read_contents(files, self.root, self.cap)
        name = self.root.rstrip("/").rpartition("/")[2]
        return with_embedding(prepare(contents, collection, self.root, name), self.embedder)

    def errors(self, collection: str) -> DataFrame:
        """(path, stage, exc_type, message) of files that the last sync kept whole: the quarantine."""
        place = self._side(collection, "errors")
        if not self.files.exists(place):
            return self.spark.createDataFrame([], _ERRORS)
        return self.spark.read.schema(_ERRORS).parquet(place)

    def _note_errors(self, collection: str, files: DataFrame, touched: DataFrame | None = None) -> int:
        """Replace what is known of the ``touched`` paths (None: of all) by what fails in ``files``; a
        file that failed before stays listed until it is read again or gone."""
        python = files.where("lower(path) LIKE '%.py'")
        found = code_errors(tree.read_contents(python, self.root, self.cap))
        if touched is not None:
            found = found.unionByName(self.errors(collection).join(touched.select("path"), "path", "left_anti"))
        beside = self._side(collection, "errors-next")
        found.write.mode("overwrite").parquet(beside)  # it reads the table that it replaces
        self.spark.read.schema(_ERRORS).parquet(beside).write.mode("overwrite").parquet(self._side(collection, "errors"))
        self.files.delete(beside)
        found = self.errors(collection)
        for r in found.limit(20).collect():
            log.warning("[WARN] symbol=%s stage=%s message=%s exc=%s", r["path"], r["stage"], r["message"], r["exc_type"])
        return found.count()

    def plan(self, collection: str = "code", includes: list[str] | None = None, limit: int | None = None) -> dict:
        """Dry run: what an ingest would read, skip and make, without embedding."""
        listed = tree.list_files(self.spark, self.root, includes, limit=limit, content=True, extensions=self.extensions, exclude_roots=self.exclude)
        return plan_of(listed, self.cap).first().asDict()

    def ingest_paths(self, collection: str, paths: list[str], replace: bool = True) -> int:
        """Chunk these files anew; those that are gone lose chunks and manifest rows."""
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        # The paths go through the tree's own rules, as the files of a full ingest do.
        now = self.snapshot(paths).join(asked, "path", "left_semi")
        self.store.upsert(collection, self._items(collection, now), replace, asked)
        kept = self.manifest(collection).join(asked, "path", "left_anti")
        self.save_manifest(collection, kept.unionByName(now))
        self._note_errors(collection, now, asked)
        return self.store.read(collection).join(asked, "path", "left_semi").count()

    def run(self, collection: str = "code", *, includes: list[str] | None = None, limit: int | None = None, force_full: bool = False) -> Report:
        """Full, incremental, resumed or no sync, whichever the state asks for.

        With a limit nothing counts as deleted: files beyond it may still be there.
        """
        began = time.time()
        includes = includes if includes is not None else tree.load_resources(self.root) or self.includes or None
        self.progress("resource_manifest", {"includes": includes or []})
        # Stored once, so that every step of this run sees the same state of the tree.
        place = self._side(collection, "snapshot")
        self.snapshot(includes, limit).write.mode("overwrite").parquet(place)
        now = self.spark.read.schema(MANIFEST).parquet(place)
        before = self.manifest(collection)
        changes = diff(now, before)
        if limit is not None:
            changes = changes.where("change <> 'deleted'")
        counts = change_counts(changes).first().asDict()
        self.progress("scan_complete", counts)
        stored = self.store.generation(collection) > 0 and not self.store.read(collection).isEmpty()
        reason = "force_full" if force_full else "missing_manifest" if counts["n_previous"] == 0 and before.isEmpty() else "empty_collection" if not stored else ""
        if reason:
            report = self._guarded(collection, lambda r: self._full(collection, now, r), Report("full", reason))
        elif not counts["n_new"] + counts["n_changed"] + counts["n_deleted"]:
            self.clear_pause(collection)
            report = Report("noop", "up_to_date")
        else:
            kind = Report("incremental", "resume" if self.paused(collection) else "incremental")
            report = self._guarded(collection, lambda r: self._incremental(collection, changes, now, before if limit is not None else None, r), kind)
        report.counts, report.seconds = counts, time.time() - began
        return report

    def _guarded(self, collection: str, work: Callable[[Report], None], report: Report) -> Report:
        """``work``, or a pause marker if it is stopped before, between parts or in the middle of one."""
        try:
            self._check()
            work(report)
        except Exception as e:
            if not self.should_stop():
                raise
            self.pause(collection, files_done=report.files, files_total=report.seen, chunks_written=report.chunks, during=type(e).__name__)
            report.mode = "stopped"
        else:
            self.clear_pause(collection)
        return report

    def _check(self) -> None:
        if self.should_stop():
            raise Stopped

    def _full(self, collection: str, now: DataFrame, report: Report) -> None:
        """Store the tree in parts of ``flush_files`` files, about, and save the manifest after each:
        what is stored is not done again if the run stops or breaks off.  The first part replaces
        what the collection was."""
        report.seen = now.count()
        parts = 1
        while parts < BUCKETS and parts * self.flush < report.seen:
            parts *= 2  # a part's files fill buckets of their own
        self.progress("reset_collection", {"collection": collection})
        done = None
        for k in range(parts):
            self._check()
            files = now.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k)
            items = self._items(collection, files)
            if k == 0:
                self.store.write(collection, items)
            else:
                self.store.upsert(collection, items, True, files)
            done = files if done is None else done.unionByName(files)
            self.save_manifest(collection, done)
            self._count(collection, done, report)
            self.progress("upsert_batch", {"written": report.files, "total": report.seen, "chunks": report.chunks})
        report.errors = self._note_errors(collection, now)

    def _count(self, collection: str, files: DataFrame, report: Report) -> None:
        made = self.store.read(collection).join(files.select("path"), "path", "left_semi").agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files")).first()
        report.files, report.chunks = made["files"], made["chunks"]
        report.skipped = report.seen - report.files

    def _incremental(self, collection: str, changes: DataFrame, now: DataFrame, keep: DataFrame | None, report: Report) -> None:
        touched = changes.where("change <> 'same'").select("path")
        fresh = changes.where("change IN ('new', 'changed')").select("path")
        report.seen = fresh.count()
        self.store.upsert(collection, self._items(collection, fresh), True, touched)
        rest = now if keep is None else keep.join(now.select("path"), "path", "left_anti").unionByName(now)
        self.save_manifest(collection, rest)
        self._count(collection, fresh, report)
        report.errors = self._note_errors(collection, fresh, touched)
        self.progress("upsert_batch", {"written": report.files, "total": report.seen, "chunks": report.chunks})


def _local(path: str) -> str | None:
    """A folder on this machine that an index lies in, so that it is not itself indexed."""
    url = urlparse(path)
    return os.path.realpath(url.path) if url.scheme in ("", "file") and url.path else None
