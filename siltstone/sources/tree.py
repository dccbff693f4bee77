"""A source tree as a Spark data source: path, mtime_ns, size and, if asked for, content.

Spark's own file listing hides names that begin with a dot or an underscore and has
microsecond times; this source lists every allowed file and prunes directories while it
walks.  Partitions are the top-level entries, or the include patterns, dealt over
``partitions`` tasks; contents are read in those tasks, never on the driver.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader

from ..plans.deploy import ship
from .ignore import IgnoreRules

#: Suffixes and names of files to list, directories never to enter, size cap.
EXTENSIONS = (".py", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".ini", ".js", ".ts", ".tsx", ".css", ".html")
SPECIAL_NAMES = (".env", ".env.example", ".env.sample", ".env.template")
SKIP_DIRS = frozenset({
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".ruff_cache", ".dmypy", ".pytest_cache", ".hypothesis",
    "node_modules", ".next", ".nuxt", ".turbo", "venv", ".venv", "env", "ENV", ".env.d", "dist", "build", "out", "target",
    ".idea", ".vscode", "chroma_db",
})
MAX_FILE_BYTES = 800_000
#: Fixed value: the file in a tree that lists what to index.
RESOURCES = "rag_index_resources.txt"
_META = "path string, mtime_ns long, size long"


def allowed(name: str, extensions: frozenset[str]) -> bool:
    return PurePosixPath(name).suffix.lower() in extensions or name.lower() in SPECIAL_NAMES


def skipped_dir(name: str) -> bool:
    return name in SKIP_DIRS or name.endswith(".egg-info")


def parse_includes(raw: str | None) -> list[str]:
    """Comma-separated patterns without surrounding spaces and slashes; empty ones go."""
    return [p for x in (raw or "").split(",") if (p := x.strip().strip("/"))]


def load_resources(root: str) -> list[str]:
    """Patterns of the tree's resource file: lines that are neither blank nor comments."""
    try:
        with open(os.path.join(root, RESOURCES), encoding="utf-8", errors="ignore") as f:
            return [x for line in f if (x := line.strip()) and not x.startswith("#")]
    except OSError:
        return []


class Walker:
    """Listing rules of one tree; small enough to be sent with every task."""

    def __init__(self, root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = ()) -> None:
        self.root = os.path.abspath(root)
        self.extensions = frozenset(extensions)
        self.excluded = frozenset(os.path.realpath(x) for x in excluded)
        try:
            with open(os.path.join(self.root, ".gitignore"), encoding="utf-8", errors="ignore") as f:
                self.rules = IgnoreRules(f.read())
        except OSError:
            self.rules = IgnoreRules("")

    def relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _wanted(self, path: str) -> bool:
        return allowed(os.path.basename(path), self.extensions) and not self.rules.ignored(self.relative(path))

    def _enter(self, path: str) -> bool:
        if skipped_dir(os.path.basename(path)):
            return False
        real = os.path.realpath(path)
        return not any(real == x or real.startswith(x + os.sep) for x in self.excluded)

    def walk(self, base: str) -> Iterator[str]:
        """Relative paths below ``base``, which may be a file."""
        if os.path.isfile(base):
            if self._wanted(base):
                yield self.relative(base)
            return
        for folder, dirs, files in os.walk(base):
            dirs[:] = sorted(d for d in dirs if self._enter(os.path.join(folder, d)))
            for name in sorted(files):
                path = os.path.join(folder, name)
                if self._wanted(path):
                    yield self.relative(path)

    def matching(self, pattern: str) -> Iterator[str]:
        """Files of one include pattern: a file, a directory, or a glob.  A glob without a
        slash matches at any depth.  Directories of the deny-list are left out throughout."""
        direct = os.path.join(self.root, pattern)
        if os.path.exists(direct):
            found = [direct]
        else:
            deep = pattern if "/" in pattern or "**" in pattern else f"**/{pattern}"
            found = sorted(glob.glob(os.path.join(glob.escape(self.root), deep), recursive=True, include_hidden=True))
        for path in found:
            above = self.relative(path).split("/")[:-1]
            if any(skipped_dir(x) for x in above) or (os.path.isdir(path) and not self._enter(path)):
                continue
            yield from self.walk(path)

    def stat(self, relative: str) -> tuple[str, int, int] | None:
        """None if the file is gone or cannot be read."""
        try:
            found = os.stat(os.path.join(self.root, relative))
        except OSError:
            return None
        return relative, found.st_mtime_ns, found.st_size


class _Part(InputPartition):
    def __init__(self, bases: list[str], patterns: list[str]) -> None:
        self.bases, self.patterns = bases, patterns


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        extensions = tuple(json.loads(options["extensions"])) if "extensions" in options else EXTENSIONS
        self.walker = Walker(options["path"], extensions, tuple(json.loads(options.get("exclude_roots", "[]"))))
        self.base = options.get("base", "")
        self.includes = json.loads(options["includes"]) if "includes" in options else []
        self.parts = int(options.get("partitions", "16"))
        self.cap = int(options.get("max_file_bytes", "-1"))
        self.content = options.get("content", "false") == "true"
        self.paths: frozenset[str] | None = None

    def pushFilters(self, filters):  # noqa: N802
        """Path equality and size caps prune before a file is opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.paths = values if self.paths is None else self.paths & values
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("size",):
                self.cap = f.value if self.cap < 0 else min(self.cap, f.value)
            yield f  # still checked by Spark

    def partitions(self):
        if self.includes:
            return [_Part([], [p]) for p in self.includes]
        base = os.path.join(self.walker.root, self.base)
        try:
            entries = sorted(os.listdir(base))
        except OSError:
            return [_Part([], [])]
        bases = [p for e in entries if not os.path.isdir(p := os.path.join(base, e)) or self.walker._enter(p)]
        return [_Part(bases[i :: self.parts], []) for i in range(min(self.parts, max(1, len(bases))))]

    def read(self, partition: _Part):
        listed = (p for b in partition.bases for p in self.walker.walk(b))
        if partition.patterns:
            listed = (p for x in partition.patterns for p in self.walker.matching(x))
        for path in listed:
            if self.paths is not None and path not in self.paths:
                continue
            row = self.walker.stat(path)
            if row is None or (0 <= self.cap < row[2]):
                continue
            if not self.content:
                yield row
                continue
            try:
                with open(os.path.join(self.walker.root, path), "rb") as f:
                    # Bytes that are not UTF-8 are dropped, not replaced.
                    yield (*row, f.read().decode("utf-8", "ignore"))
            except OSError:
                continue


class _Changes(SimpleDataSourceStreamReader):
    """Files that are new, changed or deleted since the offset, a path -> (mtime, size) map."""

    def __init__(self, options: dict[str, str]) -> None:
        extensions = tuple(json.loads(options["extensions"])) if "extensions" in options else EXTENSIONS
        self.walker = Walker(options["path"], extensions, tuple(json.loads(options.get("exclude_roots", "[]"))))

    def initialOffset(self):  # noqa: N802
        return {"files": "{}"}

    def read(self, start: dict):
        before = json.loads(start["files"])
        now = {r[0]: [r[1], r[2]] for p in self.walker.walk(self.walker.root) if (r := self.walker.stat(p))}
        rows = [("created" if p not in before else "modified", p, *v) for p, v in now.items() if before.get(p) != v]
        rows += [("deleted", p, None, None) for p in before if p not in now]
        return iter(sorted(rows)), {"files": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        before, now = json.loads(start["files"]), json.loads(end["files"])
        rows = [("created" if p not in before else "modified", p, *v) for p, v in now.items() if before.get(p) != v]
        rows += [("deleted", p, None, None) for p in before if p not in now]
        return iter(sorted(rows))


class SourceTree(DataSource):
    """Options: path; base, includes (JSON list), extensions (JSON list), exclude_roots (JSON
    list), max_file_bytes, content, partitions."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _META + (", content string" if self.options.get("content", "false") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Changes(dict(self.options))


class TreeChanges(SourceTree):
    """The tree as a stream of (kind, path, mtime_ns, size)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree_changes"

    def schema(self) -> str:
        return "kind string, path string, mtime_ns long, size long"


def register(spark: SparkSession) -> None:
    ship(spark)
    # The reader takes path and size filters; Spark refuses such readers while this is off.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(TreeChanges)


def list_files(
    spark: SparkSession, root: str, includes: list[str] | None = None, *, content: bool = False, max_file_bytes: int | None = None,
    extensions: list[str] | None = None, exclude_roots: list[str] | None = None, limit: int | None = None, base: str = "",
) -> DataFrame:
    """Allowed files of a tree, once each; with a limit, the first by path."""
    register(spark)
    reader = spark.read.format("source_tree").option("content", str(content).lower()).option("base", base)
    for key, value in (("includes", includes or None), ("extensions", extensions), ("exclude_roots", exclude_roots)):
        if value is not None:
            reader = reader.option(key, json.dumps(list(value)))
    if max_file_bytes is not None:
        reader = reader.option("max_file_bytes", str(max_file_bytes))
    files = reader.load(root)
    if includes and len(includes) > 1:
        files = files.dropDuplicates(["path"])
    return files if limit is None else files.orderBy("path").limit(limit)


def read_contents(files: DataFrame, root: str, max_file_bytes: int | None = None, tasks: int | None = None) -> DataFrame:
    """(path, content) of ``files`` (path, ...) that are still there and not too large.

    Only these files are opened, in the tasks, and the tree is not walked again.
    """
    spark = files.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts, size = [], [], 0
            for path in b.column("path").to_pylist():
                full = os.path.join(root, path)
                try:
                    if not os.path.isfile(full) or (max_file_bytes is not None and os.path.getsize(full) > max_file_bytes):
                        continue
                    with open(full, "rb") as f:
                        text = f.read().decode("utf-8", "ignore")
                except OSError:
                    continue
                paths.append(path)
                texts.append(text)
                size += len(text)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "content"])
                    paths, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "content"])

    dealt = files.select("path").distinct().repartition(tasks or spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(run, "path string, content string")


def local_path(path: str, drives: str = "/mnt") -> str:
    """A drive path such as ``C:\\src\\x`` as ``/mnt/c/src/x`` where the system has no drives;
    other paths as they are."""
    if os.name != "nt" and len(path) > 2 and path[0].isalpha() and path[1] == ":" and path[2] in "\\/":
        return f"{drives}/{path[0].lower()}/{path[3:].replace(chr(92), '/')}".rstrip("/")
    return path


def read_file(root: str, relative: str) -> str:
    """One file's text; a path that leaves the root is refused."""
    top = os.path.realpath(root)
    path = os.path.realpath(os.path.join(top, relative))
    if path != top and not path.startswith(top + os.sep):
        raise PermissionError(f"outside the project root: {relative}")
    with open(path, "rb") as f:
        return f.read().decode("utf-8", "ignore")
