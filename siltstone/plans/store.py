"""Chunk tables with upsert, replace, delete and reset on plain Parquet.

A collection is a set of buckets by hash of the path, and a numbered pointer file says which
folder holds each bucket's rows and the postings of their texts.  A change writes new folders
for the buckets it touches and then creates the next pointer.  Pointers are created whole, never
changed and never missing, and readers take the highest, so they see whole states and a failed
job leaves the old one in place.  Of two writers that began from the same state the second fails
with :class:`ConcurrentWrite` and can try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import search as S
from .files import Files

META = ["type", "path", "language", "symbol", "start_line", "end_line", "repo_root", "project"]
KINDS = {
    "id": "string", "text": "string", "embedding": "array<float>", "type": "string", "path": "string", "language": "string", "symbol": "string",
    "start_line": "int", "end_line": "int", "repo_root": "string", "project": "string", "extra": "map<string,string>",
}
SCHEMA = ", ".join(f"{c} {kind}" for c, kind in KINDS.items())
COLUMNS = list(KINDS)
#: Generations that stay readable after a flip, for queries that began before it.
KEEP = 2
BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one began."""


# -- the operations as plans ----------------------------------------------------


def last_by_id(items: DataFrame, order: str | None = None) -> DataFrame:
    """One row an id: the last in ``order``; without an order, or in a tie, the one whose text
    and other columns hash highest, which is the same however the rows are dealt."""
    rest = F.desc(F.xxhash64(*[F.col(c) for c in items.columns if not items.schema[c].dataType.simpleString().startswith("map")]))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*([F.desc(order)] if order else []), rest))
    return items.withColumn("__n", place).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Insert-or-replace by id."""
    new = last_by_id(new, order)
    new = new.drop(order) if order and order not in old.columns else new
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def delete_paths(old: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the rows of ``paths`` (path); rows without a path stay."""
    return old.join(paths.select("path").distinct(), "path", "left_anti")


def replace_by_path(old: DataFrame, new: DataFrame, paths: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """All rows of the touched paths give way to ``new``.

    The touched paths are those asked for, so a file that is gone or has grown past the cap
    loses its rows although nothing new came for it.
    """
    touched = new.select("path") if paths is None else paths.select("path").unionByName(new.select("path"))
    return upsert(delete_paths(old, touched.where("path IS NOT NULL AND path <> ''")), new, order)


def items_by_collection(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("collection", F.lit("docs")).alias("collection")).agg(F.count("*").alias("ingested"))


def bucket(path: Column | None = None) -> Column:
    """Where a row goes: by its path, or by its id if it has none."""
    key = F.coalesce("path", "id") if path is None else path
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class ChunkStore:
    """The stored generations of one project's collections."""

    def __init__(self, spark: SparkSession, base: str, project: str) -> None:
        self.spark, self.files = spark, Files(spark)
        self.root = f"{base.rstrip('/')}/project={project}"

    def _folder(self, collection: str) -> str:
        return f"{self.root}/collection={collection}"

    def _state(self, collection: str) -> dict:
        """The newest whole pointer: generation and, by bucket, folders and figures."""
        folder = f"{self._folder(collection)}/_pointers"
        for name in reversed([x for x in self.files.names(folder) if x.endswith(".json")]):
            found = self.files.read_json(f"{folder}/{name}")
            if isinstance(found, dict):
                return found
        return {"generation": 0, "buckets": {}}

    def generation(self, collection: str) -> int:
        return self._state(collection)["generation"]

    def _rows(self, collection: str, state: dict, buckets: set[int] | None = None) -> DataFrame:
        picked = [v["rows"] for k, v in state["buckets"].items() if buckets is None or int(k) in buckets]
        if not picked:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self._folder(collection)}/{x}" for x in picked])

    def read(self, collection: str) -> DataFrame:
        return self._rows(collection, self._state(collection))

    def lexical(self, collection: str) -> S.Lexical:
        """The stored postings of the collection, and how many documents and tokens it has."""
        state = self._state(collection)
        kept = state["buckets"].values()
        paths = [f"{self._folder(collection)}/{v['index']}" for v in kept if v["tokens"]]
        index = self.spark.read.schema(S.INDEX).parquet(*paths) if paths else self.spark.createDataFrame([], S.INDEX)
        return S.Lexical(index, sum(v["n"] for v in kept), sum(v["tokens"] for v in kept))

    def _commit(self, collection: str, state: dict, rows: DataFrame, touched: set[int] | None = None) -> int:
        """``rows`` are all rows of the ``touched`` buckets from now on; None: of all."""
        g, tag, folder = state["generation"] + 1, uuid.uuid4().hex[:12], self._folder(collection)
        # Rows of a file stand together, so that a path filter skips row groups; buckets of any
        # size are dealt over as many tasks as they need.
        dealt = rows.select(*COLUMNS, bucket().alias("b")).hint("rebalance", "b").sortWithinPartitions("b", "path")
        dealt.write.partitionBy("b").parquet(f"{folder}/rows-{tag}")
        stored = self.spark.read.schema(f"{SCHEMA}, b int").parquet(f"{folder}/rows-{tag}")
        S.write_index(stored, f"{folder}/index-{tag}", "b")
        index = self.spark.read.schema(f"{S.INDEX}, b int").parquet(f"{folder}/index-{tag}")
        tokens = {r["b"]: r["n"] for r in index.groupBy("b").agg(S.tokens_of().alias("n")).collect()}  # BUCKETS rows
        buckets = {} if touched is None else {k: v for k, v in state["buckets"].items() if int(k) not in touched}
        for r in stored.groupBy("b").count().collect():
            b = r["b"]
            buckets[str(b)] = {"rows": f"rows-{tag}/b={b}", "index": f"index-{tag}/b={b}", "n": r["count"], "tokens": tokens.get(b, 0)}
        try:
            self.files.create_json(f"{folder}/_pointers/{g:010d}.json", {"generation": g, "buckets": buckets})
        except FileExistsError:
            self.files.delete(f"{folder}/rows-{tag}")
            self.files.delete(f"{folder}/index-{tag}")
            raise ConcurrentWrite(f"{collection}: generation {g} is another writer's") from None
        self._forget(collection, g)
        return g

    def _forget(self, collection: str, newest: int) -> None:
        """Delete pointers older than the kept ones, and bucket folders that only they name."""
        folder = self._folder(collection)
        states = {}
        for name in self.files.names(f"{folder}/_pointers"):
            found = self.files.read_json(f"{folder}/_pointers/{name}")
            if isinstance(found, dict):
                states[name] = found
        named = lambda s: {v[x] for v in s["buckets"].values() for x in ("rows", "index")}
        old = {n: s for n, s in states.items() if s["generation"] <= newest - KEEP}
        live = {x for n, s in states.items() if n not in old for x in named(s)}
        for x in sorted({x for s in old.values() for x in named(s)} - live):
            self.files.delete(f"{folder}/{x}")
        for name in old:
            self.files.delete(f"{folder}/_pointers/{name}")

    def write(self, collection: str, rows: DataFrame) -> int:
        """The collection is these rows and no others."""
        return self._commit(collection, self._state(collection), conform(rows))

    def upsert(self, collection: str, items: DataFrame, replace: bool = False, paths: DataFrame | None = None, order: str | None = None) -> int:
        """Insert or replace by id, the last in ``order`` of equal ids; with ``replace`` all rows of
        the items' and the asked ``paths`` give way.  Only buckets that lose or gain rows are
        written anew."""
        state, place = self._state(collection), f"{self._folder(collection)}/_incoming-{uuid.uuid4().hex[:12]}"
        made = last_by_id(items, order) if order else items
        conform(made.drop(order) if order else made).write.parquet(place)  # made once, embeddings too
        try:
            items = self.spark.read.schema(SCHEMA).parquet(place)
            asked = items.select("path") if paths is None else paths.select("path").unionByName(items.select("path"))
            stored = self._rows(collection, state).select("id", "path")
            moved = stored.join(items.select("id"), "id", "left_semi").select(bucket().alias("b"))
            hit = items.select(bucket().alias("b")).unionByName(moved)
            if replace:
                hit = hit.unionByName(asked.where("path IS NOT NULL").select(bucket(F.col("path")).alias("b")))
            touched = {r["b"] for r in hit.distinct().collect()}  # BUCKETS rows at most
            old = self._rows(collection, state, touched)
            return self._commit(collection, state, replace_by_path(old, items, asked) if replace else upsert(old, items), touched)
        finally:
            self.files.delete(place)

    def delete_paths(self, collection: str, paths: DataFrame) -> int:
        state = self._state(collection)
        touched = {r["b"] for r in paths.select(bucket(F.col("path")).alias("b")).distinct().collect()}
        return self._commit(collection, state, delete_paths(self._rows(collection, state, touched), paths), touched)

    def reset(self, collection: str) -> int:
        return self._commit(collection, self._state(collection), self.spark.createDataFrame([], SCHEMA))

    def get(self, collection: str, ids: list[str] | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.read(collection)
        if ids is not None:
            wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
            rows = rows.join(F.broadcast(wanted.distinct()), "id")  # the caller's list
        if path is not None:
            rows = rows.where(F.col("path") == path)
        return rows if limit is None else rows.orderBy("id").limit(limit)

    def count(self, collection: str) -> int:
        return sum(v["n"] for v in self._state(collection)["buckets"].values())

    def paths(self, collection: str) -> DataFrame:
        return self.read(collection).where("path IS NOT NULL AND path <> ''").select("path").distinct()


def conform(items: DataFrame) -> DataFrame:
    """Items with the store's columns; what it has no column for goes to ``extra``."""
    have = set(items.columns)
    out = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in KINDS.items() if c != "extra"]
    more = sorted(have - set(KINDS))
    extra = F.map_filter(F.create_map(*[x for c in more for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if more else F.lit(None)
    if "extra" in have:
        extra = F.map_concat(F.coalesce("extra", F.create_map().cast("map<string,string>")), extra) if more else F.col("extra")
    out.append(extra.cast("map<string,string>").alias("extra"))
    return items.select(*out).withColumn("id", F.coalesce("id", F.expr("uuid()")))
