"""One object for all tools: projects, ingest, search, jobs and resources."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import OrderedDict
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .config import Settings, load
from .operators import search as S
from .operators.embed import backend, embed, with_embedding
from .operators.rerank import OnnxCrossEncoder, scorer
from .plans import store as K
from .plans import sync as Y
from .plans.catalog import Catalog, Project
from .plans.deploy import ship
from .plans.jobs import Jobs
from .sources import tree
from .streaming import watch as R

INSTRUCTIONS = "Search first; fetch whole chunks by id only when a preview is not enough; ingest after large changes."
PREVIEW = 400
#: Search results that ``fetch_chunks`` can still find.
CACHED = 10_000


class Engine:
    """The engine of one project; ``key`` is checked on every call."""

    def __init__(self, spark: SparkSession, base: str | None = None, embedder=None, reranker=None, settings: Settings | None = None) -> None:
        """``settings`` (:func:`siltstone.config.load` if not given) say where the index is, how
        texts are embedded and matches re-ranked, and which files are read; what is given here
        goes before them."""
        ship(spark)
        self.settings = s = load() if settings is None else settings
        self.spark, self.base = spark, s.store if base is None else base
        self.embedder = backend(s.embed_backend, s.embed_model, s.embed_tokenizer) if embedder is None else embedder
        if reranker is None and s.rerank_model:
            model = s.rerank_model
            reranker = scorer(lambda: OnnxCrossEncoder(model, os.path.join(os.path.dirname(model), "tokenizer.json")))
        self.reranker = reranker
        self.catalog, self.jobs = Catalog(spark, self.base), Jobs(spark)
        self.cache: OrderedDict[str, dict[str, Any]] = OrderedDict()

    def _pool(self, name: str) -> None:
        """Searches and ingests run in pools of their own; with ``spark.scheduler.mode`` FAIR a
        search does not wait for an ingest's tasks (pools that no file describes share alike)."""
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)

    # -- projects

    def register_project(self, root: str, key: str | None = None) -> Project:
        return self.catalog.register(root, key, root)

    def list_projects(self) -> DataFrame:
        return self.catalog.listing()

    def project_key(self, folder: str) -> str:
        """The key kept in ``folder``'s ``.project-key`` file, which is made if missing."""
        path = os.path.join(folder, ".project-key")
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)["key"]
            return str(found)
        except (OSError, ValueError, KeyError, TypeError):
            key = uuid.uuid4().hex
            with open(path, "w", encoding="utf-8") as f:
                json.dump({"key": key}, f)
            return key

    def _store(self, key: str) -> tuple[Project, K.ChunkStore]:
        project = self.catalog.require(key)
        return project, K.ChunkStore(self.spark, project.store_path, project.key)

    def _sync(self, key: str, job: str | None = None) -> Y.Sync:
        self._pool(self.settings.ingest_pool)
        project, store = self._store(key)
        more = {"progress": self.jobs.progress(job), "should_stop": self.jobs.stopping(job)} if job else {}
        s = self.settings
        return Y.Sync(
            self.spark, store, tree.local_path(project.project_root), self.embedder, max_file_bytes=s.max_file_bytes, extensions=s.extensions, includes=s.includes, **more
        )

    def project_status(self, key: str, collection: str = "code") -> dict[str, Any]:
        project, store = self._store(key)
        try:
            n = store.count(collection)
        except Exception:  # a damaged store is reported, not raised
            n = -1
        return asdict(project) | {"collection": collection, "collection_docs": n, "generation": store.generation(collection)}

    def health(self) -> dict[str, Any]:
        backend = self.embedder()
        return {"status": "ok", "spark": self.spark.version, "embedder": type(backend).__name__, "reranker": self.reranker is not None, "jobs": len(self.jobs.rows)}

    # -- ingest

    def scan_project(self, key: str, includes: list[str] | None = None, limit: int | None = 5000) -> dict[str, Any]:
        return self.jobs.call("scan_project", lambda: self._scan(key, includes, limit), includes=includes, limit=limit)

    def _scan(self, key: str, includes: list[str] | None, limit: int | None) -> dict[str, Any]:
        files = self._sync(key).snapshot(includes, limit)
        totals = Y.scan_totals(files).first().asDict()
        by = {r["ext"]: r["files"] for r in Y.scan_summary(files).collect()}
        sample = [r["path"] for r in files.select("path").orderBy("path").limit(20).collect()]
        return totals | {"by_extension": by, "sample_paths": sample, "skipped_dirs": sorted(tree.SKIP_DIRS)}

    def plan_ingest(self, key: str, collection: str = "code", includes: list[str] | None = None) -> dict:
        return self._sync(key).plan(collection, includes)

    def ingest_project(self, key: str, collection: str = "code", wait: bool = False, **options: Any) -> str:
        return self.jobs.run("ingest_project", lambda job: asdict(self._sync(key, job).run(collection, **options)), wait)

    confirm_ingest_project = ingest_project

    def ingest_paths(self, key: str, paths: list[str], collection: str = "code", replace_by_path: bool = True, wait: bool = True) -> str:
        return self.jobs.run("ingest_paths", lambda job: {"chunks": self._sync(key, job).ingest_paths(collection, paths, replace_by_path)}, wait)

    confirm_ingest_paths = ingest_paths

    def ingest_texts(self, key: str, texts: list[str], collection: str = "docs") -> int:
        if not texts or not all(isinstance(x, str) for x in texts):
            raise ValueError("texts must be a non-empty list of strings")
        _, store = self._store(key)
        rows = self.spark.createDataFrame([(uuid.uuid4().hex, x) for x in texts], "id string, text string")
        store.upsert(collection, with_embedding(rows, self.embedder))
        return len(texts)

    def ingest_items(self, key: str, items: list[dict[str, Any]], replace_by_path: bool = False) -> dict[str, Any]:
        """Rows of (text, id, metadata, collection); what is not a known field goes to extra."""
        if not items or not all(isinstance(x, dict) and isinstance(x.get("text"), str) for x in items):
            raise ValueError("every item needs a text")
        project, store = self._store(key)
        ours = {"repo_root": tree.local_path(project.project_root), "project": project.key}  # where an item does not say
        by: dict[str, list[tuple]] = {}
        for n, x in enumerate(items):
            meta = ours | {k: v for k, v in (x.get("metadata") or {}).items() if k not in ours or v is not None}
            known = tuple(None if meta.get(c) is None else str(meta[c]) for c in K.META)
            extra = {str(k): str(v) for k, v in meta.items() if k not in K.META and v is not None}
            by.setdefault(x.get("collection") or "docs", []).append((n, x.get("id") or str(uuid.uuid4()), x["text"], *known, extra))
        schema = "n int, id string, text string, " + ", ".join(f"{c} string" for c in K.META) + ", extra map<string,string>"
        replaced = {}
        for collection, rows in by.items():
            made = with_embedding(self.spark.createDataFrame(rows, schema), self.embedder)
            store.upsert(collection, made, replace_by_path, order="n")
            if replace_by_path:
                replaced[collection] = sorted({r[4] for r in rows if r[4]})
        return {"ok": True, "ingested": len(items), "by_collection": {c: len(r) for c, r in by.items()}, "replaced": replaced}

    def reset(self, key: str, collection: str = "docs") -> None:
        self._store(key)[1].reset(collection)

    def delete_paths(self, key: str, paths: list[str], collection: str = "code") -> dict[str, int]:
        _, store = self._store(key)
        store.delete_paths(collection, self.spark.createDataFrame([(p,) for p in paths], "path string"))
        return {"deleted_paths": len(set(paths))}

    def rebuild_manifest(self, key: str, collection: str = "code") -> int:
        sync = self._sync(key)
        rows = Y.rebuild_manifest(sync.store.paths(collection), sync.snapshot(), sync.manifest(collection))
        sync.save_manifest(collection, rows)
        return sync.manifest(collection).count()

    def watch(self, key: str, checkpoint: str, collection: str = "code", trigger: dict | None = None) -> StreamingQuery:
        """Keep the collection equal to the project's tree until the query is stopped: changes of
        one interval of ``debounce_seconds`` are ingested together, deletions too."""
        sync = self._sync(key)
        trigger = trigger or {"processingTime": f"{self.settings.debounce_seconds} seconds"}
        return R.watch(self.spark, sync.root, lambda paths, _: sync.ingest_paths(collection, paths), checkpoint, trigger=trigger, options=sync.tree_options())

    def ingest_errors(self, key: str, collection: str = "code") -> DataFrame:
        """Files that the last ingest could not parse, and why."""
        return self._sync(key).errors(collection)

    # -- search

    def search_frame(self, key: str, queries: DataFrame, k: int = 6, collection: str = "code", hybrid: bool = False, rerank: bool = False) -> DataFrame:
        """A batch of ``queries`` (qid, text) -> ranked matches with doc, score and metadata."""
        _, store = self._store(key)
        rows = store.read(collection)
        asked = queries.select("qid", embed(F.col("text"), self.embedder).alias("vector"))
        vectors = rows.select("id", F.col("embedding").alias("vector"))
        found = S.vector_topk(vectors, asked, k)
        if hybrid:
            found = S.rrf_fuse(found, S.bm25_topk(None, queries, 3 * k, store.lexical(collection)), k)
        meta = rows.select("id", F.col("text").alias("doc"), F.struct(*K.META).alias("meta"))
        hits = k * S.bounded(queries, S.BROADCAST_QUERIES)
        found = S.maybe_broadcast(found, hits, S.BROADCAST_QUERIES).join(meta, "id")
        if rerank:
            found = S.rerank(queries, found, self.reranker).withColumn("rank", F.col("new_rank")).drop("new_rank")
        return found.orderBy("qid", "rank")

    def search(self, key: str, query: str, top_k: int = 6, collection: str = "code", hybrid: bool = False, rerank_results: bool = False) -> list[dict[str, Any]]:
        """Matches of one query with 400-character previews; whole chunks stay in the cache."""
        work = lambda: self._search(key, query, top_k, collection, hybrid, rerank_results)
        return self.jobs.call("search", work, query=query, top_k=top_k, collection=collection)

    def _search(self, key: str, query: str, top_k: int, collection: str, hybrid: bool, rerank_results: bool) -> list[dict[str, Any]]:
        self._pool(self.settings.search_pool)
        one = self.spark.createDataFrame([(0, query)], "qid int, text string")
        out = []
        for r in self.search_frame(key, one, top_k, collection, hybrid, rerank_results).collect():
            row = {"query": query, "rank": r["rank"], "doc": r["doc"], "meta": r["meta"].asDict(), "score": r["score"]}
            name = hashlib.sha1(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
            self.cache[name] = row
            self.cache.move_to_end(name)
            while len(self.cache) > CACHED:
                self.cache.popitem(last=False)
            more = {c: r[c] for c in ("rrf_score", "rerank_score") if c in r}
            out.append({"id": name, "chunk_id": r["id"], "rank": r["rank"], "score": r["score"], "preview": r["doc"][:PREVIEW], "meta": row["meta"]} | more)
        return out

    def fetch_chunks(self, ids: list[str]) -> dict[str, list]:
        """Cached chunks in the order asked for, and the ids that are not there."""
        return {"found": [{"id": i} | self.cache[i] for i in ids if i in self.cache], "missing": [i for i in ids if i not in self.cache]}

    def rerank(self, query: str, docs: list[str]) -> list[dict[str, Any]]:
        return self.jobs.call("rerank", lambda: self._rerank(query, docs), query=query) if docs else []

    def _rerank(self, query: str, docs: list[str]) -> list[dict[str, Any]]:
        one = self.spark.createDataFrame([(0, query)], "qid int, text string")
        rows = self.spark.createDataFrame([(0, n, str(n), d) for n, d in enumerate(docs, 1)], "qid int, rank int, id string, doc string")
        found = S.rerank(one, rows, self.reranker).orderBy("new_rank").collect()
        return [{"doc": r["doc"], "rank": r["new_rank"]} | ({"rerank_score": r["rerank_score"]} if "rerank_score" in r and r["rerank_score"] is not None else {}) for r in found]

    # -- jobs and resources

    def get_job_status(self, job: str) -> dict[str, Any]:
        return self.jobs.status(job)

    def list_recent_jobs(self, limit: int = 20) -> DataFrame:
        return self.jobs.recent(limit)

    def stop_job(self, job: str) -> bool:
        return self.jobs.stop(job)

    def resource(self, name: str, key: str | None = None) -> str:
        """``system/instructions``, ``chunk/<id>`` or ``file/<path>``."""
        kind, _, rest = name.partition("/")
        if name == "system/instructions":
            return INSTRUCTIONS
        if kind == "chunk":
            return self.cache[rest]["doc"]
        if kind == "file":
            return tree.read_file(self._store(key)[0].project_root, rest)
        raise KeyError(name)
