"""Projects: the tenants under which everything else is stored."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import Files


@dataclass
class Project:
    key: str
    name: str
    hint: str
    store_path: str
    project_root: str
    created_at: float


_SCHEMA = "key string, name string, hint string, store_path string, project_root string, created_at double"


class UnknownProject(KeyError):
    pass


class Catalog:
    """A registry file under ``base``; a missing or damaged one reads as empty."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base, self.files = spark, base.rstrip("/"), Files(spark)
        self.path = f"{self.base}/projects.json"

    def _load(self) -> dict[str, Project]:
        found = self.files.read_json(self.path)
        if not isinstance(found, dict):
            return {}
        return {k: Project(**v) for k, v in found.items() if isinstance(v, dict)}

    def _save(self, projects: dict[str, Project]) -> None:
        self.files.write_json(self.path, {k: asdict(v) for k, v in projects.items()})

    def register(self, hint: str = "", key: str | None = None, root: str = "") -> Project:
        """The project of a known key as it is, or a new one named after the hint."""
        projects = self._load()
        key = key or uuid.uuid4().hex
        if key not in projects:
            name = hint.replace("\\", "/").rstrip("/").rpartition("/")[2] or key[:8]
            projects[key] = Project(key, name, hint, f"{self.base}/store", root or hint, time.time())
            self._save(projects)
        return projects[key]

    def delete(self, key: str) -> bool:
        projects = self._load()
        gone = projects.pop(key, None) is not None
        if gone:
            self._save(projects)
        return gone

    def require(self, key: str | None) -> Project:
        """Every read and write goes through here, so no plan lacks its project filter."""
        if not key:
            raise PermissionError("a project key is required")
        found = self._load().get(key)
        if found is None:
            raise UnknownProject(key)
        return found

    def all(self) -> DataFrame:
        rows = [tuple(asdict(p).values()) for p in self._load().values()]
        return self.spark.createDataFrame(rows, _SCHEMA).orderBy("created_at", "key")

    def listing(self) -> DataFrame:
        return self.all().select("key", "name", "hint", "created_at")
