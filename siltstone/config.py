"""Settings: defaults, then ``.env`` files from the least to the most specific, then the
environment.  Names are upper-case field names with the prefix ``SILTSTONE_``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .operators.embed import BATCH, MAX_CHARS
from .sources.tree import EXTENSIONS, MAX_FILE_BYTES, parse_includes

PREFIX = "SILTSTONE_"


@dataclass
class Settings:
    store: str = "store"
    embed_backend: str = "hashing"
    embed_model: str = ""
    embed_tokenizer: str = ""
    embed_batch_size: int = BATCH
    embed_max_chars: int = MAX_CHARS
    rerank_model: str = ""
    allowed_extensions: str = ",".join(EXTENSIONS)
    include_patterns: str = ""
    max_file_bytes: int = MAX_FILE_BYTES
    debounce_seconds: float = 4.0
    search_pool: str = "search"
    ingest_pool: str = "ingest"

    @property
    def extensions(self) -> list[str]:
        return [x for part in self.allowed_extensions.split(",") if (x := part.strip())]

    @property
    def includes(self) -> list[str]:
        return parse_includes(self.include_patterns)


def read_env(path: str) -> dict[str, str]:
    """KEY=value lines; quotes around a value go, comments and other lines are skipped."""
    out: dict[str, str] = {}
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return out
    for line in map(str.strip, lines):
        key, equals, value = line.partition("=")
        if equals and not line.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[key.removeprefix("export ").strip()] = value[1:-1] if quoted else value
    return out


def load(*folders: str, environ: dict[str, str] | None = None) -> Settings:
    """Settings from the folders' ``.env`` files, later ones first in rank, and ``environ``."""
    found: dict[str, str] = {}
    for folder in folders or (os.path.dirname(__file__), os.getcwd()):
        found |= read_env(os.path.join(folder, ".env"))
    found |= os.environ if environ is None else environ
    out = Settings()
    for f in fields(Settings):
        raw = found.get(PREFIX + f.name.upper())
        if raw is not None:
            setattr(out, f.name, type(f.default)(raw))
    return out
