"""Tables, the shared folder and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.deploy import ship
from ..plans.files import Files
from ..plans.layout import spread

#: Used only where the session names no folder, as in tests on one machine.
DEFAULT_SHARED = "/tmp/checkpoints"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with the scheme of
    the default file system where it names none.

    Only a session on one machine may leave it unset; on a cluster a local folder would put
    each executor's tables on its own disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        return DEFAULT_SHARED
    whole = Files(spark).qualified(found)
    return found if local_form(whole) == found.rstrip("/") else whole


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder.  In the default folder it goes when Python ends; a
    configured folder is left to whoever set it, since lazy results may still read it."""
    folder = shared_dir(spark).rstrip("/")
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    if folder == DEFAULT_SHARED:
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def local_form(path: str) -> str | None:
    """The path as ``open`` takes it, or None if only Spark's readers reach it."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` texts at most, so that what Python makes of them at
    once stays small.  Spark's own bound on the bytes of a batch (64 MB) holds before that."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Unlike an in-memory or machine-local copy this survives lost executors.  The
    shuffle files behind the write are released as soon as it is done.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, tag)
    with _shuffles_released(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open.get():
        _open.get()[-1].append(out)
    return out


_lock = Lock()
#: By session: how many writes hold the setting, and what it was before the first.
_held: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that made them; writes of several threads share the setting,
    and the last to end restores it."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _held.get(key, (0, None))
        if n == 0:
            before = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _held[key] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _held.pop(key)
            if n > 1:
                _held[key] = (n - 1, before)
            elif before is None:
                spark.conf.unset(_CLEAN)
            else:
                spark.conf.set(_CLEAN, before)


#: The tables of each open :func:`temporary`, the innermost last; every thread has its own.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open tables", default=())


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread materializes within are deleted at its end, but for those handed to
    what it gives: nothing lazy may read the others any more by then."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _open.set((*_open.get(), made))
    try:
        yield keep
    finally:
        _open.reset(token)
        stay = {x.stored_at for x in kept}
        if _open.get():
            _open.get()[-1].extend(kept)  # for an outer one to decide on
        discard(*[x for x in made if x.stored_at not in stay])


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing lazy reads it any more."""
    for df in tables:
        if getattr(df, "stored_at", None):
            Files(df.sparkSession).delete(df.stored_at)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has, in any case."""
    have = {c.lower() for c in taken}
    while name in have:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: what the number of buckets and partitions follows."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def parts_for(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """Partitions of about ``each`` bytes, and not fewer than the session's own number."""
    return max(shuffle_parts(spark), -(-size // each))


#: What a broadcast may hold at most, in bytes of its columns; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether all rows of the stored table ``df`` are small enough to be broadcast."""
    limit = BROADCAST_BYTES if limit is None else limit
    if limit <= 0:
        return False
    size = [F.octet_length(F.col(f"`{f.name}`").cast("string")) if f.dataType.simpleString() in ("string", "binary") else F.length(F.to_json(F.struct(f"`{f.name}`"))) if f.dataType.simpleString().startswith(("array", "struct", "map")) else F.lit(8) for f in df.schema.fields]
    total = df.agg(F.sum(sum((F.coalesce(x, F.lit(0)) + 16 for x in size), F.lit(0)).cast("long"))).first()[0] or 0
    return total <= limit


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it fits, else as it is."""
    return F.broadcast(df) if fits(df, limit) else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each text's UTF-8 bytes; null gives empty bytes."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]

