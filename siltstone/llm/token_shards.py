"""Training-order materialisation: token sequences in fixed-stride records, keyed order.

Texts become token ids and are cut into sequences; every sequence has an ordinal, dense over
the corpus.  A keyed Feistel network permutes the smallest square power of two that holds the
ordinals, and cycle-walking - applying it again while the result lies outside - makes that a
permutation of the ordinals themselves: the sequence's slot.  Slots are cut into ranges, one
a shard; a shard is records of equal size in slot order, so reading a stretch of training
steps is one sequential read and a run resumes at ``slot * stride`` without an index.

Ordinals follow from the data alone: documents are dealt by ranges of a hash of id and text
and sorted by it, sequences are stored with their range and their place in it, and a range's
first ordinal is the number of sequences of the ranges before.  How many ranges, partitions or
cores there are changes nothing.  Rows equal in id and text are interchangeable.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_form, materialize, shared_path, ship, shuffle_parts, slices, utf8_list

#: Where the vocabulary files are; a parameter of every function that reads one.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary cuts text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END, PAD = 50256, 65535
SEQUENCE, SHARD_RECORDS, KEY = 256, 16_384, 0x5EED_2024_0B5E_55ED
ROUNDS = 6
#: Passes in which shards are written: only one pass's shuffle is on disk at a time.
PASSES = 2
#: The same pieces for texts on which the tokenizer's own pattern gives up (runs of a million spaces).
_PIECES = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


@dataclass(frozen=True)
class Order:
    """A keyed permutation of range(n)."""

    n: int
    key: int = KEY

    def _half(self) -> int:
        return max(1, -(-max(1, (self.n - 1).bit_length()) // 2))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self._half())
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            salt = np.uint64(int.from_bytes(hashlib.blake2b(f"{self.key}:{i}".encode(), digest_size=8).digest(), "little"))
            mixed = (left if back else right) + salt
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = ((mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)
            left, right = (right ^ (mixed & mask), left) if back else (right, left ^ (mixed & mask))
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while len(again := np.flatnonzero(out >= np.uint64(self.n))):
            out[again] = self._once(out[again], back)
        return out.astype(np.int64)

    def slots(self, ordinals: np.ndarray) -> np.ndarray:
        return self._walk(ordinals, False)

    def ordinals(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def read_ranks(spark: SparkSession, path: str = RANKS) -> bytes:
    """A vocabulary file's bytes, from the driver's disk or any store that Spark reads."""
    here = local_form(path)
    if here is not None:
        with open(here, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


_loaded: dict[str, object] = {}


def _encoder(ranks: bytes):
    """The tokenizer, built once a worker."""
    name = hashlib.sha256(ranks).hexdigest()
    if name not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[name]


def encode(text: str, encoder) -> np.ndarray:
    """Token ids of the whole text, and END."""
    try:
        ids = encoder.encode_to_numpy(text, disallowed_special=())
    except ValueError:  # its pattern ran out of stack: the pieces are found here, and merged there
        import regex

        found = (encoder._encode_single_piece(m.group().encode()) for m in regex.finditer(_PIECES, text))
        ids = np.fromiter((i for piece in found for i in piece), np.uint32)
    return np.append(ids, END).astype("<u2")


def tokenized(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with a ``text`` column, and the ids of their texts."""
    encoder = _encoder(ranks)
    for b in slices(batches):
        yield b, [encode(t.decode(), encoder) for t in utf8_list(b.column("text"))]


def in_key_order(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text) sorted by a hash of id and text; parts are ranges of it."""
    spark = docs.sparkSession
    parts = max(shuffle_parts(spark), docs.rdd.getNumPartitions())
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("string"), text)
    rows = docs.select(key.alias("key"), "doc_id", text.alias("text"))
    part = F.shiftright((F.shiftrightunsigned(F.col("key"), 33)) * parts, 31).cast("int")
    dealt = rows.select(part.alias("part"), "*").repartitionById(parts, "part")
    return dealt.sortWithinPartitions(F.shiftrightunsigned("key", 1), "key", "doc_id", "text").drop("key")


def sequences(docs: DataFrame, length: int = SEQUENCE, ranks_path: str = RANKS) -> DataFrame:
    """(part, place, doc_id, seq_no, n_tokens, ids) stored in the shared folder.

    A text's last sequence may be short; null and empty texts are one END, however long a text
    is its ids are those of one call.  Ids may be null, repeated or strings; other columns are
    not used, so their names may clash.  An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))  # one vocabulary file
    rows = in_key_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = None, 0
        for b, texts in tokenized(batches, ranks.value):
            whose, numbers, sizes, ids, places = [], [], [], [], []
            for i, (part, all_ids) in enumerate(zip(b.column("part").to_pylist(), texts, strict=True)):
                if part != now:
                    now, place = part, 0
                for k in range(0, len(all_ids), length):
                    one = all_ids[k : k + length]
                    whose.append(i)
                    numbers.append(k // length)
                    sizes.append(len(one))
                    ids.append(one.tobytes())
                    places.append(place)
                    place += 1
            whose = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("part").take(whose), pa.array(places, pa.int64()), b.column("doc_id").take(whose),
                    pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary()),
                ],
                ["part", "place", "doc_id", "seq_no", "n_tokens", "ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"part int, place long, doc_id {kind}, seq_no int, n_tokens int, ids binary")
    return materialize(made, "tokens", "zstd")


def training_order(stored: DataFrame, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS, key: int = KEY) -> DataFrame:
    """(slot, shard, offset, doc_id, seq_no, n_tokens, record) of stored :func:`sequences`.

    ``record`` is ``length`` little-endian 16-bit ids, PAD after the last; ``offset`` its
    place in the shard's bytes.  Partitions are slot ranges of whole shards, as many as the
    stored table has splits, sorted by slot.
    """
    sizes = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a split of the input
    parts = sorted(sizes)
    starts = np.cumsum([0, *[sizes[p] for p in parts]])
    order = Order(int(starts[-1]), key)
    names = np.array(parts, np.int64)
    shards = max(1, -(-order.n // shard_records))
    ranges = min(shards, max(shuffle_parts(stored.sparkSession), stored.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = starts[np.searchsorted(names, b.column("part").to_numpy())]
            slot = order.slots(first + b.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array((slot // shard_records).astype(np.int32)), *(b.column(c) for c in ("doc_id", "seq_no", "n_tokens", "ids"))],
                ["slot", "shard", "doc_id", "seq_no", "n_tokens", "ids"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    placed = stored.mapInArrow(run, f"slot long, shard int, doc_id {kind}, seq_no int, n_tokens int, ids binary")
    stride = 2 * length
    dealt = placed.repartitionById(ranges, F.floor(F.col("shard") * ranges / shards).cast("int")).sortWithinPartitions("slot")
    return dealt.select(
        "slot", "shard", ((F.col("slot") % shard_records) * stride).alias("offset"), "doc_id", "seq_no", "n_tokens",
        F.rpad("ids", stride, F.lit(b"\xff\xff")).alias("record"),
    )


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write each shard of :func:`training_order` as ``shard-NNNNN.bin`` and return
    (shard, first_slot, records, bytes, sha256).  Files are renamed into place, so a retried
    task leaves whole files only.  ``folder`` is one that every executor reaches: a path, or
    a store that ``pyarrow.fs`` opens."""
    here = local_form(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        open_: list = []  # shard, first slot, records, digest, file, name

        def close() -> pa.RecordBatch:
            shard, first, n, digest, f, name = open_
            size = f.tell()
            f.close()
            if here is not None:
                os.replace(name, f"{here}/shard-{shard:05d}.bin")
            else:
                fs.move(name, f"{at}/shard-{shard:05d}.bin")
            open_.clear()
            return pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": first, "records": n, "bytes": size, "sha256": digest.hexdigest()}], schema)

        schema = pa.schema([("shard", pa.int32()), ("first_slot", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        if here is not None:
            os.makedirs(here, exist_ok=True)
        else:
            fs, at = pafs.FileSystem.from_uri(folder)
            fs.create_dir(at)
        for b in batches:
            for slot, shard, record in zip(*(b.column(c).to_pylist() for c in ("slot", "shard", "record")), strict=True):
                if open_ and open_[0] != shard:
                    yield close()
                if not open_:
                    name = f"{at if here is None else here}/.shard-{shard:05d}.{TaskContext.get().taskAttemptId()}"
                    open_[:] = [shard, slot, 0, hashlib.sha256(), fs.open_output_stream(name) if here is None else open(name, "wb"), name]
                open_[4].write(record)
                open_[3].update(record)
                open_[2] += 1
        if open_:
            yield close()

    return ordered.select("slot", "shard", "record").mapInArrow(run, "shard int, first_slot long, records long, bytes long, sha256 string")


def open_shard(folder: str, shard: int):
    """A shard's file, to read and seek in."""
    name, here = f"shard-{shard:05d}.bin", local_form(folder)
    if here is not None:
        return open(f"{here}/{name}", "rb")
    fs, at = pafs.FileSystem.from_uri(folder)
    return fs.open_input_file(f"{at}/{name}")


def from_shards(stored: DataFrame, folder: str, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS, key: int = KEY) -> DataFrame:
    """The rows of :func:`training_order`, with every record read from the written shards.

    Only names and sizes are dealt again, not tokens; each shard is one sequential read.
    """
    stride = 2 * length
    bare = stored.withColumn("ids", F.lit(b""))
    placed = training_order(bare, length, shard_records, key).drop("record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        try:
            for b in batches:
                records = []
                for shard, at in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True):
                    if shard != now:
                        if f is not None:
                            f.close()
                        now, f = shard, open_shard(folder, shard)
                    if f.tell() != at:
                        f.seek(at)
                    records.append(f.read(stride))
                    if len(records[-1]) != stride:
                        raise OSError(f"shard {shard} ends before {at + stride}")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(records, pa.binary())], [*b.schema.names, "record"])
        finally:
            if f is not None:
                f.close()

    kind = stored.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"slot long, shard int, offset long, doc_id {kind}, seq_no int, n_tokens int, record binary")


def through_shards(docs: DataFrame) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder, and give their rows as read from there."""
    stored = sequences(docs)
    folder = shared_path(docs.sparkSession, "shards")
    ordered = training_order(stored)
    for k in range(PASSES):  # every shard is written in one of them
        materialize(write_shards(ordered.where(F.col("shard") % PASSES == k), folder), "shard-list")
    return from_shards(stored, folder)


def read_records(folder: str, slot: int, count: int, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS) -> Iterator[np.ndarray]:
    """``count`` token sequences from ``slot`` on, without padding: how training resumes."""
    stride = 2 * length
    while count > 0:
        shard, at = divmod(slot, shard_records)
        with open_shard(folder, shard) as f:
            f.seek(at * stride)
            data = f.read(min(count, shard_records - at) * stride)
        if not data:
            return
        for k in range(0, len(data), stride):
            ids = np.frombuffer(data[k : k + stride], "<u2")
            yield ids[ids != PAD]
        slot, count = slot + len(data) // stride, count - len(data) // stride
