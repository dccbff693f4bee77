"""Variable-capacity best-fit packing of documents into training sequences.

Packing depends on lengths alone, and there are at most ``max(capacities)`` different ones,
so best-fit decreasing runs exactly on the histogram of lengths: bins of equal contents are
one group with a count, and items of one length move through groups by the thousand.  The
histogram, the groups and the slots they offer are bounded by the largest capacity, not by
the corpus.  Each item's rank among items of its length then picks its slot, so every item
is placed by arithmetic; ranks come from salted counts, so a very common length is not
ranked in one task.  Salts follow from the number of items, so placing depends on the data
alone, not on partitions or cores.

Lengths are those of real token ids.  Texts are tokenised once; their ids travel with the
ranking, and each bin's ids are then laid one after the other into a sequence of its capacity.

Opening: a new bin takes the permitted capacity with the least cost for each token that it
can expect to hold.  At the end each bin shrinks to the smallest capacity that holds it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, parts_for, ship
from .token_shards import PAD, RANKS, read_ranks, tokenized

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence in token equivalents: a fixed part, its tokens, and attention.
FIXED_COST, ATTENTION = 64, 16_384
#: Items of one length that are ranked together, about.
SALTED = 4096
#: Both bytes of the padding id are the same.
_PAD = PAD.to_bytes(2, "little")[:1]


def cost(capacity: int) -> float:
    return FIXED_COST + capacity + capacity * capacity / ATTENTION


def opening(length: int, left: int, capacities: tuple[int, ...] = CAPACITIES) -> int:
    """Capacity for a new bin for an item of ``length``, with ``left`` tokens yet unplaced
    after it: the least cost for each token of expected contents; of equals the smaller."""
    fit = [c for c in capacities if c >= length]
    return min(fit, key=lambda c: (cost(c) / min(c, length + left), c))


@dataclass
class Group:
    """``count`` bins that hold items of the same lengths, in the order of placing."""

    count: int
    capacity: int
    used: int
    items: tuple = ()  # ((length, copies), ...)

    def with_items(self, count: int, length: int, copies: int) -> Group:
        return Group(count, self.capacity, self.used + length * copies, (*self.items, (length, copies)))


@dataclass
class Plan:
    """Slots by length: rank r of length L is in range i = searchsorted(last, r, 'right')."""

    capacities: tuple[int, ...]
    groups: list[Group]
    last: dict[int, np.ndarray] = field(default_factory=dict)
    first_bin: dict[int, np.ndarray] = field(default_factory=dict)
    copies: dict[int, np.ndarray] = field(default_factory=dict)
    offset: dict[int, np.ndarray] = field(default_factory=dict)
    size: dict[int, np.ndarray] = field(default_factory=dict)

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset in bin, capacity) of items of one length, by rank from 0."""
        last = self.last[length]
        i = np.searchsorted(last, rank, "right")
        within = rank - np.where(i > 0, last[np.maximum(i, 1) - 1], 0)
        m = self.copies[length][i]
        return self.first_bin[length][i] + within // m, self.offset[length][i] + (within % m) * length, self.size[length][i]


def pack(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> Plan:
    """Best-fit decreasing of ``histogram`` {length: items}; lengths from 1 to the largest
    capacity."""
    capacities = tuple(sorted(capacities))
    left = sum(n * k for n, k in histogram.items())
    open_: dict[int, list[Group]] = {}
    rooms: list[int] = []
    full: list[Group] = []

    def put(group: Group) -> None:
        room = group.capacity - group.used
        if room == 0:
            full.append(group)
        elif room in open_:
            open_[room].append(group)
        else:
            open_[room] = [group]
            insort(rooms, room)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                # The bin just filled is the tightest fit again while it has room.
                each = min(room // length, n)
                bins = min(group.count, n // each)
                if bins < group.count:
                    put(Group(group.count - bins, group.capacity, group.used, group.items))
            else:
                capacity = opening(length, left - length, capacities)
                each = min(capacity // length, n)
                bins = n // each
                if any(opening(length, left - length * each * k, capacities) != capacity for k in (bins - 1, bins // 2)):
                    bins = 1  # near the end the choice may change from bin to bin
                group = Group(bins, capacity, 0)
            put(group.with_items(bins, length, each))
            n -= bins * each
            left -= bins * each * length
    groups = full + [g for room in rooms for g in open_[room]]
    plan = Plan(capacities, groups)
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    bin_ = 0
    for g in groups:
        g.capacity = next(c for c in capacities if c >= g.used)
        offset = 0
        for length, copies in g.items:
            slots.setdefault(length, []).append((g.count * copies, bin_, copies, offset, g.capacity))
            offset += length * copies
        bin_ += g.count
    for length, rows in slots.items():
        x = np.array(rows, np.int64)
        plan.last[length] = np.cumsum(x[:, 0])
        plan.first_bin[length], plan.copies[length], plan.offset[length], plan.size[length] = x[:, 1:].T
    return plan


def tokens(docs: DataFrame, most: int, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, tag, piece, n_tokens, ids) stored: each text's token ids and END, cut at ``most``.

    ``tag`` is a hash of the text: rows that share an id but not their text keep apart.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))  # one vocabulary file
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in tokenized(batches, ranks.value):
            cut = [(i, k // most, ids[k : k + most]) for i, ids in enumerate(found) for k in range(0, len(ids), most)]
            whose = pa.array([i for i, _, _ in cut], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(whose), b.column("tag").take(whose), pa.array([k for _, k, _ in cut], pa.int32()),
                    pa.array([len(x) for _, _, x in cut], pa.int32()), pa.array([x.tobytes() for _, _, x in cut], pa.binary()),
                ],
                ["doc_id", "tag", "piece", "n_tokens", "ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, tag long, piece int, n_tokens int, ids binary")
    return materialize(made, "pack-tokens", "zstd")


def place_pieces(pieces: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """``pieces`` (doc_id, tag, piece, n_tokens, ids), stored, with their bin, offset and capacity."""
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # max(capacities) rows
    plan = pack(histogram, capacities)
    salts = 1 << max(0, -(-sum(histogram.values()) // SALTED) - 1).bit_length()
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("n_tokens", "salt", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "tag", "piece")
    ranked = (
        salted.withColumn("at", F.row_number().over(order)).join(starts, ["n_tokens", "salt"])
        .select("doc_id", "piece", "n_tokens", (F.col("start") + F.col("at") - 1).alias("rank"), "ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros((3, len(n)), np.int64)
            order = np.argsort(n, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if len(at):
                    out[:, at] = plan.place(int(n[at[0]]), rank[at])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("n_tokens"), *map(pa.array, out), b.column("ids")],
                ["doc_id", "piece", "n_tokens", "bin", "offset", "capacity", "ids"],
            )

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, n_tokens int, bin long, offset long, capacity long, ids binary")


def assemble(placed: DataFrame, bins: int, parts: int) -> DataFrame:
    """One row a bin of placed pieces: (bin, capacity, n_tokens, doc_ids, pieces, offsets, tokens).

    ``tokens``: ``capacity`` little-endian 16-bit ids, PAD after the last; the lists say which
    document's piece begins at which offset.  Partitions are ranges of ``bins``.
    """
    parts = max(1, min(parts, bins))
    rows = placed.repartitionById(parts, F.floor(F.col("bin") * parts / max(1, bins)).cast("int")).sortWithinPartitions("bin", "offset")
    id_kind = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            bin_ = held.column("bin").to_numpy()
            whole = int(np.searchsorted(bin_, bin_[-1])) if len(bin_) else 0  # the last bin may go on in the next batch
            if whole:
                yield from laid(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from laid(held)

    def laid(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bin_, size = t.column("bin").to_numpy(), t.column("n_tokens").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], np.diff(bin_) != 0]))
        edge = pa.array(np.append(first, len(bin_)), pa.int32())
        capacity = t.column("capacity").to_numpy()[first]
        used = np.add.reduceat(size, first)
        ids = t.column("ids").to_pylist()
        records = [b"".join(ids[a:z]).ljust(2 * int(c), _PAD) for a, z, c in zip(first.tolist(), [*first[1:].tolist(), len(ids)], capacity.tolist(), strict=True)]
        listed = [pa.ListArray.from_arrays(edge, t.column(c).combine_chunks()) for c in ("doc_id", "piece", "offset")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bin_[first]), pa.array(capacity), pa.array(used.astype(np.int64)), *listed, pa.array(records, pa.binary())],
            ["bin", "capacity", "n_tokens", "doc_ids", "pieces", "offsets", "tokens"],
        )

    shape = f"bin long, capacity long, n_tokens long, doc_ids array<{id_kind}>, pieces array<int>, offsets array<long>, tokens binary"
    return rows.select("bin", "capacity", "n_tokens", "doc_id", "piece", "offset", "ids").mapInArrow(run, shape)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, ranks_path: str = RANKS) -> DataFrame:
    """Training sequences of all ``docs``: see :func:`assemble`.

    A document longer than the largest capacity is cut into pieces of that size and a rest;
    nothing is dropped, however long a text is.  Null and empty texts are one end mark.  Rows
    that share an id, also a null one, are packed one by one; ids may be strings.  Other
    columns are not used, so their names may clash.  An empty table gives no sequence.
    """
    pieces = tokens(docs, max(capacities), ranks_path)
    placed = materialize(place_pieces(pieces, capacities), "pack-placed", "zstd")
    discard(pieces)
    figures = placed.agg(F.max("bin").alias("last"), F.sum("n_tokens").alias("n")).first()
    return assemble(placed, (figures["last"] or 0) + 1, parts_for(docs.sparkSession, 2 * (figures["n"] or 0)))
