"""A stored vector index: items by cells around centroids, searched exactly or by a number of cells.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors) and are few (``MAX_CELLS`` at most);
every item goes to its nearest one, and a cell is a partition of the stored table.  Of each cell
the driver holds its size and its radius, the distance of its farthest item from the centroid.

A query looks into its nearest ``FIRST`` cells, and the k-th best distance found there is a
threshold.  By the triangle inequality no item of a cell is nearer to the query than the centroid's
distance less the radius, so only the other cells for which that is within the threshold are read:
the result is exact.  With ``probes`` only so many nearest cells are looked into.

Queries are not collected: they are dealt by the cells they need and meet the items of a cell in
blocks of both, so neither a cell nor a query set of any size is one task.

Vectors that are null, zero or of another width than most have no direction: they are at distance
1 from everything and lie in a cell of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..plans.deploy import ship
from .search import top_k

#: Vectors that centroids are fitted on at most, cells at most, and rounds of fitting.
SAMPLE, MAX_CELLS, ROUNDS = 20_000, 4096, 8
#: Cells that an exact search looks into before any bound is compared.
FIRST = 4
#: Items and queries that one task multiplies at once.
BLOCK_ITEMS, BLOCK_QUERIES = 8192, 2048
#: The cell of vectors without a direction.
APART = -1
#: What rounding may add to a distance.
_SLACK = 1e-6


def _units(rows: pa.Array | list, width: int) -> np.ndarray:
    """Rows of unit length; of zeros where a vector is null, zero or of another width."""
    rows = rows if isinstance(rows, list) else rows.to_pylist()
    out = np.array([x if x is not None and len(x) == width else [0.0] * width for x in rows], np.float64).reshape(len(rows), width)
    out[~np.isfinite(out).all(axis=1)] = 0
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of ``cells`` groups of the sample's rows by Lloyd's rounds, begun at rows far from each other."""
    rng = np.random.default_rng(5)
    if len(sample) <= cells:
        return sample
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(sample, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        count = np.bincount(nearest, minlength=cells)[:, None]
        centroids = np.where(count > 0, sums / np.maximum(count, 1), centroids)
    return centroids


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(square, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance."""
    where, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for k in range(0, len(x), rows):
        d = _distances(x[k : k + rows], centroids)
        where[k : k + rows] = d.argmin(axis=1)
        far[k : k + rows] = d.min(axis=1)
    return where, far


@dataclass
class Cells:
    """What the driver and every task know of an index: the ``width`` of its vectors, all
    ``centroids``, the ``numbers`` of the cells that have items, and the sizes and radii of these."""

    width: int
    centroids: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance to the centroid, least cosine distance of an item) of queries and cells."""
        near = np.full((len(q), len(self.numbers)), np.inf)
        least = np.ones_like(near)
        real = self.numbers >= 0
        if real.any():
            near[:, real] = _distances(q, self.centroids[self.numbers[real]])
            gap = np.maximum(near[:, real] - self.radius[real] - _SLACK, 0)
            least[:, real] = gap * gap / 2
        least[(q == 0).all(axis=1)] = 1.0  # everything is at distance 1 from a query without a direction
        return near, least

    def nearest(self, q: np.ndarray, n: int) -> np.ndarray:
        """Which cells are the ``n`` nearest of each query."""
        near, _ = self.reach(q)
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argsort(near, axis=1, kind="stable")[:, :n], True, axis=1)
        return out


@dataclass
class VectorIndex:
    """``items``: the stored table (id, vector, kept columns, radius, cell)."""

    items: DataFrame
    cells: Cells

    def where(self, condition) -> VectorIndex:
        """The index of fewer items, by a condition on kept columns; bounds hold for any part of a cell."""
        return VectorIndex(self.items.where(condition), self.cells)

    def _send(self, queries: DataFrame, pick) -> DataFrame:
        """(qid, vector, cell) by ``pick``: (queries, their thresholds) -> which cells."""
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    q = _units(part.column("vector"), cells.width)
                    who, cell = np.nonzero(pick(q, part.column("kth").to_numpy(zero_copy_only=False).astype(float)))
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(who)), part.column("vector").take(pa.array(who)), pa.array(cells.numbers[cell], pa.int32())], ["qid", "vector", "cell"])

        kind = queries.schema["qid"].dataType.simpleString()
        return queries.select("qid", "vector", "kth").mapInArrow(run, f"qid {kind}, vector array<double>, cell int")

    def _scan(self, sent: DataFrame, k: int) -> DataFrame:
        """(qid, id, distance): at least the k best items of each query in each cell it is sent to."""
        spark = sent.sparkSession
        asked = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS rows
        size = dict(zip(self.cells.numbers.tolist(), self.cells.sizes.tolist(), strict=True))
        cut = [(c, max(1, -(-size[c] // BLOCK_ITEMS)), max(1, -(-n // BLOCK_QUERIES))) for c, n in sorted(asked.items())]
        blocks = F.broadcast(spark.createDataFrame(cut, "cell int, parts int, turns int"))  # as many
        part, turn = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        items = self.items.where(F.col("cell").isin([c for c, _, _ in cut])).select("id", "vector", "cell").join(blocks, "cell")
        items = items.select("id", "vector", "cell", part.alias("part"), every("turns").alias("turn"))
        queries = sent.join(blocks, "cell").select("qid", "vector", "cell", turn.alias("turn"), every("parts").alias("part"))
        width = self.cells.width

        def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            qids, ids = left.column("qid").combine_chunks(), right.column("id").combine_chunks()
            q, x = _units(left.column("vector").to_pylist(), width), _units(right.column("vector").to_pylist(), width)
            who, what, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for at in range(0, len(q), 256):
                d = 1 - q[at : at + 256] @ x.T
                if d.shape[1] > k:
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero(d <= kth + 1e-11)  # ties are settled by id
                    if len(a) > 4 * k * len(d):
                        a, b = _first(d, a, b, ids, k)
                else:
                    a, b = np.nonzero(np.ones_like(d, bool))
                who.append(a + at)
                what.append(b)
                far.append(d[a, b])
            return pa.table({"qid": qids.take(pa.array(np.concatenate(who))), "id": ids.take(pa.array(np.concatenate(what))), "distance": pa.array(np.concatenate(far))})

        kinds = f"qid {sent.schema['qid'].dataType.simpleString()}, id {self.items.schema['id'].dataType.simpleString()}, distance double"
        by = ["cell", "part", "turn"]
        return queries.groupBy(*by).cogroup(items.groupBy(*by)).applyInArrow(meet, kinds)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, rank, id, score): the k nearest items of ``queries`` (qid, vector) by cosine, ties by
        id, distances compared to 12 digits; exact, or of the ``probes`` nearest cells only."""
        ship(queries.sparkSession)
        asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
        cells = self.cells
        first = min(len(cells.numbers), FIRST if probes is None else probes)
        if not first:
            return asked.sparkSession.createDataFrame([], f"qid {asked.schema['qid'].dataType.simpleString()}, rank int, id {self.items.schema['id'].dataType.simpleString()}, score double")

        def nearest(q: np.ndarray, kth: np.ndarray) -> np.ndarray:
            return cells.nearest(q, first)

        def others(q: np.ndarray, kth: np.ndarray) -> np.ndarray:
            _, least = cells.reach(q)
            return ~cells.nearest(q, first) & (least <= np.where(np.isnan(kth), np.inf, kth)[:, None] + 1e-9)

        found = self._scan(self._send(asked.withColumn("kth", F.lit(None).cast("double")), nearest), k)
        if probes is None and first < len(cells.numbers):
            kth = top_k(found, k, F.round("distance", 12), F.col("id")).where(F.col("rank") == k).select("qid", F.col("distance").alias("kth"))
            found = found.unionByName(self._scan(self._send(asked.join(kth, "qid", "left"), others), k))
        best = top_k(found, k, F.round("distance", 12), F.col("id"))
        return best.select("qid", "rank", "id", V.score(F.col("distance")).alias("score"))


def _first(d: np.ndarray, a: np.ndarray, b: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) the k best of each a, ties by id: where very many items are equally far."""
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((rank[b], d[a, b].round(12), a))
    a, b = a[order], b[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep]


def build(items: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
    """Store ``items`` (id, vector and any columns to filter by) in ``folder`` and open the index.

    The width is that of most vectors.  ``cells``: as many as the square root of the items, if not
    given; never more than ``MAX_CELLS``.  All items are stored, whatever the sample.
    """
    spark = items.sparkSession
    ship(spark)
    rows = items.withColumn("vector", F.col("vector").cast("array<double>"))
    widths = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    n, width = rows.count(), widths["w"] if widths else 1
    cells = min(MAX_CELLS, max(1, int(n**0.5)) if cells is None else cells)
    share = max(1, int(min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 30)))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("vector").limit(SAMPLE).toArrow()
    sample = _units(picked.column("vector").to_pylist(), width)
    sample = sample[(sample != 0).any(axis=1)]
    centroids = fit_centroids(sample[np.lexsort(sample.T)] if len(sample) else sample, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                x = _units(part.column("vector"), width)
                cell, far = np.full(len(x), APART), np.zeros(len(x))
                some = (x != 0).any(axis=1)
                if some.any() and len(centroids):
                    cell[some], far[some] = _nearest(x[some], centroids)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(far), pa.array(cell.astype(np.int32))], [*part.schema.names, "radius", "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(assign, f"{kinds}, radius double, cell int")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(folder)
    stored = spark.read.schema(f"{kinds}, radius double, cell int").parquet(folder)
    found = sorted((r["cell"], r["n"], r["far"]) for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("far")).collect())  # MAX_CELLS rows
    columns = [np.array([r[i] for r in found], kind) for i, kind in enumerate((np.int64, np.int64, np.float64))]
    return VectorIndex(stored, Cells(width, centroids, *columns))
