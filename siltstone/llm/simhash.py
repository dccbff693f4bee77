"""SimHash near-duplicates, found exactly with vantage-point trees over Hamming space.

Fingerprints are computed once per document in Arrow batches.  Equal fingerprints are
collapsed first, so groups of copies cost one row.  A vantage-point tree, fitted on a
bounded sample of the distinct fingerprints, cuts them into shards: at each node a
fingerprint's home is the inner side when its distance to the vantage point is at most
the node's radius, else the outer side.  By the triangle inequality two fingerprints
within ``radius`` bits have distances to the vantage point that differ by ``radius`` at
most, so only fingerprints near a boundary visit a second shard.  Each shard repeats the
same pruning in memory down to small blocks that are compared outright.  A shard returns
links that connect, never all pairs of a dense group; components are then contracted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, ship, slices, utf8_list
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that one shard is home to, about.
SHARD_ROWS = 65_536
#: Most fingerprints that the tree is fitted on; every fingerprint is searched.
TREE_SAMPLE = 65_536
_BLOCK = 1024
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words of one UTF-8 text; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        spans, n = [(0, len(joined))], 1
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        spans = list(zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True))
        n = len(spans)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        part = spans[k : k + _CHUNK]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def row_tag(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, fp): one row per row of ``docs``; null and empty texts have fingerprint 0.

    ``tag``: a hash of id and text, which tells rows with one id apart.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), row_tag(id_col, text_col).alias("tag"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t) for t in utf8_list(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tag"), pa.array(fp.view(np.int64))], ["id", "tag", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tag long, fp long")


# -- the tree -------------------------------------------------------------------


def fit_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer); a leaf is (None, shard, 0, 0)."""
    rng = np.random.default_rng(7)
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        split = None
        if want > 1 and len(points) >= 8:
            vantage = points[rng.integers(len(points))]
            d = np.bitwise_count(points ^ vantage)
            mu = int(np.median(d))
            if 0 < (d <= mu).sum() < len(points):
                split = vantage, mu, points[d <= mu], points[d > mu]
        if split is None:
            nodes[at] = (None, leaves, 0, 0)
            leaves += 1
        else:
            vantage, mu, near, far = split
            inner, outer = grow(near, want // 2), grow(far, want - want // 2)
            nodes[at] = (np.uint64(vantage), mu, inner, outer)
        return at

    grow(sample, shards)
    return nodes


def route(nodes: list[tuple], fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, fingerprints, home): each has one home, and visits where a partner may live."""
    todo = [(0, fps, True)]
    while todo:
        at, x, home = todo.pop()
        if not len(x):
            continue
        vantage, mu, inner, outer = nodes[at]
        if vantage is None:
            yield mu, x, home
            continue
        d = np.bitwise_count(x ^ vantage).astype(np.int64)
        if home:
            todo.append((inner, x[d <= mu], True))
            todo.append((outer, x[d > mu], True))
            # The pair's farther member visits the nearer one's side, so once is enough.
            todo.append((inner, x[(d > mu) & (d <= mu + radius)], False))
        else:
            todo.append((inner, x[d <= mu + radius], False))
            todo.append((outer, x[d > mu - radius], False))


# -- one shard ------------------------------------------------------------------


def _compare(a: np.ndarray, b: np.ndarray, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks; for dense blocks a set that connects the same members."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if own:
        np.fill_diagonal(near, False)
    count = int(near.sum())
    if count <= 4 * (len(a) + len(b)):
        i, j = np.nonzero(near)
        return a[i], b[j]
    la, lb = np.arange(len(a)), np.arange(len(b)) + (0 if own else len(a))
    top = len(a) + len(b)
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = na if own else np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    every = a if own else np.concatenate([a, b])
    label = la if own else np.concatenate([la, lb])
    return every[label], every


def shard_links(home: np.ndarray, visit: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``home`` and between ``home`` and ``visit`` (distinct values each)."""
    rng = np.random.default_rng(11)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def keep(u: np.ndarray, v: np.ndarray) -> None:
        ok = u != v
        us.append(u[ok])
        vs.append(v[ok])

    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(home, None)]
    if len(visit):
        todo.append((home, visit))
    while todo:
        a, b = todo.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        if b is None and len(a) <= _BLOCK:
            keep(*_compare(a, a, radius, True))
            continue
        if b is not None and len(a) * len(b) <= _BLOCK * _BLOCK:
            keep(*_compare(a, b, radius, False))
            continue
        vantage = a[rng.integers(len(a))]
        da = np.bitwise_count(a ^ vantage).astype(np.int64)
        db = da if b is None else np.bitwise_count(b ^ vantage).astype(np.int64)
        mu = int(np.median(da if b is None else np.concatenate([da, db])))
        other = a if b is None else b
        inner, outer = (da <= mu), (da > mu)
        if (inner.all() or outer.all()) and (b is None or (db <= mu).all() or (db > mu).all()):
            for k in range(0, len(a), _BLOCK):  # one narrow ball: nothing to prune
                for m in range(k if b is None else 0, len(other), _BLOCK):
                    keep(*_compare(a[k : k + _BLOCK], other[m : m + _BLOCK], radius, b is None and k == m))
            continue
        if b is None:
            todo += [(a[inner], None), (a[outer], None)]
            todo.append((a[inner & (da > mu - radius)], a[outer & (da <= mu + radius)]))
        else:
            todo += [(a[inner], b[db <= mu]), (a[outer], b[db > mu])]
            todo.append((a[inner & (da > mu - radius)], b[(db > mu) & (db <= mu + radius)]))
            todo.append((a[outer & (da <= mu + radius)], b[(db <= mu) & (db > mu - radius)]))
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


# -- distributed ----------------------------------------------------------------


def hamming_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp) distinct, non-null -> (u, v) links that connect all pairs within ``radius`` bits."""
    n = distinct.count()
    shards = max(1, -(-n // shard_rows))
    if shards > 1:
        share = min(0.25, TREE_SAMPLE / n)
        cut = int(share * (1 << 30))
        picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < cut).limit(2 * TREE_SAMPLE)
        sample = np.array(picked.toArrow().column("fp").to_numpy(), dtype=np.int64).view(np.uint64)
        nodes = fit_tree(np.sort(sample), shards)
    else:
        nodes = [(None, 0, 0, 0)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for shard, x, home in route(nodes, fps, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), shard, np.int32)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), home))],
                    ["shard", "fp", "home"],
                )

    def search(rows: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        home = rows.column("home").to_numpy(zero_copy_only=False)
        u, v = shard_links(np.unique(fps[home]), np.unique(fps[~home]), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component, tag, first): component is the smallest id that links of ``radius``
    bits reach, ``first`` says whether the row is the one that stands for its component.

    One row per row of ``docs``, other columns are not used, so clashing names are safe.
    Null and empty texts have fingerprint 0 and link like any other; rows with a null id
    get their component, which is null if no member has an id; an empty table gives none.
    Rows equal in id and text are all ``first`` or none.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag"))
    classes = materialize(prints.groupBy("fp").agg(least.alias("least")), "simhash-class")
    links = hamming_links(classes.select("fp"), radius)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = materialize(
        classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-root"
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("top")), "root").select("fp", "top")
    first = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("tag") == F.col("top.tag"))
    return prints.join(named, "fp").select("id", "fp", F.col("top.id").alias("component"), "tag", first.alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, nulls last.

    Ids may be strings or null; of rows equal in id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, radius).where("first")
    return only_rows(docs, materialize(found.select("id", "tag").distinct(), "simhash-first"), id_col, text_col)


def only_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs`` one row for each of the distinct ``wanted`` (id, tag), ids of any kind or null."""
    columns = list(docs.columns)
    tag = fresh("tag", columns)
    keyed = docs.withColumn(tag, row_tag(id_col, text_col))
    wanted = wanted.select(F.col("id").alias("wanted_id"), F.col("tag").alias("wanted_tag"))
    same = keyed[id_col].eqNullSafe(wanted["wanted_id"]) & (keyed[tag] == wanted["wanted_tag"])
    return keyed.join(wanted, same, "left_semi").dropDuplicates([id_col, tag]).select(*columns)
