"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of equal words are collapsed first.  SimHash links within a few bits, found by
vantage-point trees, propose pairs.  Most pairs of that similarity lie further apart than a tree
can search (some ten bits of 64), so shingles propose too: each text has ``BANDS`` keys, each made
of the least values of its shingles under ``ROWS`` random orders, and a pair of similarity s shares
a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8 and more above, 0.02 at 0.3.  Every
proposed pair is compared shingle by shingle, so what is linked is alike without exception.

Texts that share a key are a group, and which of them are linked is settled for every group: until
all its texts are connected or have been compared.  First, a few keys at a time, one text of each
connected part of a group is compared with one centre, which settles most groups of copies in
linear work.  Of a group that is still in several parts, all pairs of different parts are compared
if it has ``MOST`` texts or fewer.  Of a larger group with one large part all other texts are compared
with the most central one of that part.  Those that are left are told by the shingles in which they
differ from it, and two of them meet only in a rare difference that both have: so many copies of one
original do not meet in what all have from it.  Texts of other groups are cut by what they have in
common: by the shingles that are rarest among them, a fifth of each text's and one more, of which
two alike texts share one at least.  A shingle proposes a pair only where as many follow it in both as
the two must share, and texts are dealt by length first, so what is like in part only hardly meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, slices, small, temporary, utf8_list
from .components import connected_components
from .simhash import fingerprint, hamming_links, only_rows, row_tag

SHINGLE, SIMILARITY, SEED = 5, Fraction(4, 5), 43
#: Bits within which SimHash proposes pairs; shingles propose the others.
RADIUS = 3
#: Keys of a text, and least values that a key is made of.
BANDS, ROWS = 24, 6
#: Keys that are gone through at once, and texts of a group that is compared outright; larger ones are cut.
KEYS, MOST = 12, 8
#: Ratio of lengths (in shingles) of one class of lengths in a cut.
LENGTHS = 1.1
#: Bits of the bitmaps that sift proposed pairs.
BITS = 2048


def shingles(text: bytes, size: int = SHINGLE) -> set[bytes]:
    """Runs of ``size`` lower-cased (A-Z) words; the whole of a shorter text; nothing without words."""
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is at least ``SIMILARITY``; sets without shingles are equal."""
    both = len(a & b)
    return both * SIMILARITY.denominator >= SIMILARITY.numerator * (len(a) + len(b) - both)


def _hashes(text: bytes) -> np.ndarray:
    found = shingles(text)
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s, SEED) for s in found), np.uint64, len(found)).view(np.int64))


def _key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()), SEED)


_ORDERS = np.random.default_rng(11).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
#: Shingles that are put in all orders at once.
_CHUNK = 4096


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of shingles, given by its hashes; none for no shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        x = hashes[k : k + _CHUNK].view(np.uint64)[:, None] * _ORDERS[0]
        x ^= x >> np.uint64(31)
        least = np.minimum(least, (x * _ORDERS[1]).min(axis=0))
    least = (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ORDERS[0, :1]
    for r in range(ROWS):
        key = (key ^ least[:, r]) * _ORDERS[1, r]
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """For each of ``BITS`` remainders, whether an odd number of shingles has it: two bitmaps
    differ in as many bits as the sets in shingles, at most."""
    return np.packbits(np.bincount(hashes % BITS, minlength=BITS) & 1).tobytes()


def may_be_alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of bitmaps (rows of bytes) of sets of ``n`` and ``m`` shingles; false only where sets are not alike."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (differ * (q + p) <= (n + m) * (q - p)) & (np.minimum(n, m) * q >= np.maximum(n, m) * p)


def _verified(pairs: DataFrame, texts: DataFrame, printed: DataFrame) -> DataFrame:
    """(u, v) of the proposed pairs that are alike.  Only texts of pairs whose bitmaps allow it are read."""
    sides = [printed.select(F.col("key").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}")) for x in "uv"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(f"bits_{x}").to_pylist()), np.uint8).reshape(b.num_rows, -1) for x in "uv")
                ok = pa.array(may_be_alike(a, c, *(b.column(f"n_{x}").to_numpy().astype(np.int64) for x in "uv")))
                yield pa.RecordBatch.from_arrays([b.column(x).filter(ok) for x in "uv"], ["u", "v"])

    both = pairs.distinct().join(sides[0], "u").join(sides[1], "v").select("bits_u", "n_u", "bits_v", "n_v", "u", "v")
    pairs = materialize(both.mapInArrow(sift, "u long, v long"), "copies-pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    texts = materialize(texts.join(ends, "key", "left_semi"), "copies-few")
    left = texts.select(F.col("key").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("key").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in slices(batches):
            ok = []
            for u, s, t in zip(b.column("u").to_pylist(), utf8_list(b.column("a")), utf8_list(b.column("b")), strict=True):
                if u != last:
                    last, held = u, shingles(s)
                ok.append(alike(held, shingles(t)))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return materialize(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "copies-links")


def copy_links(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, text) of distinct long keys -> (u, v) links that connect texts that are alike."""
    return linked(texts, radius)[0]


def linked(texts: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """The links of :func:`copy_links`, and (key, root) of every text: the least key that they reach."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8_list(b.column("text"))
            fp = np.fromiter((fingerprint(t, SHINGLE) for t in texts), np.uint64, b.num_rows)
            sets = [_hashes(t) for t in texts]
            columns = [pa.array(fp.view(np.int64)), pa.array([len(h) for h in sets], pa.int32()), pa.array([bitmap(h) for h in sets], pa.binary())]
            bands = pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), *columns, bands], ["key", "fp", "n", "bits", "bands"])

    ship(texts.sparkSession)
    printed = materialize(texts.mapInArrow(prints, "key long, fp long, n int, bits binary, bands array<long>"), "copies-fp")
    least = materialize(printed.groupBy("fp").agg(F.min("key").alias("key")), "copies-class")
    links = hamming_links(least.select("fp"), radius)
    ends = [least.select(F.col("fp").alias(x), F.col("key").alias(f"key_{x}")) for x in "uv"]
    near = links.join(ends[0], "u").join(ends[1], "v").select(F.col("key_u").alias("a"), F.col("key_v").alias("b"))
    same = printed.join(least.withColumnRenamed("key", "a"), "fp").select("a", F.col("key").alias("b"))
    compare = lambda pairs: _verified(_ordered(pairs), texts, printed)

    found = compare(near.unionByName(same))
    roots = _merged(printed.select("key", F.col("key").alias("root")), found)
    for at in range(0, BANDS, KEYS):
        keyed = printed.join(roots, "key").select("root", "key", F.explode(F.slice("bands", at + 1, KEYS)).alias("h"))
        parts = materialize(keyed.groupBy("h", "root").agg(F.min("key").alias("key")), "copies-parts")
        centres = parts.groupBy("h").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1")
        more = compare(parts.join(centres, "h").select("a", F.col("key").alias("b")))
        found, roots = found.unionByName(more), _merged(roots, more)
    groups = printed.select("key", F.explode("bands").alias("h"))
    return _settled(groups, found, roots, compare, texts)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (key, root) of all texts once ``links`` (u, v) are made."""
    if links.isEmpty():
        return roots
    ends = [roots.select(F.col("key").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
    apart = links.join(ends[0], "u").join(ends[1], "v").where("root_u <> root_v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    joined = connected_components(materialize(apart.distinct(), "copies-apart")).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return materialize(roots.join(joined, "root", "left").select("key", F.coalesce("to", "root").alias("root")), "copies-roots")


def _settled(groups: DataFrame, found: DataFrame, roots: DataFrame, compare: Callable[[DataFrame], DataFrame], texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` and ``roots`` with the links that are missing until each two texts of a group of ``groups``
    (h, key) are connected or have been compared, or cannot be alike by their lengths and rarest shingles."""
    rooted = _open(groups, roots)
    if rooted.isEmpty():
        return found, roots
    few, many = (rooted.where(F.col("n") <= MOST), rooted.where(F.col("n") > MOST))
    ends = [few.select("h", F.col("key").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    pairs = ends[0].join(ends[1], "h").where("a < b AND root_a <> root_b").select("a", "b")
    centres = _centres(many, texts)
    to_centres = many.join(centres.join(roots.select(F.col("key").alias("c"), F.col("root").alias("most")), "c"), "h")
    more = compare(pairs.unionByName(to_centres.where("root <> most").select(F.col("c").alias("a"), F.col("key").alias("b"))))
    found, roots = found.unionByName(more), _merged(roots, more)
    many = _open(many.select("h", "key"), roots)
    if many.isEmpty():
        return found, roots
    near, loose = many.join(centres, "h").select("c", "key").distinct(), many.join(centres, "h", "left_anti")
    pairs = _about(materialize(near, "copies-near"), texts, roots)
    if not loose.isEmpty():
        pairs = pairs.unionByName(_met(_cut(loose, texts), roots))
    more = compare(pairs)
    return found.unionByName(more), _merged(roots, more)


def _open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, key, root, n) of the groups of ``groups`` (h, key) that are in several parts; ``n``: texts of the group."""
    rooted = groups.join(roots, "key").select("h", "key", "root")
    apart = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    return materialize(rooted.join(apart, "h"), "copies-groups")


def _sets(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, e) of the texts of ``keys`` (key): the hashes of all shingles of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([_hashes(t) for t in utf8_list(b.column("text"))], pa.list_(pa.int64()))], ["key", "e"])

    return texts.join(keys.distinct(), "key", "left_semi").select("key", "text").mapInArrow(run, "key long, e array<long>")


def _centres(rooted: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, c) of the groups of ``rooted`` (h, key, root) of which one part has more than ``MOST`` texts:
    that text of the largest part whose shingles are most common in such parts."""
    sizes = rooted.groupBy("h", "root").agg(F.count("*").alias("rows")).groupBy("h").agg(F.max(F.struct("rows", "root")).alias("most"))
    inner = rooted.join(sizes.where(F.col("most.rows") > MOST).select("h", F.col("most.root").alias("root")), ["h", "root"]).select("h", "key")
    inner = materialize(inner, "copies-inner")
    rows = materialize(_sets(inner.select("key"), texts).select("key", F.explode("e").alias("e")), "copies-shingles")
    often = rows.groupBy("e").agg(F.count("*").alias("df"))
    core = rows.join(often, "e").groupBy("key").agg((F.sum("df") / F.count("*")).alias("core"))
    best = inner.join(core, "key").groupBy("h").agg(F.max(F.struct("core", "key")).alias("best"))
    return materialize(best.select("h", F.col("best.key").alias("c")), "copies-centres")


def _about(near: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of texts of different roots that have a ``c`` of ``near`` (c, key) in common; all that are alike are
    among them, if every text that is like its ``c`` has the root of it.  Every ``c`` is among the keys, too.

    Sets of n and m shingles are alike if no more than (n + m) * (q - p) / (q + p) are in one only (p / q: ``SIMILARITY``).
    A set is told by the shingles in which it differs from ``c``, v and w of them: then as many are in one only as in one
    of these differences only, so alike ones share (v + w - (n + m) * (q - p) / (q + p)) / 2 differences.  If that is
    nothing, both are like ``c``.  Else they meet in the first difference that they share, by an order from the rarest on,
    if it leaves enough in both.  What all have from one original is no difference, so it brings nobody together."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            sets, about = ([np.asarray(x, np.int64) for x in b.column(name).to_pylist()] for name in ("e", "of_c"))
            differ = pa.array([np.setxor1d(x, y, assume_unique=True) for x, y in zip(sets, about, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("key"), pa.array([len(x) for x in sets], pa.int32()), differ], ["c", "key", "n", "e"])

    sets = materialize(_sets(near.select("key"), texts), "copies-sets")
    centres = materialize(sets.join(near.select(F.col("c").alias("key")).distinct(), "key").select(F.col("key").alias("c"), F.col("e").alias("of_c")), "copies-of")
    differ = near.join(sets, "key").join(small(centres), "c").select("c", "key", "e", "of_c").mapInArrow(run, "c long, key long, n int, e array<long>")
    rows = materialize(differ.select("c", "key", "n", F.size("e").alias("w"), F.explode("e").alias("e")), "copies-differ")
    often = rows.groupBy("c", "e").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("c", "key").orderBy("df", "e"))
    rows = rows.join(often, ["c", "e"]).withColumn("place", place).where((F.col("df") > 1) & ((F.col("place") - 1) * p <= F.col("n") * (q - p)))
    inner = roots.select(F.col("key").alias("c"), F.col("root").alias("most"))
    rows = rows.join(roots, "key").join(inner, "c").select("c", "e", "key", "root", "n", "w", (F.col("w") - F.col("place") + 1).alias("left"), (F.col("root") == F.col("most")).alias("of_most"))
    rows = materialize(rows, "copies-about")
    side = lambda x: [F.col(y).alias(f"{y}_{x}") for y in ("root", "n", "w", "left")] + [F.col("key").alias(x)]
    # The one of more differences visits the other, which has its place among the first n / 8; texts of the root of c do not visit each other.
    home = rows.where((F.col("w") - F.col("left")) * (2 * p) <= F.col("n") * (q - p)).select("c", "e", "of_most", *side("b"))
    sides = F.when(F.col("of_most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    visits = rows.select("c", "e", F.explode(sides).alias("of_most"), *side("a"))
    fewer = (F.col("w_b") < F.col("w_a")) | ((F.col("w_b") == F.col("w_a")) & (F.col("b") < F.col("a")))
    lengths = F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p
    enough = F.least("left_a", "left_b") * (2 * (q + p)) >= (F.col("w_a") + F.col("w_b")) * (q + p) - (F.col("n_a") + F.col("n_b")) * (q - p)
    return visits.join(home, ["c", "e", "of_most"]).where((F.col("root_a") != F.col("root_b")) & fewer & lengths & enough).select("a", "b")


def _cut(rooted: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, key, n, place): in place of the groups of ``rooted`` (h, key), groups of the texts that have one of
    their rarest shingles in common; a text has ``n``, and the one of the group is its ``place``-th by rarity.  Of n shingles of a text at most a fifth are missing in one alike,
    so by any order that both share, each has one of the other's among its first n / 5 and one.
    One order serves all groups, so a text has its rarest shingles once, however many groups it is in."""
    held = _sets(rooted.select("key"), texts)
    rows = materialize(held.select("key", F.size("e").alias("n"), F.explode("e").alias("e")), "copies-shingles")
    often = rows.groupBy("e").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("df", "e"))
    ratio = SIMILARITY.denominator - SIMILARITY.numerator, SIMILARITY.denominator
    first = rows.join(often, "e").withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * ratio[0] / ratio[1]) + 1)
    return materialize(first.where("df > 1").select(F.col("e").alias("h"), "key", "n", "place"), "copies-cut")


def _met(cut: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of texts of different roots in one group of ``cut`` (h, key, n, place); all that are alike are among them.

    Sets of n and m shingles are alike if they share (n + m) * p / (q + p) of them (p / q: ``SIMILARITY``).
    The first one that they share leaves n - place in the one and m - place in the other, so
    a text of n has partners up to a certain m there; those not longer than itself it visits, by
    classes of lengths.  Texts of the largest root of a class do not visit each other."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    length = lambda n: F.floor(F.log(LENGTHS, n)).cast("int")
    rows = cut.join(roots, "key").withColumn("left", (F.col("n") - F.col("place") + 1) * (q + p))
    home = rows.where(F.col("left") >= F.col("n") * (2 * p)).withColumn("class", length(F.col("n")))
    home = materialize(home.select("h", "class", "key", "root", "n", "left"), "copies-home")
    most = home.groupBy("h", "class", "root").agg(F.count("*").alias("rows")).groupBy("h", "class").agg(F.max(F.struct("rows", "root")).alias("most"))
    most = most.select("h", "class", F.col("most.root").alias("most"))
    lo = F.ceil(F.col("n") * p / q)
    hi = F.least(F.col("n").cast("long"), F.floor((F.col("left") - F.col("n") * p) / p))
    visits = rows.where(lo <= hi).withColumn("class", F.explode(F.sequence(length(lo), length(hi)))).join(most, ["h", "class"])
    sides = F.when(F.col("root") == F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    visits = visits.select("h", "class", F.explode(sides).alias("of_most"), F.col("key").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    home = home.join(most, ["h", "class"]).withColumn("of_most", F.col("root") == F.col("most"))
    home = home.select("h", "class", "of_most", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    shorter = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    enough = F.least("left_a", "left_b", F.col("n_b") * (q + p)) >= (F.col("n_a") + F.col("n_b")) * p
    return visits.join(home, ["h", "class", "of_most"]).where((F.col("root_a") != F.col("root_b")) & shorter & enough).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links of near copies connect: that of the
    smallest id, nulls last.

    Texts without words, null ones too, are one group; of rows equal in id and text one stays.
    Ids may be strings or null; other columns are kept, whatever their names.  Texts are
    compared whole, however long.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), row_tag(id_col, text_col).alias("tag"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            key = pa.array([_key(t) for t in utf8_list(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tag"), key, b.column("text")], ["id", "tag", "key", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.mapInArrow(run, f"id {kind}, tag long, key binary, text string")
    best = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    with temporary() as stays:
        classes = keyed.groupBy("key").agg(F.min(best).alias("least"), F.min_by("text", best).alias("text"))
        classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()), "copies-texts")  # short keys; stored, so they stay
        _, roots = linked(classes.select("key", "text"))
        rooted = classes.select("key", "least").join(roots, "key").select("least", "root")
        tops = rooted.groupBy("root").agg(F.min("least").alias("top"))
        firsts = stays(materialize(tops.select("top.id", "top.tag").distinct(), "copies-first"))
    return only_rows(docs, firsts, id_col, text_col)
