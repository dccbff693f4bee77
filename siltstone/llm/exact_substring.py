"""Exact repeated-substring removal by prefix-free parsing.

A byte goes if it lies in a ``length``-byte string that also starts anywhere else in the
corpus.  The corpus is parsed once: a rolling hash of every ``GRAM`` bytes is taken, and
where it is least among ``WINDOW`` neighbouring positions it triggers a phrase boundary.
Whether a boundary is set depends only on nearby bytes, so equal text is cut alike
wherever it stands, and a boundary follows every position within ``WINDOW`` bytes, which
bounds phrases even in periodic text.

For a boundary b the *phrase* is the stretch of window starts whose next boundary is b,
together with the rest of their windows.  Three rounds settle every window start:

1. the *parse*: each boundary's name (hash of the ``CORE`` bytes after it) and phrase name
   go to one bucket in packed blocks.  A boundary whose name is unique has no repeated
   window.  A phrase that occurs twice is repeated as a whole: the parse is grouped by 64-bit
   names and not sorted as a suffix array, since no repeat needs more than two phrases of it.
2. the *dictionary*: phrases that occur once but share their boundary's name with another
   go, once each, with one copy of each repeated phrase of that name, to a bucket.  There
   the suffix array of what follows the boundaries, and that of the reversed stretches
   before them, are sorted with their common-prefix lengths.  A window with i bytes before
   its boundary is its rank class at depth i in the one and at depth ``length`` - i in the
   other; windows of equal class pairs are adjacent in corpus order and equal.
3. spans are joined back to their documents, merged and cut out.

Hot text: a sample of documents names the boundaries and phrases that are frequent.  It is
only about where they go: phrases of a frequent boundary are dealt by phrase, occurrences of a
frequent phrase by document, over the more buckets the more frequent it is; both are known to
be repeated.  In the dictionary, phrases of a boundary that is frequent or has very many of them
are dealt by ``STEP`` starts at a time, under the name of the bytes that all windows of these
starts share, ``length`` - ``STEP`` + 1 of them, instead of ``CORE``.  Groups never expand into
pairs, and the number of buckets follows the bytes of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, fresh, materialize, parts_for, ship, slices, text_bytes, utf8_list

LENGTH = 200
GRAM, WINDOW, CORE = 16, 128, 64
#: Bytes of text that numpy handles at once.
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(77).integers(2**32, 2**63, 16, dtype=np.uint64)]
ANCHOR = np.dtype([("name", "<u8"), ("phrase", "<u8"), ("check", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("hot", "u1")])
#: Different phrases of one boundary name beyond which they are dealt by ``STEP`` starts.
WIDE, STEP = 4096, 16
#: Bytes of text for one bucket.
BUCKET = 16 << 20
#: Documents in which frequent names are looked for, about, and appearances that make one frequent.
HOT_SAMPLE, HOT_COUNT = 8192, 8


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _grow(h: np.ndarray, k: int) -> np.ndarray:
    """Names of 2**(k+1)-byte strings from those of 2**k bytes."""
    step = 1 << k
    out = h[: len(h) - step] * _ODD[k]
    out += h[step:]
    out ^= out >> np.uint64(32)
    return out


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, first start, last start, boundary name) of one text.

    Starts p run over all windows p .. p + length that fit; each belongs to the boundary
    with the least hash among the WINDOW grams from p on (the last of equals).
    """
    found: list[tuple[np.ndarray, ...]] = []
    starts = len(text) - length + 1
    for begin in range(0, max(0, starts), PIECE):
        n = min(PIECE, starts - begin)
        data = np.frombuffer(text, np.uint8, count=n + length - 1, offset=begin)
        h = _TABLE[data]
        for k in range(4):
            h = _grow(h, k)
        low = np.uint64((1 << 22) - 1)
        best = (_stir(h) & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        size = 1
        while size < WINDOW:  # WINDOW is a power of two
            best = np.minimum(best[: len(best) - size], best[size:])
            size *= 2
        best = (low - (best[:n] & low)).astype(np.int64)
        for k in range(4, 6):
            h = _grow(h, k)
        edge = np.flatnonzero(np.diff(best)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [n]]) - 1
        at = best[first]
        found.append((at + begin, first + begin, last + begin, _stir(h[at])))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _blocks(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(rows, cut)
    heads = bucket[np.concatenate([[0], cut])] if len(rows) else bucket
    return pa.RecordBatch.from_arrays(
        [pa.array(heads, pa.int32()), pa.array([x.tobytes() for x in parts] if len(rows) else [], pa.binary())],
        ["bucket", "block"],
    )


def _rows(text: bytes, k1: int, k2: int, length: int) -> np.ndarray:
    at, lo, hi, name = anchors(text, length)
    rows = np.zeros(len(at), ANCHOR)
    digest = hashlib.blake2b
    phrases = b"".join([digest(text[a:z], digest_size=16).digest() for a, z in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
    rows["phrase"], rows["check"] = np.frombuffer(phrases, "<u8").reshape(-1, 2).T
    rows["name"], rows["k1"], rows["k2"] = name, k1, k2
    rows["at"], rows["lo"], rows["hi"] = at, at - lo, at - hi
    return rows


#: Frequent names, frequent phrases, the other halves of their digests and over how many buckets
#: each phrase goes.
Hot = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def frequent(docs: DataFrame, n_docs: int, length: int = LENGTH) -> Hot:
    """Frequent names and phrases, sorted.

    All of them occur twice at least.  What is missing here costs balance, never a repeat.
    """
    cut = max(1, int(min(1.0, HOT_SAMPLE / max(1, n_docs)) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for text, k1, k2 in zip(utf8_list(b.column("text")), b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True):
                rows = _rows(text, k1, k2, length)
                both = np.concatenate([rows["name"], rows["phrase"]]).view(np.int64)
                check = np.concatenate([np.zeros(len(rows), np.uint64), rows["check"]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(check), pa.array(np.repeat([False, True], len(rows)))], ["h", "c", "phrase"])

    sampled = docs.where(F.pmod("k1", F.lit(1 << 30)) < cut).mapInArrow(run, "h long, c long, phrase boolean")
    found = sampled.groupBy("h", "c", "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_COUNT).toArrow()  # the sample's anchors / HOT_COUNT
    h, c = (found[x].to_numpy().astype(np.int64).view(np.uint64) for x in "hc")
    n, phrase = found["n"].to_numpy(), found["phrase"].to_numpy()
    phrases, order = h[phrase], np.argsort(h[phrase])
    return np.sort(h[~phrase]), phrases[order], c[phrase][order], (n[phrase][order] // HOT_COUNT).astype(np.uint64)


def _among(x: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``x`` is in the sorted ``listed``, and where."""
    if not len(listed):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(listed, x), len(listed) - 1)
    return listed[at] == x, at


def deal(rows: np.ndarray, hot: Hot, buckets: int) -> np.ndarray:
    """The bucket of each boundary; marks ``hot`` of it: 1 by name, 2 by phrase."""
    names, phrases, checks, spread = hot
    to = rows["name"].copy()
    by_name, _ = _among(rows["name"], names)
    to[by_name] = _stir(rows["name"][by_name] ^ rows["phrase"][by_name] * _ODD[5])
    by_phrase, at = _among(rows["phrase"], phrases)
    by_phrase &= by_name
    if by_phrase.any():
        by_phrase &= checks[at] == rows["check"]
        own = rows[by_phrase]
        salt = _stir(own["k1"].view(np.uint64) + own["at"].astype(np.uint64) * _ODD[6]) % np.maximum(spread[at[by_phrase]], np.uint64(1))
        to[by_phrase] = _stir(to[by_phrase] + salt * _ODD[7])
    rows["hot"] = by_name + by_phrase.astype(np.uint8)
    return _bucket(to, buckets)


def parse(docs: DataFrame, buckets: int, hot: Hot, length: int = LENGTH, flush: int = 1 << 19) -> DataFrame:
    """(bucket, block) of packed boundaries of (k1, k2, text) rows."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        return _blocks(rows, deal(rows, hot, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for b in slices(batches):
            for text, k1, k2 in zip(utf8_list(b.column("text")), b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True):
                held.append(_rows(text, k1, k2, length))
                count += len(held[-1])
                if count >= flush:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    return docs.mapInArrow(run, "bucket int, block binary")


_FULL, _SHIP, _BOTH = 0, 1, 2
_FLAGGED = "k1 long, k2 long, at long, lo int, hi int, kind int, wide boolean"


def repeated_names(blocks: DataFrame, parts: int, wide: int = WIDE) -> DataFrame:
    """Boundaries whose name is repeated: k1, k2, at, lo, hi, kind and wide.

    kind 0: the phrase is repeated as a whole; 1: it occurs once, look closer; 2: as 0, and
    this occurrence stands for its phrase where others of its name occur once.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a = np.concatenate([np.frombuffer(x, ANCHOR) for x in rows.column("block").to_pylist()])
        a = a[np.argsort(a["name"], kind="stable")]
        new = np.concatenate([[True], a["name"][1:] != a["name"][:-1]])
        count = np.diff(np.append(np.flatnonzero(new), len(a)))
        a = a[np.repeat(count > 1, count) | (a["hot"] > 0)]
        if len(a):
            a = a[np.lexsort((a["at"], a["k2"], a["k1"], a["check"], a["phrase"], a["name"]))]
            group = np.concatenate([[True], a["name"][1:] != a["name"][:-1]])
            sub = group | np.concatenate([[True], (a["phrase"][1:] != a["phrase"][:-1]) | (a["check"][1:] != a["check"][:-1])])
            size = np.diff(np.append(np.flatnonzero(sub), len(a)))
            once = np.repeat(size == 1, size) & (a["hot"] < 2)
            which = np.cumsum(group) - 1
            mixed = (np.bincount(which, once) > 0)[which] | (a["hot"] > 0)
            kind = np.where(once, _SHIP, np.where(mixed & sub, _BOTH, _FULL))
            many = (np.bincount(which, sub)[which] > wide) | (a["hot"] > 0)
        else:
            kind, many = np.zeros(0, np.int64), np.zeros(0, bool)
        return pa.table({
            "k1": pa.array(a["k1"], pa.int64()), "k2": pa.array(a["k2"], pa.int64()), "at": pa.array(a["at"], pa.int64()),
            "lo": pa.array(a["lo"], pa.int32()), "hi": pa.array(a["hi"], pa.int32()), "kind": pa.array(kind, pa.int32()), "wide": pa.array(many),
        })

    return blocks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, _FLAGGED)


def dictionary(rows: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(k1, k2, text, marks) -> the flagged phrases' bytes, dealt by what their windows share.

    ``lo`` bytes of a phrase stand before its boundary.
    """

    def entries(text: bytes, m: dict) -> Iterator[tuple]:
        at, lo, hi = m["at"], m["lo"], m["hi"]
        if not m["wide"]:
            yield hashlib.blake2b(text[at : at + CORE], digest_size=8).digest(), lo, hi
            return
        for a in range(hi // STEP * STEP, lo + 1, STEP):
            shared = text[at - a : at + length - (a + STEP - 1)]
            name = hashlib.blake2b(shared, digest_size=8, person=a.to_bytes(2, "little")).digest()
            yield name, min(lo, a + STEP - 1), max(hi, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            marks = b.column("marks").to_pylist()
            for text, k1, k2, found in zip(utf8_list(b.column("text")), b.column("k1").to_pylist(), b.column("k2").to_pylist(), marks, strict=True):
                for m in found:
                    at = m["at"]
                    out += [(name, k1, k2, at, lo, hi, text[at - lo : at - hi + length]) for name, lo, hi in entries(text, m)]
                    if len(out) >= 4096:
                        yield _dealt(out, buckets)
                        out = []
            if out:
                yield _dealt(out, buckets)

    return rows.mapInArrow(run, "bucket int, name long, k1 long, k2 long, at long, lo int, hi int, body binary")


def _dealt(out: list[tuple], buckets: int) -> pa.RecordBatch:
    name = np.frombuffer(b"".join(x[0] for x in out), "<u8")
    columns = [pa.array(_bucket(name, buckets), pa.int32()), pa.array(name.view(np.int64))]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns += [pa.array([x[i + 1] for x in out], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "name", "k1", "k2", "at", "lo", "hi", "body"])


def suffix_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-array order of the strings and each one's common prefix with the one before."""
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__), np.int64)
    wide = max(map(len, parts), default=0) or 1
    common = np.zeros(len(parts), np.int64)
    step = max(1, (8 << 20) // wide)
    for k in range(1, len(parts), step):
        block = [parts[i] for i in order[k - 1 : k + step]]
        size = np.array([len(x) for x in block])
        grid = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in block), np.uint8).reshape(-1, wide)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        common[k : k + step] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return order, common


def repeated_windows(bodies: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bytes before its boundary) of every window of ``bodies`` that occurs twice.

    Entry e covers the windows with hi[e] .. lo[e] bytes before the boundary, whose
    offset in the body is lo[e].
    """
    n = len(bodies)
    after, common_after = suffix_order([x[k : k + length] for x, k in zip(bodies, lo.tolist(), strict=True)])
    before, common_before = suffix_order([x[:k][::-1] for x, k in zip(bodies, lo.tolist(), strict=True)])
    who: list[np.ndarray] = []
    where: list[np.ndarray] = []
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(int(hi.min(initial=0)), int(lo.max(initial=-1)) + 1):
        able = np.flatnonzero((hi <= i) & (lo >= i))
        if len(able) < 2:
            continue
        left[before] = np.cumsum(common_before < i)
        right[after] = np.cumsum(common_after < length - i)
        pair = left[able] * (n + 1) + right[able]
        order = np.argsort(pair, kind="stable")
        same = np.diff(pair[order]) == 0
        hit = np.zeros(len(able), bool)
        hit[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        who.append(able[hit])
        where.append(np.full(int(hit.sum()), i))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(where)


def settle(entries: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Start spans (first and last start, both repeated with all between) of the dictionary."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("name")
        lo, hi = rows.column("lo").to_numpy().astype(np.int64), rows.column("hi").to_numpy().astype(np.int64)
        at = rows.column("at").to_numpy()
        name = rows.column("name").to_numpy()
        bodies = rows.column("body").to_pylist()
        cut = np.flatnonzero(np.diff(name)) + 1
        edges = [0, *[int(c) for c in cut], len(bodies)]
        who, first, last = [], [], []
        begin = 0
        while begin < len(edges) - 1:  # whole names, some thousands of entries at once
            stop = begin + 1
            while stop < len(edges) - 1 and edges[stop + 1] - edges[begin] <= 20_000:
                stop += 1
            a, b = edges[begin], edges[stop]
            entry, i = repeated_windows(bodies[a:b], lo[a:b], hi[a:b], length)
            if len(entry):
                start = at[a:b][entry] - i
                order = np.lexsort((start, entry))
                entry, start = entry[order], start[order]
                new = np.concatenate([[True], (np.diff(entry) != 0) | (np.diff(start) != 1)])
                who.append(a + entry[new])
                first.append(start[new])
                last.append(start[np.append(np.flatnonzero(new)[1:], len(start)) - 1])
            begin = stop
        pick = np.concatenate(who) if who else np.zeros(0, np.int64)
        return pa.table({
            "k1": rows.column("k1").take(pa.array(pick)), "k2": rows.column("k2").take(pa.array(pick)),
            "first": pa.array(np.concatenate(first) if first else pick, pa.int64()), "last": pa.array(np.concatenate(last) if last else pick, pa.int64()),
        }).cast(pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    return entries.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "k1 long, k2 long, first long, last long")


def _merge(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs as half-open byte spans."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["last"] + length) for s in spans or ()):
        if out and first <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((first, end))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """(k1, k2, spans): start spans of repeated strings for every text that has some.

    ``k1`` and ``k2`` are 128 bits of hash of id and text, of any kind and also null, so rows
    that share an id but not their text keep apart; rows equal in both share their spans, and
    each counts as an occurrence.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(*_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = text_bytes(docs, text_col)
    parts = parts_for(spark, size, BUCKET)
    buckets = 2 * parts
    hot = frequent(keyed, docs.count(), length)
    flagged = materialize(repeated_names(parse(keyed, buckets, hot, length), parts, wide), "pfp-names")
    marks = flagged.where(F.col("kind") != _FULL).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "lo", "hi", "wide")).alias("marks"))
    near = materialize(settle(dictionary(keyed.join(marks, ["k1", "k2"]), buckets, length), parts, length), "pfp-dict")
    whole = flagged.where(F.col("kind") != _SHIP).select("k1", "k2", (F.col("at") - F.col("lo")).alias("first"), (F.col("at") - F.col("hi")).alias("last"))
    spans = whole.unionByName(near).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = materialize(spans, "pfp-spans")
    discard(flagged, near)
    return spans


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits of a row's id and text; a null id differs from every id."""
    i, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(i, text).alias("k1"), F.xxhash64(text, i, i.isNull()).alias("k2")


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, keep: list[str], fields: str, one: Callable[[bytes, list[tuple[int, int]]], tuple]) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, length)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), *_key(id_col, text_col), text.alias("text"))
    joined = rows.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")
    names = [x.split()[0] for x in fields.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [arrow[x.split()[1]] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [one(t, _merge(s, length)) for t, s in zip(utf8_list(b.column("text")), b.column("spans").to_pylist(), strict=True)]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], ["row", *names])

    shape = StructType([joined.schema["row"], *StructType.fromDDL(fields).fields])
    return joined.mapInArrow(run, shape).select(*[F.col("row").getField(c).alias(c) for c in keep], *names)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id column, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Ids may be null, repeated or strings: each row is judged by itself, and rows that repeat
    remove each other's text whole.  A null text is an empty one; texts are read whole,
    however long.  Other columns are not used, so their names may clash.  An empty table gives
    no rows.
    """

    def one(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        removed = sum(b - a for a, b in spans)
        return len(text), removed, len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _apply(docs, id_col, text_col, length, [id_col], fields, one)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the text that is left; characters cut in two are dropped whole.

    A null text stays null.  The other columns are kept as they are, whatever their names.
    Ids and repeated rows are taken as in :func:`report`; an empty table gives no rows.
    """
    keep = list(docs.columns)

    def one(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return (_kept(text, spans).decode("utf-8", "ignore"),)

    name = fresh("left", keep)
    found = _apply(docs, id_col, text_col, length, keep, f"{name} string", one)
    left = F.when(F.col(text_col).isNotNull(), F.col(name)).alias(text_col)
    return found.select(*[left if c == text_col else F.col(c) for c in keep])


#: The same report from the hashes of all windows, which are built up by doubling.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x1 AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS k1, length(h) // 2 AS n FROM d),
LADDER
w AS (SELECT doc_id, p, hash(k128, q64, q8) AS k
      FROM (SELECT doc_id, p, n, k128, lead(k64, 128) OVER z AS q64, lead(k8, 192) OVER z AS q8 FROM x128 WINDOW z AS (PARTITION BY doc_id ORDER BY p)) WHERE p <= n - 200),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE k IN (SELECT k FROM r)),
g AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
e AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s
  UNION ALL SELECT doc_id, coalesce(max(b), 0), max(length(h) // 2) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace("LADDER", "\n".join(
    f"x{2 * k} AS (SELECT *, hash(k{k}, lead(k{k}, {k}) OVER (PARTITION BY doc_id ORDER BY p)) AS k{2 * k} FROM x{k})," for k in (1, 2, 4, 8, 16, 32, 64)
))
