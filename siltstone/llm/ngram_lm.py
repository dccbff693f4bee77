"""Interpolated modified Kneser-Ney bigram model over a corpus, and its scores.

Counting: tasks hash words to 64 bits and send, for every bucket of bigram keys, one packed
block of the distinct bigrams they saw with their counts.  A bucket sums its blocks and
writes one *sorted hash array* (key, count); what it knows of the two words goes on to a
bucket of word hashes, which writes sorted arrays of the words' statistics.  A bigram's key
starts with bits that depend on its first word and on a part of the second word's hash space,
an eighth of it, or a 256th where a sample shows the first word to be common.  So buckets are
key ranges, the arrays together are sorted as a whole, and a common word is spread over many
buckets.  Their number follows the bytes of the input.

Scoring: each worker maps the arrays into memory read-only from the shared folder and looks up
the distinct words and bigrams of a batch of documents.  Nothing is shuffled, and pages that no
text needs are not read.  Where the folder is no mounted path, ranges of keys are read from the
store as they are asked for, a bounded amount at a time, and no local copy is made.

Words and bigrams are known by 64-bit hashes; two that share one would count as one, which at
10^9 different bigrams is expected for less than one in 10^10.  Counts that a result carries
(tokens, known tokens) rest on the words' hashes.

With c the count of a bigram v w, D1, D2, D3 the discounts for counts 1, 2 and more, and
N1(v), N2(v), N3(v) the numbers of words that follow v so often:
    p(w | v) = max(c - D, 0) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) / c(v) * p(w)
where p(w) is discounted likewise over the numbers of different words before w and
interpolated with the uniform distribution over the vocabulary and one unknown word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, local_form, parts_for, shared_path, ship, slices, text_bytes, utf8_list

SEED = 1
#: Hashes of the marks before the first and after the last word; no word has white space.
START = np.uint64(xxhash.xxh64_intdigest(b"<s> ", SEED))
END = np.uint64(xxhash.xxh64_intdigest(b"</s> ", SEED))
#: Tokens of one counting block, and of one scoring batch.
BLOCK_TOKENS, BATCH_TOKENS = 4 << 20, 1 << 20
#: Counts from here on are kept in arrays of their own, the others in one byte.
LARGE = 255
#: Bytes of text for one bucket, and for one task of counting.
BUCKET, TASK = 4 << 20, 16 << 20
#: Texts in which common first words are looked for, about, and the share that makes one common.
HOT_SAMPLE, HOT_SHARE = 2000, 0.0005
#: Groups in which the figures of bigrams are summed before they are summed as a whole.
FIGURE_GROUPS = 64
#: Files that a worker maps at once, and bytes that it holds where files cannot be mapped.
MAPPED, HELD = 8192, 256 << 20
PAIR = np.dtype([("v", "<u8"), ("w", "<u8"), ("n", "<u4")])
PART = np.dtype([("word", "<u8"), ("n", "<i8"), ("f1", "<u4"), ("f2", "<u4"), ("f3", "<u4"), ("before", "<u4")])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words (lower-cased A-Z, split at ASCII white space), then END."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    out[-1] = END
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def bigram_key(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """24 bits of v and a part of w, then 40 bits of v and w; ``hot``: sorted common words."""
    part = np.full(len(v), 61, np.uint64)
    if len(hot):
        part[hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v] = 56
    head = _stir(v * _M1 + (w >> part))
    tail = _stir(_stir(v + _M2) * _M1 + w)
    return (head & np.uint64(0xFFFFFF << 40)) | (tail >> np.uint64(24))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def _split(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Packed rows for each bucket that has some, column by column, which compresses better;
    ``bucket`` is sorted."""
    if not len(rows):
        return bucket, []
    cut = np.flatnonzero(np.diff(bucket)) + 1
    packed = [b"".join(x[f].tobytes() for f in rows.dtype.names) for x in np.split(rows, cut)]
    return bucket[np.concatenate([[0], cut])], packed


def _joined(blocks: list[bytes], kind: np.dtype) -> dict[str, np.ndarray]:
    """The columns of packed rows."""
    parts: dict[str, list[np.ndarray]] = {f: [] for f in kind.names}
    for x in blocks:
        n, at = len(x) // kind.itemsize, 0
        for f in kind.names:
            parts[f].append(np.frombuffer(x, kind[f], n, at))
            at += n * kind[f].itemsize
    return {f: np.concatenate(x) for f, x in parts.items()}


def _count_block(streams: list[np.ndarray], buckets: int, hot: np.ndarray) -> pa.RecordBatch:
    w = np.concatenate(streams)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[0] = START
    v[1:][w[:-1] == END] = START
    key = bigram_key(v, w, hot)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rows = np.empty(len(new), PAIR)
    rows["v"], rows["w"] = v[order[new]], w[order[new]]
    rows["n"] = np.diff(np.append(new, len(key)))
    heads, blocks = _split(_bucket(key[new], buckets), rows)
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Each array as a raw file of the folder; renamed into place, so retries are harmless."""
    here = local_form(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
    for part, x in arrays.items():
        path, tail = f"{folder}/{name}.{part}", f".{uuid.uuid4().hex}"
        if here is not None:
            with open(f"{here}/{name}.{part}{tail}", "wb") as f:
                f.write(np.ascontiguousarray(x).tobytes())
            os.replace(f"{here}/{name}.{part}{tail}", f"{here}/{name}.{part}")
        else:
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_output_stream(at + tail) as f:
                f.write(np.ascontiguousarray(x).tobytes())
            fs.move(at + tail, at)


def _open(folder: str, file: str, kind: str) -> np.ndarray:
    """A file of the folder as a read-only memory map, or its bytes where it cannot be mapped."""
    here = local_form(folder)
    if here is None:
        fs, at = pafs.FileSystem.from_uri(f"{folder}/{file}")
        with fs.open_input_file(at) as f:
            return np.frombuffer(f.read(), kind)
    path = f"{here}/{file}"
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


@dataclass
class Model:
    """Where the arrays are, and the corpus-wide figures; small, sent with each task."""

    folder: str
    buckets: int
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    #: Files of words and of bigrams that were written; a reader that finds another number fails.
    files: tuple[int, int] = (0, 0)
    discount: tuple[float, ...] = (0.5, 1.0, 1.5)
    word_discount: tuple[float, ...] = (0.5, 1.0, 1.5)
    word_kinds: tuple[int, ...] = (0, 0, 0)
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's, from how many things were seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1))


def common_words(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of words that are common in a sample.  They are only about how bigrams
    are spread over buckets, and no figure depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for text in utf8_list(b.column("text")):
                w, n = np.unique(tokens(text)[:-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    share = min(1.0, HOT_SAMPLE / max(1, texts.count()))
    summed = texts.select("text").sample(share, 5).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = summed.agg(F.sum("n")).first()[0] or 0
    found = summed.where(F.col("n") >= HOT_SHARE * total).toArrow()  # 1 / HOT_SHARE words at most
    return np.sort(np.append(found["w"].to_numpy().astype(np.int64).view(np.uint64), START))


def fit(texts: DataFrame) -> Model:
    """Count the ``text`` column of ``texts``; null is an empty text, which is one END."""
    spark = texts.sparkSession
    ship(spark)
    size = text_bytes(texts)
    tasks = parts_for(spark, size, TASK)
    buckets = max(2 * tasks, -(-size // BUCKET))
    hot = common_words(texts)
    folder = shared_path(spark, "lm")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in slices(batches):
            for text in utf8_list(b.column("text")):
                held.append(tokens(text))
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    yield _count_block(held, buckets, hot)
                    held, n = [], 0
        if n:
            yield _count_block(held, buckets, hot)

    def pairs(key: tuple, rows: pa.Table) -> pa.Table:
        a = _joined(rows.column("block").to_pylist(), PAIR)
        k = bigram_key(a["v"], a["w"], hot)
        order = np.argsort(k)
        k = k[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.add.reduceat(a["n"][order].astype(np.int64), new)
        large = n >= LARGE
        _write(folder, f"pair-{key[0].as_py()}", {"key": k[new], "n": np.minimum(n, LARGE).astype("u1")})
        _write(folder, f"large-{key[0].as_py()}", {"key": k[new][large], "n": n[large].astype("<u8")})
        v, w = a["v"][order[new]], a["w"][order[new]]
        del a, order, k
        firsts, at = np.unique(v, return_inverse=True)
        of_v = np.zeros(len(firsts), PART)
        of_v["word"] = firsts
        for i, f in enumerate(("f1", "f2", "f3"), 1):
            of_v[f] = np.bincount(at[n == i if i < 3 else n >= 3], minlength=len(firsts))
        seconds, at = np.unique(w, return_inverse=True)
        of_w = np.zeros(len(seconds), PART)
        of_w["word"], of_w["before"] = seconds, np.bincount(at, minlength=len(seconds))
        of_w["n"] = np.bincount(at, n, minlength=len(seconds)).astype(np.int64)
        parts = np.concatenate([of_v, of_w])
        bucket = _bucket(parts["word"], buckets)
        order = np.argsort(bucket, kind="stable")
        heads, blocks = _split(bucket[order], parts[order])
        kinds = np.array([len(n), *[(n == i).sum() for i in range(1, 5)]], "<i8")
        figures = -1 - key[0].as_py() % FIGURE_GROUPS
        return pa.table({"bucket": pa.array([*heads.tolist(), figures], pa.int32()), "block": pa.array([*blocks, kinds.tobytes()], pa.binary())})

    def words(key: tuple, rows: pa.Table) -> pa.Table:
        found = rows.column("block").to_pylist()
        bucket = key[0].as_py()
        if bucket < 0:
            total = sum((np.frombuffer(x, "<i8") for x in found), np.zeros(5, np.int64))
            return pa.table({"what": pa.array(["pairs"]), "figures": pa.array([[len(found), *total.tolist(), 0, 0]], pa.list_(pa.int64()))})
        a = _joined(found, PART)
        names, at = np.unique(a["word"], return_inverse=True)
        sums = {f: np.bincount(at, a[f], minlength=len(names)).astype(np.int64) for f in PART.names[1:]}
        kinds = np.stack([sums[f] for f in ("f1", "f2", "f3", "before")], axis=1)
        _write(folder, f"word-{bucket}", {"key": names, "n": sums["n"].astype("<u8"), "kinds": kinds.astype("<u4")})
        b = sums["before"]
        figures = [1, sums["n"].sum(), (sums["n"] > 0).sum(), *[(b == i).sum() for i in range(1, 5)], (b >= 3).sum()]
        return pa.table({"what": pa.array(["words"]), "figures": pa.array([[int(x) for x in figures]], pa.list_(pa.int64()))})

    counted = texts.select("text").mapInArrow(count, "bucket int, block binary")
    parts = counted.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(pairs, "bucket int, block binary")
    made = parts.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(words, "what string, figures array<long>")
    model = Model(folder, buckets, hot=hot)
    summed = made.groupBy("what").agg(*[F.sum(F.col("figures")[i]).alias(str(i)) for i in range(8)])
    found = {r["what"]: [int(x) for x in r[1:]] for r in summed.collect()}  # two rows
    words_made, pairs_made = (found.get(x, [0] * 8) for x in ("words", "pairs"))
    model.files = words_made[0], pairs_made[0]
    model.tokens, model.words = words_made[1:3]
    model.word_discount = _discounts(words_made[3:7])
    model.word_kinds = words_made[3], words_made[4], words_made[7]
    if pairs_made[0]:
        model.pairs = pairs_made[1]
        model.discount = _discounts(pairs_made[2:6])
    return model


class Reader:
    """Lookups in the mapped arrays of one model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.maps: dict[str, np.ndarray] = {}
        here = local_form(model.folder)
        if here is not None:
            self.files = set(os.listdir(here)) if os.path.isdir(here) else set()
        else:
            fs, at = pafs.FileSystem.from_uri(model.folder)
            self.files = {x.base_name for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))}
        there = tuple(sum(x.startswith(f"{what}-") and x.endswith(".key") for x in self.files) for what in ("word", "pair"))
        if there != model.files:
            raise FileNotFoundError(f"{model.folder} has {there} files of words and bigrams, the model wrote {model.files}")

    def _file(self, name: str, kind: str) -> np.ndarray:
        if name not in self.maps:
            mapped = local_form(self.model.folder) is not None
            if len(self.maps) >= MAPPED or (not mapped and sum(x.nbytes for x in self.maps.values()) > HELD):
                self.maps.clear()
            self.maps[name] = _open(self.model.folder, name, kind) if name in self.files else np.zeros(0, kind)
        return self.maps[name]

    def find(self, what: str, keys: np.ndarray, value: str, kind: str, width: int) -> np.ndarray:
        """Values of sorted ``keys``; zeros where a key is not stored."""
        out = np.zeros((len(keys), width), kind)
        bucket = _bucket(keys, self.model.buckets)
        edges = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
            if a == b:
                continue
            stored = self._file(f"{what}-{bucket[a]}.key", "<u8")
            if not len(stored):
                continue
            values = self._file(f"{what}-{bucket[a]}.{value}", kind).reshape(-1, width)
            at = np.minimum(np.searchsorted(stored, keys[a:b]), len(stored) - 1)
            hit = stored[at] == keys[a:b]
            out[a:b][hit] = values[at[hit]]
        return out

    def scores(self, streams: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(tokens, known, base score, score) of each token stream."""
        m = self.model
        w = np.concatenate(streams)
        size = np.array([len(x) for x in streams])
        begin = np.cumsum(size) - size
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[begin] = START
        names, at = np.unique(np.append(w, START), return_inverse=True)
        n = self.find("word", names, "n", "<u8", 1)[:, 0].astype(np.float64)
        f1, f2, f3, before = self.find("word", names, "kinds", "<u4", 4).astype(np.float64).T
        with np.errstate(divide="ignore", invalid="ignore"):
            d1, d2, d3 = m.word_discount
            cut = np.select([before == 1, before == 2, before >= 3], [d1, d2, d3], 0.0)
            spare = (d1 * m.word_kinds[0] + d2 * m.word_kinds[1] + d3 * m.word_kinds[2]) / m.pairs if m.pairs else 1.0
            alone = (before - cut) / max(1, m.pairs) + spare / (m.words + 1)
            follow = np.where(names == START, 0.0, n)
            # START never counts as a token; how often it is followed is the number of ENDs.
            follow[names == START] = self._ends()
            e1, e2, e3 = m.discount
            left = np.where(follow > 0, (e1 * f1 + e2 * f2 + e3 * f3) / follow, 1.0)
        iw, iv = at[:-1], np.empty(len(w), np.int64)
        iv[1:] = iw[:-1]
        iv[begin] = at[-1]
        key, back = np.unique(bigram_key(v, w, m.hot), return_inverse=True)
        pair = self.find("pair", key, "n", "u1", 1)[:, 0].astype(np.float64)
        large = np.flatnonzero(pair == LARGE)
        pair[large] = self.find("large", key[large], "n", "<u8", 1)[:, 0]
        pair = (pair - np.select([pair == 1, pair == 2, pair >= 3], [e1, e2, e3], 0.0))[back]
        c = follow[iv]
        p = np.where(c > 0, pair / np.maximum(c, 1), 0.0) + left[iv] * alone[iw]
        base = np.log10((n[iw] + 1) / (m.tokens + m.words + 1))
        total = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every stream has END
        return size, total((n[iw] > 0).astype(np.int64)), total(base), total(np.log10(p))

    def _ends(self) -> float:
        """Texts that were counted: each has one END."""
        if not hasattr(self, "_texts"):
            self._texts = float(self.find("word", np.array([END]), "n", "<u8", 1)[0, 0])
        return self._texts


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, n_tokens, n_known, base_score, score) for every row of ``docs``.

    Scores are log10 probabilities; a null text is an empty one, which is one end.  Perplexity
    is 10 ** (-score / n_tokens).  Texts are scored whole, however long; ids may be null,
    strings or repeated, rows that repeat get equal scores.  Other columns are not used, so
    their names may clash.  An empty table gives no rows, a model of no texts equal odds.
    """
    ship(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in slices(batches):
            texts = utf8_list(b.column(1))
            done, held, n = [], [], 0
            for text in texts:
                held.append(tokens(text))
                n += len(held[-1])
                if n >= BATCH_TOKENS:
                    done.append(reader.scores(held))
                    held, n = [], 0
            if held:
                done.append(reader.scores(held))
            if not done:
                continue
            columns = [pa.array(np.concatenate(x)) for x in zip(*done, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id) -> F.Column:
    """Documents that the model never counts: crc32 of the id as text, mod 7, is 2."""
    return crc_mod(doc_id, 7) == 2


def score_corpus(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and score all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
