"""Toxicity by exact nearest labelled examples under TF-IDF cosine.

The vector space is all words of the labelled examples; document frequencies are counted over
all documents.  A word's weight is (1 + log tf) * idf, and ``linked`` times that where the
sample ties the word to a label, since a few words decide what a text of some hundred says;
``linked=1`` is plain TF-IDF.  No word of the examples is left out, and words that no example
holds have no axis.

Examples sit in a block-max inverted index: a word's postings are cut by blocks of examples,
with the largest weight of each block beside them.  Lists of very common words hold nearly every
example; they are rows of a matrix, which a batch of queries multiplies at once.  The largest of
these products in a block and its words' largest weights bound what the block can reach.  Blocks
of the largest bounds are looked into first, and then only those whose bound reaches the k-th
best found, so the neighbours are exact and other blocks' postings are never read.  Alike
examples share blocks, which is what makes bounds tight.

Votes weighted by cosine are turned into probabilities by a curve fitted on examples whose
labels took no part in tying words to labels.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, slices, utf8_list
from .labelled import held_out, labelled_sample

#: Labelled documents that examples are drawn from at most.
MAX_EXAMPLES = 10_000
K, BLOCK, THRESHOLD = 15, 64, 0.7
#: Of so many examples one fits the curve, and does not tie words to labels.
TUNE = 5
#: Factor of words tied to a label, and what ties them: rates under the two labels that differ
#: by so many deviations and so many times, in so many examples.
LINKED, MIN_Z, MIN_RATIO, MIN_COUNT = 4.0, 3.0, 4.0, 3
#: Blocks that are looked into before any bound is compared.
FIRST = 8
#: A word that more than one in so many examples hold is a row of the matrix.
COMMON = 24
#: Texts that are searched together.
TOGETHER = 128
#: Parts in which tasks pass their document counts on.
_SLICES = 64
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters A-Z (lower-cased) and bytes from 128."""
    return text.translate(_TABLE).split()


def counts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words of a text, and how often each occurs."""
    found = Counter(words_of(text))
    n, digest = len(found), xxhash.xxh64_intdigest
    return np.fromiter(map(digest, found), np.uint64, n), np.fromiter(found.values(), np.int64, n)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of begin[0]..end[0], begin[1]..end[1], and so on."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def linked_words(word: np.ndarray, owner: np.ndarray, labels: np.ndarray, n_words: int) -> np.ndarray:
    """Whether each word is far more frequent under one label; ``owner`` is the example that
    holds ``word`` (each pair once), examples from ``len(labels)`` on are left out."""
    mine = owner < len(labels)
    y = labels[owner[mine]] > 0
    pos = np.bincount(word[mine], y, n_words)
    neg = np.bincount(word[mine], ~y, n_words)
    n1 = float((labels > 0).sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        return np.zeros(n_words, bool)
    rate = (pos + neg + 1) / (n0 + n1)
    z = np.abs(pos / n1 - neg / n0) / np.sqrt(rate * (1 / n0 + 1 / n1))
    ratio = (pos + 0.5) / n1 / ((neg + 0.5) / n0)
    return (pos + neg >= MIN_COUNT) & (z >= MIN_Z) & ((ratio >= MIN_RATIO) | (ratio <= 1 / MIN_RATIO))


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples in blocks.

    ``words`` are sorted hashes with their ``weight``.  Word v has the entries ``eptr[v]`` to
    ``eptr[v + 1]``, one a block: its number, largest weight, and where its postings begin; those
    of ``common`` words are the rows of ``matrix``.
    """

    words: np.ndarray
    weight: np.ndarray
    ids: list
    labels: np.ndarray
    eptr: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    eblock: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    emax: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    epost: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    k: int = K
    empty_rate: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    looked: int = 0
    passed: int = 0

    def add(self, word: np.ndarray, owner: np.ndarray, value: np.ndarray) -> None:
        """Postings in any order: example ``owner`` holds ``word`` with weight ``value``."""
        held = np.bincount(word, minlength=len(self.words))
        self.common = np.flatnonzero(held * COMMON > max(COMMON, len(self.labels)))
        many = np.zeros(len(self.words), bool)
        many[self.common] = True
        many = many[word]
        self.matrix = np.zeros((len(self.common), self._blocks() * BLOCK), np.float32)
        self.matrix[np.searchsorted(self.common, word[many]), owner[many]] = value[many]
        word, owner, value = word[~many], owner[~many], value[~many]
        order = np.lexsort((owner, word))
        word, self.example, self.value = word[order], owner[order].astype(np.int32), value[order].astype(np.float32)
        block = self.example // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(block) != 0)])) if len(word) else np.zeros(0, np.int64)
        self.epost = np.append(new, len(word)).astype(np.int32)
        self.eblock = block[new].astype(np.int32)
        self.emax = np.maximum.reduceat(self.value, new) if len(new) else self.value
        self.eptr = np.searchsorted(word[new], np.arange(len(self.words) + 1)).astype(np.int32)

    def _blocks(self) -> int:
        return -(-len(self.labels) // BLOCK)

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, weight) of a text's unit vector."""
        if not len(self.words) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        at = at[hit]
        w = (1 + np.log(counts[hit])) * self.weight[at]
        order = np.argsort(at)  # sums do not depend on the order of words
        at, w = at[order], w[order]
        return at, w / (math.sqrt(float((w * w).sum())) or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the k examples of largest cosine above 0 as (cosine, example), without
        ``skip``; cosines are rounded to 6 digits, ties go by example."""
        out: list[list[tuple[float, int]]] = []
        for begin in range(0, len(vectors), TOGETHER):
            part = vectors[begin : begin + TOGETHER]
            asked = np.zeros((len(part), len(self.common)), np.float32)
            rest = []
            for row, (at, w) in zip(asked, part, strict=True):
                place = np.minimum(np.searchsorted(self.common, at), max(0, len(self.common) - 1))
                hit = self.common[place] == at if len(self.common) else np.zeros(len(at), bool)
                row[place[hit]] = w[hit]
                rest.append((at[~hit], w[~hit]))
            sums = asked @ self.matrix
            for n, (row, (at, w)) in enumerate(zip(sums, rest, strict=True)):
                out.append(self._best(row.astype(np.float64), at, w, k, skip[begin + n] if skip else -1))
        return out

    def _best(self, sums: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        n_blocks = self._blocks()
        if not n_blocks:
            return []
        if skip >= 0:
            sums[skip] = -2.0
        size = self.eptr[at + 1] - self.eptr[at]
        entry = _ranges(self.eptr[at].astype(np.int64), self.eptr[at + 1].astype(np.int64))
        q, block = np.repeat(w, size), self.eblock[entry]
        bound = sums.reshape(n_blocks, BLOCK).max(axis=1) + np.bincount(block, q * self.emax[entry], n_blocks) + 1e-6
        order = np.argsort(-bound, kind="stable")
        first = order[:FIRST]
        wanted = np.zeros(n_blocks, bool)
        wanted[first] = True
        self._collect(sums, entry, q, wanted[block])
        seen = sums.reshape(n_blocks, BLOCK)[first].ravel()
        least = np.partition(seen, -k)[-k] if len(seen) >= k else -1.0
        more = order[FIRST:][: int(np.searchsorted(-bound[order[FIRST:]], -least, "right"))]
        if len(more):
            wanted[:] = False
            wanted[more] = True
            self._collect(sums, entry, q, wanted[block])
        self.looked += len(first) + len(more)
        self.passed += n_blocks - len(first) - len(more)
        among = (np.concatenate([first, more])[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        found = sums[among].round(6)
        top = np.partition(found, -k)[-k] if len(found) > k else 0.0
        pick = np.flatnonzero((found >= top) & (found > 0))
        best, found = among[pick], found[pick]
        line = np.lexsort((best, -found))[:k]
        return list(zip(found[line].tolist(), best[line].tolist(), strict=True))

    def _collect(self, sums: np.ndarray, entry: np.ndarray, q: np.ndarray, take: np.ndarray) -> None:
        e = entry[take]
        begin, end = self.epost[e].astype(np.int64), self.epost[e + 1].astype(np.int64)
        post = _ranges(begin, end)
        sums += np.bincount(self.example[post], np.repeat(q[take], end - begin) * self.value[post], len(sums))

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, weighted by cosine."""
        total = sum(s for s, _ in found)
        return sum(s * float(self.labels[i]) for s, i in found) / total if total else 0.0

    def probability(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return self.empty_rate
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.scale * self.vote(found) + self.shift))))


def _curve(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the vote, regularised; never falling."""
    z, w = np.stack([votes, np.ones_like(votes)], axis=1), np.array([4.0, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w = np.clip(w - np.linalg.solve(h, z.T @ (p - y) + 0.1 * (w - np.array([6.0, -3.0]))), [0, -20], [30, 20])
    return float(w[0]), float(w[1])


def document_frequency(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """Over all rows of ``docs``: documents with each of the sorted ``words``, and documents.

    A task passes its counts on in packed parts, so what is shuffled does not grow with the
    documents of a task.
    """
    edges = np.linspace(0, len(words), _SLICES + 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(words), np.int32), 0
        for b in batches:
            for text in utf8_list(b.column("text")):
                n += 1
                if len(words):
                    found = set(words_of(text))
                    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    df[at[words[at] == h]] += 1
        parts = [df[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] + [0] * (_SLICES - 1), pa.int64())], ["part", "df", "n"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for b in rows:
            for x, m in zip(b.column("df").to_pylist(), b.column("n").to_pylist(), strict=True):
                total, n = total + np.frombuffer(x, "<i4").astype(np.int64), n + m
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["part", "df", "n"])

    counted = docs.select("text").mapInArrow(run, "part int, df binary, n long")
    rows = counted.groupBy("part").applyInArrow(add, "part int, df binary, n long").collect()  # one number a word
    if not rows:
        return np.zeros(len(words), np.int64), 0
    rows.sort(key=lambda r: r["part"])
    return np.frombuffer(b"".join(r["df"] for r in rows), "<i8"), sum(r["n"] for r in rows)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, linked: float = LINKED) -> BlockMaxIndex:
    """Index of at most ``max_examples`` labelled documents outside the held-out third."""
    ship(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, "toxic", max_examples), "tox-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [counts_of(t) for t in utf8_list(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                ["id", "label", "h", "n"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"id {kind}, label int, h binary, n binary").toArrow()  # max_examples rows
    ids, found = rows["id"].to_pylist(), [np.frombuffer(x, "<u8") for x in rows["h"].to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in rows["n"].to_pylist()]
    y = np.array([1.0 if x else 0.0 for x in rows["label"].to_pylist()])
    del rows
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    df, total = document_frequency(docs, words)
    return build(ids, y, found, counts, words, np.log((total + 1) / (df + 1)) + 1.0, linked)


def build(ids: list, y: np.ndarray, found: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, idf: np.ndarray, linked: float = LINKED) -> BlockMaxIndex:
    """The index of examples given as word hashes and counts; one in ``TUNE`` fits the curve."""
    some = np.array([len(x) > 0 for x in found], bool)
    empty_rate = (float(y[~some].sum()) + 0.05) / ((~some).sum() + 1.0)
    # Examples that tie words to labels come first, those that fit the curve last.
    tune = np.array([int(xxhash.xxh32_intdigest(str(i))) % TUNE == 0 for i in ids], bool)
    size = np.array([len(x) for x in found], np.int64)
    word = np.searchsorted(words, np.concatenate([np.zeros(0, np.uint64), *found])).astype(np.int32)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), size)
    place = np.empty(len(found), np.int64)
    place[np.argsort(tune, kind="stable")] = np.arange(len(found))
    weight = idf * np.where(linked_words(word, place[owner], y[np.argsort(tune, kind="stable")][: int((~tune).sum())], len(words)), linked, 1.0)
    value = (1 + np.log(np.concatenate([np.zeros(0, np.uint32), *counts]))) * weight[word]
    norm = np.sqrt(np.bincount(owner, value * value, len(found)))
    value = value / np.maximum(norm[owner], 1e-300)
    # Alike examples stand together: by the common word, the tied word and the other word, held by
    # several, that weigh most in them.  The first of these keeps languages apart.
    held = np.bincount(word, minlength=len(words))
    common, tied = held * COMMON > len(found), weight > idf
    heads = np.stack([_heaviest(word, owner, value, x[word], len(found)) for x in (common, tied, (held >= 5) & ~common & ~tied)], axis=1)
    rank = {i: n for n, i in enumerate(sorted(range(len(ids)), key=lambda i: str(ids[i])))}
    line = sorted(np.flatnonzero(some).tolist(), key=lambda i: (*heads[i].tolist(), rank[i]))
    new = np.full(len(found), -1, np.int64)
    new[line] = np.arange(len(line))
    out = BlockMaxIndex(words, weight, [ids[i] for i in line], y[line])
    out.empty_rate = empty_rate
    out.add(word, new[owner], value)
    tuned = np.flatnonzero(tune & some).tolist()
    if tuned:
        near = out.nearest([out.vector(found[i], counts[i]) for i in tuned], out.k, new[tuned].tolist())
        out.scale, out.shift = _curve(np.array([out.vote(x) for x in near]), y[tuned])
    return out


def _heaviest(word: np.ndarray, owner: np.ndarray, value: np.ndarray, take: np.ndarray, n: int) -> np.ndarray:
    """Each example's word of largest weight among the postings to ``take``; -1 without one."""
    word, owner, value = word[take], owner[take], value[take]
    order = np.lexsort((word, value, owner))
    last = np.flatnonzero(np.diff(owner[order], append=-1) != 0)
    out = np.full(n, -1, np.int64)
    out[owner[order][last]] = word[order][last]
    return out


def score(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """(doc_id, score, evidence) for every row of ``docs``, in any number, also of equal ids.

    ``evidence``: the neighbours' ids, cosines and labels, nearest first.  Null and empty
    texts, and those without a word of any example, have no neighbours and get the rate of
    label 1 among examples without words.  Texts are read whole, however long.  Other columns
    are not used, so their names may clash; ids may be null or strings; an empty table gives
    no rows, and without labels all scores are the same.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = docs.sparkSession.createDataFrame([], rows.select("doc_id").schema).toArrow().schema.field(0).type
    id_name = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("doc_id", kind), ("cosine", pa.float64()), ("label", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by max_examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches):
            scores, evidence = [], []
            for found in index.nearest([index.vector(*counts_of(t)) for t in utf8_list(b.column("text"))], index.k):
                scores.append(index.probability(found))
                evidence.append([{"doc_id": index.ids[i], "cosine": s, "label": int(index.labels[i])} for s, i in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(item))],
                ["doc_id", "score", "evidence"],
            )

    shape = f"doc_id {id_name}, score double, evidence array<struct<doc_id:{id_name},cosine:double,label:int>>"
    return rows.mapInArrow(run, shape)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs``."""
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence",
    )
