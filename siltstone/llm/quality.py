"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours; a two-state chain (bad, good)
is fitted by conditional likelihood on lines that inherit their document's label.
Scoring runs forward-backward and averages the marginals of "good", weighted by line
length; a logistic curve fitted on the same sample turns the mean into a probability.

A text of very many lines is scored in windows of lines: features become one number a line at
once, and messages are carried over all lines as products of two-by-two matrices.

Labels are those of whole documents, so no fitted chain steps from bad to good: transitions
are learned as far as they smooth, and it is the neighbours' features and marginals that tell
a bad line among good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, ship, slices, utf8_list
from .labelled import held_out, labelled_sample

#: Labelled documents that fitting reads at most, and lines of all of them together: documents
#: are taken whole, or passed over where they would go beyond it.
MAX_DOCS, MAX_LINES = 4000, 200_000
#: Documents, and lines of all of them, that one forward-backward pass holds together.
_TOGETHER, _LINES = 512, 100_000
#: Lines beyond which a text is scored by itself, and bytes whose lines get features at once then.
_LONG, _WINDOW = 20_000, 1 << 16
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_WORDY = _LOWER + _UPPER + _DIGIT + bytes(range(128, 256)) + b" \t\r\x0b\x0c.,"
_PLAIN = 11  # features of a line itself
N_FEATURES = 3 * _PLAIN + 3


def _line(line: bytes, again: bool) -> tuple[float, ...]:
    n = len(line)
    if n == 0:
        return (0.0,) * _PLAIN
    words = line.split()
    m = len(words) or 1
    symbols = len(line.translate(None, _WORDY))
    upper = n - len(line.translate(None, _UPPER))
    digits = n - len(line.translate(None, _DIGIT))
    distinct = len(set(words))
    stutter = sum(map(bytes.__eq__, words, words[1:])) if distinct < 0.9 * m else 0
    return (
        min(1.0, np.log1p(n) / 8), min(1.0, m / 40), 2 * symbols / n, upper / n, digits / n,
        1 - distinct / m, stutter / m, float(again), min(2.0, n / m / 10), float(line[-1] in b".!?"), 1.0,
    )


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES, line lengths); an empty text is one empty line."""
    lines = text.split(b"\n")
    again = []
    seen: set[bytes] = set()
    for x in lines:
        again.append(x in seen)
        seen.add(x)
    own = np.array([_line(x, a) for x, a in zip(lines, again, strict=True)], np.float64)
    return _with_neighbours(np.concatenate([_NO_LINE, own, _NO_LINE]), True, True), np.array([max(1, len(x)) for x in lines], np.float64)


_NO_LINE = np.zeros((1, _PLAIN))


def _with_neighbours(own: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
    """All features of the lines between the first and the last of ``own``; whether they begin and
    end the text."""
    edge = np.zeros((len(own) - 2, 3))
    edge[0, 0], edge[-1, 1] = begins, ends
    edge[:, 2] = 1
    return np.concatenate([own[1:-1], own[:-2], own[2:], edge], axis=1)


class _Seen:
    """Which hashes came before: sorted arrays, of which two of like size become one."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []

    def again(self, hashes: np.ndarray) -> np.ndarray:
        names, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.zeros(len(names), bool)
        for x in self.held:
            known |= x[np.minimum(np.searchsorted(x, names), len(x) - 1)] == names
        out = known[where]
        out |= np.arange(len(hashes)) != first[where]
        if not known.all():
            self.held.append(names[~known])
        while len(self.held) > 1 and 2 * len(self.held[-1]) >= len(self.held[-2]):
            self.held.append(np.sort(np.concatenate([self.held.pop(), self.held.pop()])))
        return out


def _stretches(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The lines of ``text`` in order, of about ``size`` bytes at a time, or one longer line."""
    at = 0
    while at <= len(text):
        end = text.rfind(b"\n", at, at + size)
        if len(text) - at <= size:
            end = len(text)
        elif end < 0:
            end = text.find(b"\n", at + size)
            end = len(text) if end < 0 else end
        yield text[at:end].split(b"\n")
        at = end + 1


def windows(text: bytes, size: int = _WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What :func:`line_features` gives, a stretch of the text at a time."""
    seen = _Seen()
    last, waits, length = _NO_LINE, np.zeros((0, _PLAIN)), np.zeros(0)
    begins = True
    for part in _stretches(text, size):
        again = seen.again(np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)))
        own = np.array([_line(x, bool(y)) for x, y in zip(part, again, strict=True)], np.float64)
        if len(waits):
            yield _with_neighbours(np.concatenate([last, waits, own[:1]]), begins, False), length
            last, begins = waits[-1:], False
        waits, length = own, np.array([max(1, len(x)) for x in part], np.float64)
    yield _with_neighbours(np.concatenate([last, waits, _NO_LINE]), begins, True), length


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def forward_backward(unary: list[np.ndarray], trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Marginals (lines x 2) of each chain, expected transitions and the log partition sum.

    ``unary``: one (lines x 2) array a chain; ``weight``: what each chain's transitions count.
    Chains advance together, longest first.
    """
    order = sorted(range(len(unary)), key=lambda i: -len(unary[i]))
    size = np.array([len(unary[i]) for i in order])
    longest = int(size[0])
    active = [int((size > t).sum()) for t in range(longest)]
    start = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty((start[-1], 2))
    rank = [start[:n] + k for k, n in enumerate(size)]
    for i, at in zip(order, rank, strict=True):
        flat[at] = unary[i]
    alpha, beta = flat.copy(), np.zeros_like(flat)
    for t in range(1, longest):
        k = active[t]
        before = alpha[start[t - 1] : start[t - 1] + k]
        alpha[start[t] : start[t] + k] += _lse(before[:, :, None] + trans, 1)
    for t in range(longest - 1, 0, -1):
        k = active[t]
        at = slice(start[t], start[t] + k)
        beta[start[t - 1] : start[t - 1] + k] = _lse(trans + (flat[at] + beta[at])[:, None, :], 2)
    first = slice(0, active[0])
    logz = _lse(alpha[first] + beta[first], 1)
    owner = np.concatenate([np.arange(k) for k in active])
    marginal = np.exp(alpha + beta - logz[owner][:, None])
    expected = np.zeros((2, 2))
    share = np.ones(len(order)) if weight is None else weight[order]
    for t in range(1, longest):
        k = active[t]
        at = slice(start[t], start[t] + k)
        pair = alpha[start[t - 1] : start[t - 1] + k][:, :, None] + trans + (flat[at] + beta[at])[:, None, :]
        expected += (np.exp(pair - logz[:k, None, None]) * share[:k, None, None]).sum(axis=0)
    out: list[np.ndarray] = [np.empty(0)] * len(unary)
    for i, at in zip(order, rank, strict=True):
        out[i] = marginal[at]
    return out, expected, float(logz.sum())


def carried(good: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log-odds of "good" at each line of one chain, given all lines up to it.

    A step multiplies the odds, as a vector, by a matrix.  Lines are cut into stretches of equal
    length that are gone through together: first their products, then the odds at which each
    begins, then the odds within.
    """
    n = len(good)
    size = max(1, int(np.sqrt(n)))
    rows = -(-(n - 1) // size)
    out = np.zeros(rows * size + 1)
    out[:n] = good
    held = out[1:].reshape(rows, size)  # overwritten column by column
    step = np.exp(trans.T - trans.max())  # to state by from state

    def advance(v: np.ndarray, j: int) -> np.ndarray:
        """``v``: rows x 2 x any number of columns; states bad, good."""
        half = np.clip(held[:, j, None] / 2, -300, 300)
        v = step @ v
        v[:, 0] *= np.exp(-half)
        v[:, 1] *= np.exp(half)
        return v / v.max(axis=(1, 2), keepdims=True)

    product = np.tile(np.eye(2), (rows, 1, 1))
    for j in range(size):
        product = advance(product, j)
    begin = np.empty((rows, 2, 1))
    half = min(max(good[0] / 2, -300), 300)
    v = np.array([[np.exp(-half)], [np.exp(half)]])
    for k in range(rows):
        begin[k] = v
        v = product[k] @ v
        v = v / v.max()
    tiny = np.finfo(np.float64).tiny
    for j in range(size):
        begin = advance(begin, j)
        held[:, j] = np.log(np.maximum(begin[:, 1, 0], tiny)) - np.log(np.maximum(begin[:, 0, 0], tiny))
    return out[:n]


@dataclass
class LineField:
    """weights: score of "good" against "bad" for a line; trans: state to state; scale,
    shift: the logistic curve over the length-weighted mean's log-odds."""

    weights: np.ndarray
    trans: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def _unary(self, x: np.ndarray) -> np.ndarray:
        good = x @ self.weights
        return np.stack([-good / 2, good / 2], axis=1)

    def means(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each document."""
        out = np.empty(len(features))
        for k in range(0, len(features), _TOGETHER):
            part = features[k : k + _TOGETHER]
            marginals, _, _ = forward_backward([self._unary(x) for x, _ in part], self.trans)
            out[k : k + _TOGETHER] = [_log_odds((m[:, 1] * n).sum() / n.sum()) for m, (_, n) in zip(marginals, part, strict=True)]
        return out

    def mean_of_long(self, text: bytes) -> float:
        """As :meth:`means`, for one text, with some numbers a line in place of all features."""
        made = [(x @ self.weights, n.astype(np.float32)) for x, n in windows(text)]
        good, n = np.concatenate([x for x, _ in made]), np.concatenate([x for _, x in made])
        del made
        odds = carried(good, self.trans)
        odds += carried(good[::-1], self.trans.T)[::-1]
        odds -= good
        total = 0.0
        for k in range(0, len(odds), 1 << 20):
            total += float((n[k : k + (1 << 20)].astype(np.float64) / (1 + np.exp(-np.clip(odds[k : k + (1 << 20)], -700, 700)))).sum())
        return _log_odds(total / float(n.sum(dtype=np.float64)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found = np.empty(len(texts))
        held: list[int] = []
        features: list[tuple[np.ndarray, np.ndarray]] = []
        lines = 0

        def settle() -> None:
            if held:
                found[held] = self.means(features)
                held.clear()
                features.clear()

        for i, text in enumerate(texts):
            count = text.count(b"\n") + 1
            if count > _LONG:
                found[i] = self.mean_of_long(text)
                continue
            if lines + count > _LINES:
                settle()
                lines = 0
            held.append(i)
            features.append(line_features(text))
            lines += count
        settle()
        return 1 / (1 + np.exp(-np.clip(self.scale * found + self.shift, -500, 500)))


def _log_odds(mean: float) -> float:
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y=1) by damped Newton steps, lightly regularised."""
    w = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.01 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), grad)
        w = np.clip(w, [0.05, -20], [20, 20])
    return float(w[0]), float(w[1])


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 120) -> LineField:
    """Adam on the conditional log likelihood, in which each document counts alike however many
    lines it has; without both labels a neutral model."""
    field = LineField(np.zeros(N_FEATURES), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        field.shift = 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
        return field
    xs = [x for x, _ in features]
    weight = 10.0 / np.array([len(x) for x in xs])
    owner = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    every, truth = np.concatenate(xs), labels[owner].astype(np.float64)
    pairs = np.zeros((2, 2))
    for x, y in zip(xs, labels, strict=True):
        pairs[y, y] += 10.0 * (len(x) - 1) / len(x)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        field.weights, field.trans = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        marginals, expected, _ = forward_backward([field._unary(x) for x in xs], field.trans, weight)
        good = np.concatenate([p[:, 1] for p in marginals])
        grad = np.concatenate([every.T @ ((good - truth) * weight[owner]), (expected - pairs).ravel()]) / len(xs) + 1e-4 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weights, field.trans = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
    field.scale, field.shift = _logistic(field.means(features), labels.astype(np.float64))
    return field


def whole_within(sizes: list[tuple], limit: int) -> list:
    """Of (size, key) in a fixed order the keys that fit ``limit`` together."""
    out, held = [], 0
    for n, key in sizes:
        if held + n <= limit:
            out.append(key)
            held += n
    return out


def fit_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> LineField:
    """Fit on ``labels.quality`` of at most ``max_docs`` documents outside the held-out third,
    with ``max_lines`` lines in all.  Every document taken is taken whole.

    Features, not texts, come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sample = labelled_sample(docs, labels, "quality", max_docs)
    sample = materialize(sample.withColumns({"key": F.xxhash64("id", "text"), "lines": n_lines}), "quality-sample")
    sizes = sample.select("lines", "key").orderBy("key", "lines").collect()  # max_docs rows, about
    taken = set(whole_within([(r["lines"], r["key"]) for r in sizes], max_lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            keep = pa.array([k in taken for k in b.column("key").to_pylist()], pa.bool_())
            b = b.filter(keep)
            found = [line_features(t) for t in utf8_list(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("label"), pa.array([x.astype("<f4").tobytes() for x, _ in found], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in found], pa.binary())],
                ["key", "label", "x", "n"],
            )

    rows = sample.mapInArrow(run, "key long, label int, x binary, n binary").toArrow().sort_by([("key", "ascending"), ("x", "ascending")])
    features = [
        (np.frombuffer(x, "<f4").reshape(-1, N_FEATURES).astype(np.float64), np.frombuffer(n, "<f4").astype(np.float64))
        for x, n in zip(rows["x"].to_pylist(), rows["n"].to_pylist(), strict=True)
    ]
    return fit(features, np.array(rows["label"].to_pylist(), np.int64))


def score(docs: DataFrame, field: LineField, keep: list[str] | None = None, name: str = "quality_score") -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the score in a new last column ``name``.

    A column of that name in ``docs`` gives way to the score, other names are safe.  Null and
    empty texts are one empty line; a text is read whole, however many lines it has.  Rows
    that share an id, or repeat, are scored one by one; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = field.scores(utf8_list(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    made = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))
    return made.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = score(docs, fit_sample(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
