"""Spelling variants: words one edit apart, found by a self-join of the vocabulary's trie.

The trie is cut by prefixes.  ``heavy`` prefixes are those of more words than one task should
hold; each word's home is its shortest prefix that is not heavy, so a home is a subtrie of
bounded size, however many words begin alike.

*Below the cut* both words of a pair are in one home.  Its subtrie is walked level by level, all
nodes of a level at once, with the active nodes of each: the nodes that one edit reaches.  While
no edit is spent a node is active for itself alone.  At every node the edit may be spent: its
children become active for each other (replaced), and a child for the node itself (inserted).
From there both sides go down by equal characters only.  Where both end, a terminal pair is
emitted.

*Above the cut* the edit falls on a heavy prefix, and the two words have different homes.  Nodes
that are active for each other because one character was replaced have the same name with that
character left open, and move down together by equal characters; so a word is sent once with each
heavy place left open, and not once to each active node.  A word with a heavy place deleted is
sent as the name of the only node that is active for it.  What is left must be equal on both
sides, so Spark joins by it; of a run of equal characters only the first is deleted, so no pair is
found twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship, slices
from .crc_sql import CRC_TABLE, crc32_sql

#: Words: runs of these, after A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One run in so many, chosen by a checksum, has a character deleted.
DELETED = 199
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: Words that a home may hold; of a large vocabulary a share of it, so that there are at most
#: 1 / SHARE heavy prefixes of each length.
HOME_WORDS, SHARE = 8192, 1 / 4096
#: Lengths of prefixes that one pass counts.
_STEP = 6


# -- words and how often they occur ----------------------------------------------


def runs(doc_id: str, text: str) -> Counter[str]:
    """How often each result occurs in one text: see :func:`vocabulary`."""
    found: Counter[str] = Counter()
    head = f"{doc_id}:"
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: A-Z alone are lower-cased
        h = zlib.crc32((head + run).encode())
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, that have ``length`` characters
    and occur ``count`` times at least.

    One run in ``DELETED``, by a checksum of id and run, loses a character first.  Null texts have
    no words, a null id counts as empty text; ids may be strings, rows that repeat count each.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: Counter[str] = Counter()
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for word, n in runs(doc_id, text).items():
                    found[word] += n
            held = {w: n for w, n in found.items() if len(w) >= length}
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# -- the cut -----------------------------------------------------------------------


def heavy_prefixes(words: DataFrame, limit: int) -> set[str]:
    """Prefixes of more than ``limit`` of the distinct ``words`` (word), the empty one too."""
    if words.count() <= limit:
        return set()
    heavy, last = {""}, {""}
    depth = 0
    spark = words.sparkSession
    while last:
        roots = spark.createDataFrame([(x,) for x in sorted(last)], "root string")  # 1 / SHARE rows at most
        under = words.join(F.broadcast(roots), F.substring("word", 1, depth) == F.col("root"), "left_semi") if depth else words
        longer = F.filter(F.sequence(F.lit(depth + 1), F.lit(depth + _STEP)), lambda d: d <= F.length("word"))
        cut = F.explode(F.transform(longer, lambda d: F.substring("word", F.lit(1), d)))
        found = {r["p"] for r in under.select(cut.alias("p")).groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("p").collect()}  # _STEP / SHARE rows at most
        heavy |= found
        depth += _STEP
        last = {p for p in found if len(p) == depth}
    return heavy


def home(word: str, heavy: set[str]) -> int:
    """How many characters of ``word`` name its home: the first prefix that is not heavy, or all."""
    d = 0
    while d < len(word) and word[:d] in heavy:
        d += 1
    return d


HOME, OPEN, SHORT = 0, 1, 2


def sent(word: str, heavy: set[str]) -> Iterator[tuple[int, str]]:
    """(role, key): the home of ``word``; the word with each heavy place left open; the words that
    come of deleting a heavy place, if their home is another."""
    d = home(word, heavy)
    yield HOME, word[:d]
    # A word that ends within the heavy prefixes has no place left there but for an insertion.
    for i in range(d):
        yield OPEN, f"{i} {word[:i]} {word[i + 1 :]}"
        if i == 0 or word[i - 1] != word[i]:
            less = word[:i] + word[i + 1 :]
            if less[: home(less, heavy)] != word[:d]:
                yield SHORT, less


# -- one home ----------------------------------------------------------------------


def _counted(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each of the counts, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _pairs_of(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j within each group of ``count`` consecutive numbers from ``first``."""
    place = _counted(count)
    i = np.repeat(first, count) + place
    after = np.repeat(count, count) - 1 - place
    return np.repeat(i, after), np.repeat(i, after) + 1 + _counted(after)


class Level:
    """The nodes of one depth: ranges of the sorted words that share so many characters."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, char: np.ndarray, parent: np.ndarray, word: np.ndarray) -> None:
        self.starts, self.ends, self.char, self.parent = starts, ends, char, parent
        self.word = word  # the word that ends here, or -1


class Trie:
    """Levels of a trie over sorted distinct words, made one after the other."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)

    def root(self) -> Level:
        n = len(self.size)
        word = np.array([0 if n and self.size[0] == 0 else -1])
        return Level(np.zeros(1, np.int64), np.array([n]), np.array([-1]), np.array([-1]), word)

    def below(self, level: Level, depth: int) -> Level:
        """Children of the nodes of ``level``, which is at ``depth``, in order of (parent, char)."""
        count = level.ends - level.starts
        parent = np.repeat(np.arange(len(count)), count)
        word = np.repeat(level.starts, count) + _counted(count)
        on = self.size[word] > depth
        parent, word = parent[on], word[on]
        char = self.codes[self.at[word] + depth]
        new = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])])) if len(word) else np.zeros(0, np.int64)
        starts = word[new]
        ends = starts + np.diff(np.append(new, len(word)))
        ended = np.where(self.size[starts] == depth + 1, starts, -1)
        return Level(starts, ends, char[new], parent[new], ended)


_WIDE = 1 << 21  # more than any code point


def _children(level: Level, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, child) for all children, which are in ``level``."""
    first, last = np.searchsorted(level.parent, nodes, "left"), np.searchsorted(level.parent, nodes, "right")
    count = last - first
    which = np.repeat(np.arange(len(nodes)), count)
    return which, np.repeat(first, count) + _counted(count)


def _step(a: np.ndarray, b: np.ndarray, under_a: Level, under_b: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children by equal characters of the pairs of nodes (a, b)."""
    which, child = _children(under_a, a)
    key = under_b.parent * _WIDE + under_b.char
    want = b[which] * _WIDE + under_a.char[child]
    at = np.searchsorted(key, want)
    hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == want) if len(key) else np.zeros(len(want), bool)
    return child[hit], at[hit]


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of each two of the sorted distinct ``words`` that are one edit apart, once."""
    none = np.zeros(0, np.int64)
    left: list[np.ndarray] = [none]
    right: list[np.ndarray] = [none]

    def emit(x: np.ndarray, y: np.ndarray) -> None:
        ok = (x >= 0) & (y >= 0)
        left.append(x[ok])
        right.append(y[ok])

    trie = Trie(words)
    depth, here = 0, trie.root()
    below = trie.below(here, 0)
    replaced, inserted = (none, none), (none, none)  # active pairs: both at this depth, and the second one deeper
    while True:
        # Spend the edit at the nodes of more than one word.
        several = np.flatnonzero(here.ends - here.starts > 1)
        which, child = _children(below, several)
        count = np.bincount(which, minlength=len(several))
        first = np.searchsorted(below.parent, several)
        again = below.char[child] == here.char[several][which]  # deleting the one before gives the same word
        fresh_inserted = several[which][~again], child[~again]
        fresh_replaced = _pairs_of(count, first)
        emit(here.word[fresh_inserted[0]], below.word[fresh_inserted[1]])
        inserted = tuple(np.concatenate(x) for x in zip(inserted, fresh_inserted, strict=True))
        # One level down, by equal characters.
        deeper = trie.below(below, depth + 1)
        replaced = tuple(np.concatenate(x) for x in zip(_step(*replaced, below, below), fresh_replaced, strict=True))
        inserted = _step(*inserted, below, deeper)
        emit(below.word[replaced[0]], below.word[replaced[1]])
        emit(below.word[inserted[0]], deeper.word[inserted[1]])
        depth, here, below = depth + 1, below, deeper
        if not len(here.starts) or not (len(replaced[0]) or len(inserted[0]) or (here.ends - here.starts > 1).any()):
            return np.concatenate(left), np.concatenate(right)


# -- distributed -------------------------------------------------------------------

_PAIR = "word string, near string, near_n long"


def near_words(vocab: DataFrame, home_words: int = HOME_WORDS) -> DataFrame:
    """(word, near, near_n): each two of the stored, distinct ``vocab`` (word, n) that differ by
    exactly one inserted, deleted or replaced character, in both directions.

    Words may be of any characters and lengths; null ones are left out.
    """
    spark = vocab.sparkSession
    ship(spark)
    vocab = vocab.where("word IS NOT NULL").select("word", "n")
    heavy = heavy_prefixes(vocab.select("word"), max(home_words, int(vocab.count() * SHARE)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            found = [(i, role, key) for i, word in enumerate(b.column("word").to_pylist()) for role, key in sent(word, heavy)]
            whose = pa.array([i for i, _, _ in found], pa.int64())
            columns = [pa.array([r for _, r, _ in found], pa.int32()), pa.array([k for _, _, k in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, b.column("word").take(whose), b.column("n").take(whose)], ["role", "key", "word", "n"])

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        words, n = rows.column("word").to_pylist(), rows.column("n").combine_chunks()
        key = rows.column("key")[0].as_py()
        # Arrow sorts UTF-8 bytes, which is the order of code points.
        i, j = near_pairs([w[len(key) :] for w in words])
        one, other = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        word = rows.column("word").combine_chunks()
        return pa.table({"word": word.take(one), "near": word.take(other), "near_n": n.take(other)})

    routed = materialize(vocab.mapInArrow(send, "role int, key string, word string, n long"), "trie-sent")
    inner = routed.where(F.col("role") == HOME).groupBy("key").applyInArrow(walk, _PAIR)

    # At most one word for each character that the open place can take, so the list is bounded by the alphabet.
    met = routed.where(F.col("role") == OPEN).groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("met")).where(F.size("met") > 1)
    replaced = met.select("met", F.explode("met").alias("a")).select("a", F.explode("met").alias("b")).where("a.word <> b.word")
    replaced = replaced.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))

    short = routed.where(F.col("role") == SHORT).select(F.col("key").alias("short"), F.col("word").alias("long"), F.col("n").alias("long_n"))
    joined = short.join(vocab, F.col("short") == F.col("word"))
    both = F.array(
        F.struct(F.col("word"), F.col("long").alias("near"), F.col("long_n").alias("near_n")), F.struct(F.col("long").alias("word"), F.col("short").alias("near"), F.col("n").alias("near_n"))
    )
    deleted = joined.select(F.inline(both))
    return inner.unionByName(replaced).unionByName(deleted)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", home_words: int = HOME_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``: see :func:`vocabulary`.

    ``form``: of the near words the most frequent one, the first in code-point order of several, if
    it occurs ``LEAST_RATIO`` times as often as the word; else null.  ``root``: where following
    the forms ends, the word itself without one.

    Null and empty texts have no words, rows that repeat count each, ids may be null or strings and
    texts of any length; other columns are not used, so their names may clash.  An empty
    table gives no rows.
    """
    vocab = materialize(vocabulary(docs, id_col, text_col), "trie-words")
    # Of equal counts the first word wins: max_by over a count and the negated order of words is
    # the same as the least of (negated count, word).
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocab, home_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocab.join(near, "word", "left")
    taken = -F.col("best.less") >= LEAST_RATIO * F.col("n")
    formed = materialize(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")),
        "trie-forms",
    )
    roots = follow(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(steps: DataFrame) -> DataFrame:
    """(word, root): where following ``steps`` (word, root) ends.

    Each round takes steps of twice the length.  A form is ``LEAST_RATIO`` times as frequent as its
    word, so chains and rounds are few, and there are no circles.
    """
    now = steps
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(up, "root", "left_semi").isEmpty():
            return now
        longer = materialize(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "trie-root")
        discard(now)
        now = longer


_WORD = f"CASE WHEN h % {DELETED} = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END"
ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED {CRC_TABLE},
r AS (
  SELECT doc_id, r, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents)
  GROUP BY ALL),
h AS (SELECT r, c, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM r, crc),
v AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT {_WORD} AS word, c FROM h) GROUP BY word HAVING sum(c) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
o AS (SELECT word, n, i, substr(word, 1, i) || '?' || substr(word, i + 2) AS open, substr(word, 1, i) || substr(word, i + 2) AS short FROM v, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
p AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.open = b.open AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.short = v.word
  UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.short = v.word),
b AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, min((-near_n, near)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best[1] >= {LEAST_RATIO} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {LEAST_RATIO} * n THEN -best[1] END AS form_n
  FROM v LEFT JOIN b USING (word)),
t AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""
