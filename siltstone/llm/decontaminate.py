"""Benchmark decontamination over a positional inverted index, in DataFrame functions only; the search
for words that stand near each other looks documents through in Arrow batches.

The index stores a posting (term, doc_id, tag, pos) for every word of the corpus.  It is built
in one pass without a shuffle: each task's documents are a shard whose postings are sorted by
a hash of the term, so a term's list lies in as many places as there are shards and no common
word is in one task, while a shard's postings of a term stand together.  How frequent terms are
is read from it.

A phrase is searched from its rarest terms: their positions, less each term's offset in the
item, give the place where the item would have to start.  Places on which the two rarest terms
of a window agree are few; for them the lists of all other terms of these windows are read and
intersected in the same way, and windows all of whose terms agree are exact occurrences.  Texts
are not looked at again.

Rows of documents are never paired with each other, and a placement is one row however many
windows it carries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits, fresh, materialize, slices, small, temporary

WINDOW = 10
#: Rarest terms of a window whose lists must agree before the others are read.
PROBES = 2
#: Query sides beyond the broadcast bound are dealt over so many salts, and common terms with them.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _split(text: Column) -> Column:
    """Words as they stand, '' after a last separator, and [''] without words."""
    return F.split(F.ltrim(F.coalesce(text, F.lit("")), F.lit(_BETWEEN_CHARS)), _BETWEEN)


def _lowered(word: Column) -> Column:
    """A-Z in lower case; ``lower`` alone is quick, but right for ASCII words only."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Array of lower-cased (A-Z) words of digits, letters and characters from U+0080."""
    return F.transform(F.filter(_split(text), lambda w: w != ""), _lowered)


def _tag(text: str = "text") -> Column:
    """Tells rows with one id, or none, apart by their text; rows equal in both are one document."""
    return F.xxhash64(text)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all words: (term, doc_id, tag, pos), sorted by a hash of the term
    within shards, so that a term's postings stand together."""
    # What is made of the whole text is made before it is exploded, or it is made anew for every
    # word.  The outer form keeps the optimizer from splitting texts again to test their size.
    rows = docs.select("doc_id", _tag().alias("tag"), _split(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "tag", F.posexplode_outer("words").alias("pos", "word")).where("word <> ''")
    rows = rows.select(_lowered(F.col("word")).alias("term"), "doc_id", "tag", "pos").withColumn("h", F.xxhash64("term"))
    return materialize(rows.sortWithinPartitions("h").drop("h"), "idx-postings")


def document_lengths(index: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words) of documents that have words."""
    return index.groupBy("doc_id", "tag").agg((F.max("pos") + 1).cast("long").alias("n_words"))


def term_frequency(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) over the whole corpus for each of the distinct stored ``terms``."""
    counted = index.select("term").join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def lists_of(index: DataFrame, places: DataFrame, limit: int | None = None) -> DataFrame:
    """Postings joined with the stored ``places`` by term.  Where these are too large for a
    broadcast, a common term's list is dealt over ``SALTS`` tasks."""
    if fits(places, limit):
        return index.join(F.broadcast(places), "term")
    salt = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SALTS)).cast("int")
    every = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.withColumn("salt", salt).join(every, ["term", "salt"]).drop("salt")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, words, n): items that have words; ``key`` tells equal ids apart."""
    listed = benchmark.select("item_id", words(F.col("text")).alias("words"))
    return listed.where(F.size("words") > 0).select(
        F.xxhash64(F.col("item_id"), F.col("words")).alias("key"), "item_id", "words", F.size("words").alias("n")
    ).distinct()


def probes(items: DataFrame, freq: DataFrame, window: int = WINDOW, count: int = PROBES) -> DataFrame:
    """(key, start, at, term): for each window of an item, its ``count`` rarest places."""
    placed = items.select("key", F.posexplode("words").alias("at", "term")).join(freq, "term")
    item = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "freq", "term"))).alias("places"))
    last = F.greatest(F.lit(0), F.size("places") - window)
    windows = item.select("key", "places", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    rarest = F.slice(
        F.array_sort(F.transform(F.slice("places", F.col("start") + 1, window), lambda p: F.struct(p["freq"].alias("freq"), p["at"].alias("at"), p["term"].alias("term")))),
        1, count,
    )
    return windows.select("key", "start", F.explode(rarest).alias("p")).select("key", "start", "p.at", "p.term")


def _bit(place: str) -> Column:
    return F.expr(f"shiftleft(1L, {place} % 64)")


def candidates(index: DataFrame, items: DataFrame, window: int = WINDOW, count: int = PROBES, limit: int | None = None) -> DataFrame:
    """(doc_id, tag, key, offset, starts): item placements, and their windows on whose rarest
    terms the lists agree."""
    terms = materialize(items.select(F.explode("words").alias("term")).distinct(), "idx-terms")
    freq = materialize(term_frequency(index, terms), "idx-freq")
    wanted = materialize(probes(items, freq, window, count), "idx-probes")
    places = materialize(wanted.select("term", "key", "at").distinct(), "idx-places")
    # Offset-adjusted lists: equal offsets are the same placement of the item.
    hits = lists_of(index, places, limit).select("doc_id", "tag", "key", (F.col("pos") - F.col("at")).alias("offset"), "at")
    # Which places met is one bit each, modulo 64: places of one window never share a bit, and
    # places further apart that do are told apart when all lists are read.
    met = hits.groupBy("doc_id", "tag", "key", "offset").agg(F.bit_or(_bit("at")).alias("met"))
    per_item = wanted.groupBy("key", "start").agg(F.bit_or(_bit("at")).alias("need"))
    per_item = materialize(per_item.groupBy("key").agg(F.collect_list(F.struct("start", "need")).alias("needs")), "idx-needs")
    agree = F.filter("needs", lambda x: x["need"].bitwiseAND(F.col("met")) == x["need"])
    joined = met.join(small(per_item, limit), "key").withColumn("agree", agree).where(F.size("agree") > 0)
    return joined.select("doc_id", "tag", "key", "offset", F.transform("agree", lambda x: x["start"]).alias("starts"))


def _runs(places: Column, need: Column) -> Column:
    """Runs of at least ``need`` consecutive numbers among the sorted ``places``, as structs
    (first, size)."""
    zero = F.struct(
        F.lit(-2).alias("last"), F.lit(0).alias("run"),
        F.expr("cast(array() as array<struct<first:int,size:int>>)").alias("runs"),
    )
    ended = lambda acc: F.when(
        acc["run"] >= need, F.concat(acc["runs"], F.array(F.struct((acc["last"] - acc["run"] + 1).alias("first"), acc["run"].alias("size"))))
    ).otherwise(acc["runs"])

    def walk(acc: Column, at: Column) -> Column:
        on = at == acc["last"] + 1
        return F.struct(
            at.alias("last"), F.when(on, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
            F.when(on, acc["runs"]).otherwise(ended(acc)).alias("runs"),
        )

    return F.aggregate(places, zero, walk, ended)


def occurrences(index: DataFrame, items: DataFrame, window: int = WINDOW, limit: int | None = None) -> DataFrame:
    """(doc_id, tag, item_id, offset, runs) of every item placement with an exact hit: runs of
    ``window`` words of the item or more, or all words of a shorter item, as structs (first,
    size) of item positions, ``offset`` being where its word 0 would stand."""
    placed = materialize(candidates(index, items, window, limit=limit), "idx-placed")
    n = F.least(F.col("n"), F.lit(window))
    spread = placed.join(small(materialize(items.select("key", "n"), "idx-sizes"), limit), "key")
    asked = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + n - 1))))
    asked = spread.select("doc_id", "tag", "key", "offset", F.explode(asked).alias("at"))
    terms = materialize(items.select("key", F.posexplode("words").alias("at", "term")), "idx-words")
    asked = asked.join(small(terms, limit), ["key", "at"]).withColumn("pos", F.col("offset") + F.col("at"))
    asked = asked.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "key", "offset", "at", F.col("term").alias("w"), F.col("pos").alias("p"))
    # All lists of these documents, met on term and adjusted position at once.
    where = materialize(placed.select(F.col("doc_id").alias("d"), F.col("tag").alias("t")).distinct(), "idx-docs")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))
    lists = index.join(small(where, limit), same, "left_semi")
    met = lists.join(asked, same & (F.col("term") == F.col("w")) & (F.col("pos") == F.col("p")))
    met = met.groupBy("doc_id", "tag", "key", "offset").agg(F.array_sort(F.collect_set("at")).alias("places"))
    named = met.join(small(materialize(items.select("key", "item_id", "n"), "idx-names"), limit), "key")
    return named.select("doc_id", "tag", "item_id", "offset", _runs(F.col("places"), n).alias("runs")).where(F.size("runs") > 0)


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with n_words and ``found``: per matching placement of an item
    its id, offset and hit runs.

    One row per row of ``docs``; ``found`` is null without a match, ``n_words`` without words.
    Kept columns of these two names give way; other names, also of ``benchmark``, are safe.
    """
    with temporary() as stays:  # the index goes when it has been searched
        index = build_index(docs)
        items = materialize(items_of(benchmark), "idx-items")
        hits = occurrences(index, items, window, limit)
        listed = stays(materialize(hits.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("item_id", "offset", "runs")).alias("found")), "idx-found"))
        lengths = stays(materialize(document_lengths(index), "idx-lengths"))
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("n_words", "found")]
    i, t = fresh("row_id", keep), fresh("row_tag", keep)
    rows = docs.select(*keep, F.col("doc_id").alias(i), _tag().alias(t))
    for side in (lengths, listed):
        side = side.withColumnsRenamed({"doc_id": "side_id", "tag": "side_tag"})
        same = F.col(i).eqNullSafe(F.col("side_id")) & (F.col(t) == F.col("side_tag"))
        value = side.columns[-1]
        joined = rows.join(small(side, limit) if value == "found" else side, same, "left")
        rows = joined.select(*rows.columns, value)
    return rows.select(*keep, "n_words", "found")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or
    of a whole shorter item.  Items without words match nothing; an item with a null id hits
    words but is not listed; equal items count once.  Null and empty texts have no words,
    texts are read whole, however long.  Ids of documents may be null, strings or repeated:
    rows of one id are told apart by their texts.  Other columns are not used, so their names
    may clash.  An empty table of documents gives no rows, one of items no hits.
    """
    hits = phrase_hits(docs, benchmark, window, limit=limit)
    spans = F.flatten(F.transform("found", lambda p: F.transform(
        p["runs"], lambda r: F.struct((p["offset"] + r["first"]).alias("a"), (p["offset"] + r["first"] + r["size"]).alias("b")))))
    union = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda p: p["item_id"].cast("string")), lambda x: x.isNotNull())))
    named = hits.select(
        "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce(union, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array()).alias("ids")
    )
    return named.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def proximity_hits(index: DataFrame, phrases: DataFrame, slop: int, limit: int | None = None) -> DataFrame:
    """(doc_id, tag, phrase_id, pos): where all words of a phrase stand within a short stretch.

    ``index``: of :func:`build_index`; ``phrases``: (phrase_id, text).  ``pos`` is each position
    of a phrase's rarest word for which every other word of it occurs at most ``slop`` words
    away, in any order.  Of the index only the asked words are read; they are brought together by document
    once, however many phrases ask for them.  A repeated word of a phrase counts once.
    """
    listed, terms = _asked(phrases)
    held = index.join(small(terms, limit), "term", "left_semi").groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("p"))
    rows = held.select("doc_id", "tag", F.col("p.term").alias("words"), F.col("p.pos").alias("at"))
    found = _near(rows, listed.join(term_frequency(index, terms), "term"), slop)
    return found.select("doc_id", "tag", "phrase_id", F.explode("places").alias("pos"))


def _asked(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrase_id, term) and (term), stored."""
    listed = phrases.select("phrase_id", F.explode(words(F.col("text"))).alias("term")).distinct()
    listed = materialize(listed, "near-terms")
    return listed, materialize(listed.select("term").distinct(), "near-distinct")


#: Words of phrases that one pass takes, about, and documents that are looked through at once.
PASS_WORDS, AT_ONCE = 50_000, 4096


def _near(rows: DataFrame, listed: DataFrame, slop: int) -> DataFrame:
    """(doc_id, tag, phrase_id, places) for each of ``rows`` (doc_id, tag, words[, at]) and phrase whose words
    stand together; ``listed``: (phrase_id, term, freq).  ``at``: where the words stand, by default one after another.

    A document is looked through within its row: nothing is shuffled, and no row is made of a place and a phrase.
    Phrases go in passes of some ``PASS_WORDS`` words.
    """
    rank = F.row_number().over(Window.partitionBy("phrase_id").orderBy("freq", "term"))
    ranked = materialize(listed.withColumn("rank", rank), "near-rank")
    n = ranked.count()
    passes = 1 if n <= PASS_WORDS else -(-2 * n // PASS_WORDS)
    found = None
    for k in range(passes):
        some = ranked if passes == 1 else ranked.where(F.pmod(F.xxhash64("phrase_id"), F.lit(passes)) == k)
        part = _near_pass(rows, some, slop)
        found = part if found is None else found.unionByName(part)
    return found


def _near_pass(rows: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    asked = ranked.select("phrase_id", "term", "rank").toArrow()  # of one pass
    who = asked.column("phrase_id").combine_chunks().dictionary_encode(null_encoding="encode")
    what = asked.column("term").combine_chunks().dictionary_encode()
    names, vocabulary = who.dictionary, what.dictionary
    order = np.lexsort((asked.column("rank").to_numpy(), who.indices.to_numpy()))
    terms = np.split(what.indices.to_numpy()[order], np.cumsum(np.bincount(who.indices.to_numpy(), minlength=len(names)))[:-1])  # rarest first
    rarest = np.array([x[0] for x in terms if len(x)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, AT_ONCE):
            listed = b.column("words")
            size = pa.compute.list_value_length(listed).fill_null(0).to_numpy().astype(np.int64)
            first = np.cumsum(size) - size
            at = np.arange(size.sum()) - np.repeat(first, size) if "at" not in b.schema.names else b.column("at").flatten().to_numpy().astype(np.int64)
            # Documents lie one after another on a line, so far apart that no stretch reaches from one to the next.
            room = np.zeros(b.num_rows, np.int64)
            np.maximum.at(room, np.repeat(np.arange(b.num_rows), size), at + 1)
            start = np.cumsum(room + slop + 1) - (room + slop + 1)
            term = pa.compute.index_in(pa.compute.ascii_lower(listed.flatten()), value_set=vocabulary).fill_null(-1).to_numpy()
            on = np.flatnonzero(term >= 0)
            place = (at + np.repeat(start, size))[on]
            by = np.lexsort((place, term[on]))
            place, ends = place[by], np.cumsum(np.bincount(term[on], minlength=len(vocabulary)))
            stand = np.split(place, ends[:-1]) if len(vocabulary) else []
            docs, which, places = [], [], []
            for p in np.flatnonzero(np.diff(ends, prepend=0)[rarest]):
                mine = stand[terms[p][0]]
                for t in terms[p][1:]:
                    other = stand[t]
                    if not len(mine) or not len(other):
                        mine = mine[:0]
                        break
                    near = np.searchsorted(other, mine - slop)
                    mine = mine[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] <= mine + slop)]
                if len(mine):
                    doc = np.searchsorted(start, mine, side="right") - 1
                    docs.append(doc)
                    which.append(np.full(len(mine), p))
                    places.append(mine - start[doc])
            if docs:
                doc, p, pos = np.concatenate(docs), np.concatenate(which), np.concatenate(places).astype(np.int32)
                new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(p, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)).astype(np.int32)), pa.array(pos))
                columns = [b.column("doc_id").take(pa.array(doc[new])), b.column("tag").take(pa.array(doc[new])), names.take(pa.array(p[new])), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "phrase_id", "places"])

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind(rows, 'doc_id')}, tag long, phrase_id {kind(ranked, 'phrase_id')}, places array<int>")


#: Of the registered proximity query: words of an item that are looked for, and their stretch.
OPENING, SLOP = 3, 20


def loose_openings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, doc_id, n_places): documents in which the first ``OPENING`` words of an item
    stand within ``SLOP`` words of the rarest of them, in any order.  Items and documents are
    taken by id; nulls are left out."""
    opening = F.array_join(F.slice(words(F.col("text")), 1, OPENING), " ")
    asked = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").alias("phrase_id"), opening.alias("text"))
    listed, terms = _asked(asked)
    docs = docs.where("doc_id IS NOT NULL")
    freq = term_frequency(docs.select(F.explode_outer(_split(F.col("text"))).alias("word")).select(_lowered(F.col("word")).alias("term")), terms)
    rows = docs.select("doc_id", _tag().alias("tag"), _split(F.col("text")).alias("words"))
    found = _near(rows, listed.join(freq, "term"), SLOP)
    # Rows equal in id and text are one document.
    once = found.groupBy("phrase_id", "doc_id", "tag").agg(F.max(F.size("places")).alias("n"))
    return once.groupBy(F.col("phrase_id").alias("item_id"), "doc_id").agg(F.sum("n").alias("n_places"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + 9], ' ') AS phrase
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS s)),
hit AS (SELECT doc_id, item_id, s, win.k FROM grams JOIN win ON grams.phrase = win.phrase AND grams.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

PROXIMITY_ORACLE = r"""
WITH d AS (SELECT doc_id, LISTS AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
f AS (SELECT term, count(*) AS freq FROM t GROUP BY term),
p AS (SELECT DISTINCT item_id, unnest(list_distinct((LISTS)[1:3])) AS term FROM benchmark),
r AS (SELECT item_id, p.term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(freq, 0), p.term) AS rank FROM p LEFT JOIN f USING (term)),
n AS (SELECT item_id, count(*) AS n FROM r GROUP BY item_id),
a AS (SELECT item_id, doc_id, pos FROM r JOIN t USING (term) WHERE rank = 1),
o AS (SELECT item_id, doc_id, rank, pos FROM r JOIN t USING (term) WHERE rank > 1 AND (item_id, doc_id) IN (SELECT (item_id, doc_id) FROM a)),
m AS (
  SELECT a.item_id, a.doc_id, a.pos, count(DISTINCT o.rank) AS others
  FROM a LEFT JOIN o ON o.item_id = a.item_id AND o.doc_id = a.doc_id AND abs(o.pos - a.pos) <= 20 GROUP BY ALL)
SELECT m.item_id, m.doc_id, count(*) AS n_places FROM m JOIN n USING (item_id) WHERE others = n - 1 GROUP BY m.item_id, m.doc_id
""".replace("LISTS", """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')""")
