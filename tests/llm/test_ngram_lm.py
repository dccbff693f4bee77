"""Scores against a dictionary-based bigram model written from the formulas."""

import math
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import ngram_lm
from siltstone.llm.common import local_form


def brute(train, texts):
    toks = lambda t: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(), "</s>"]
    uni, bi = Counter(), Counter()
    for t in train:
        seq = toks(t)
        uni.update(seq)
        bi.update(zip(["<s>", *seq[:-1]], seq, strict=True))
    n, vocab = sum(uni.values()), len(uni)
    ends = uni["</s>"]
    before = Counter(w for _, w in bi)
    d = ngram_lm._discounts([sum(c == i for c in bi.values()) for i in range(1, 5)])
    e = ngram_lm._discounts([sum(c == i for c in before.values()) for i in range(1, 5)])
    cut = lambda c, ds: 0 if c == 0 else ds[min(c, 3) - 1]
    kinds = [sum(c == 1 for c in before.values()), sum(c == 2 for c in before.values()), sum(c >= 3 for c in before.values())]
    spare = sum(a * b for a, b in zip(e, kinds, strict=True)) / len(bi)
    follow = {v: [0, 0, 0] for v, _ in bi}
    for (v, _), c in bi.items():
        follow[v][min(c, 3) - 1] += 1
    out = []
    for t in texts:
        seq = toks(t)
        base = sum(math.log10((uni[w] + 1) / (n + vocab + 1)) for w in seq)
        total = 0.0
        for v, w in zip(["<s>", *seq[:-1]], seq, strict=True):
            alone = (before[w] - cut(before[w], e)) / len(bi) + spare / (vocab + 1)
            c = ends if v == "<s>" else uni[v]
            if c:
                b = bi[v, w]
                p = (b - cut(b, d)) / c + sum(x * y for x, y in zip(d, follow[v], strict=True)) / c * alone
            else:
                p = alone
            total += math.log10(p)
        out.append((len(seq), sum(uni[w] > 0 for w in seq), n, base, total))
    return out


ROWS = [(i, t) for i, t in enumerate(
    ["The cat sat on the mat.", "the dog sat on the log", None, "", "a a a a b b b c c d", "THE CAT ate the rat", "la la la land \t\n the end",
     "É é the É", "a b a b a b", "the cat sat", "unseen words only here", "x " * 500, "the cat sat on the mat."] * 3
)]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score_corpus(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in ROWS}
    want = brute([t for i, t in ROWS if not held[i]], [t for _, t in ROWS])
    assert len(got) == len(ROWS)
    for (i, _), (n, known, train, base, total) in zip(ROWS, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(total, rel=1e-9)


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ngram_lm.fit(none)
    assert ngram_lm.score(none, model).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngram_lm.score(some, model).first().n_known == 0


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b a c",), ("b a",), ("c c c a b",)], "text string")
    model = ngram_lm.fit(texts)
    reader = ngram_lm.Reader(model)
    words = [b"a", b"b", b"c", b"zzz"]
    for ctx in (b"a", b"b", b"c"):
        two = [reader.scores([ngram_lm.tokens(ctx + b" " + w)[:2]])[3][0] - reader.scores([ngram_lm.tokens(ctx)[:1]])[3][0] for w in words]
        end = reader.scores([ngram_lm.tokens(ctx)])[3][0] - reader.scores([ngram_lm.tokens(ctx)[:1]])[3][0]
        assert sum(10**x for x in [*two, end]) == pytest.approx(1.0)


def test_large_counts(spark):
    rows = [(i, "go go stop " * 300) for i in range(4)] + [(9, "go stop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.fit(docs)).collect()}
    for (i, _), want in zip(rows, brute([t for _, t in rows], [t for _, t in rows]), strict=True):
        assert got[i].score == pytest.approx(want[4], rel=1e-9)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.score_corpus(odd_docs).collect())
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    want = brute([t for (_, t), h in zip(rows, held, strict=True) if not h], [t for _, t in rows])
    assert got == sorted((str(i), n, known, train, round(base, 6), round(total, 6)) for (i, _), (n, known, train, base, total) in zip(rows, want, strict=True))
    assert ngram_lm.score_corpus(no_docs).count() == 0
    named = odd_docs.withColumn("doc_id", F.concat(F.lit("d-"), "doc_id"))
    assert ngram_lm.score_corpus(named).count() == len(rows)


def test_stores_that_cannot_be_mapped(spark, odd_docs, monkeypatch):
    model = ngram_lm.fit(odd_docs)
    streams = [ngram_lm.tokens((r.text or "").encode()) for r in odd_docs.collect()]
    mapped = ngram_lm.Reader(model).scores(streams)
    model.folder = "file://" + model.folder
    monkeypatch.setattr(ngram_lm, "local_form", lambda path: None)
    monkeypatch.setattr(ngram_lm, "HELD", 1000)
    for a, b in zip(mapped, ngram_lm.Reader(model).scores(streams), strict=True):
        assert (a == b).all()


def test_common_words_change_only_where_bigrams_lie(spark, odd_docs, monkeypatch):
    want = sorted(map(tuple, ngram_lm.score_corpus(odd_docs).drop("doc_id").collect()))
    monkeypatch.setattr(ngram_lm, "HOT_SHARE", 10.0)
    got = sorted(map(tuple, ngram_lm.score_corpus(odd_docs).drop("doc_id").collect()))
    assert got == [pytest.approx(x) for x in want]


def test_missing_files_are_an_error(spark, odd_docs):
    model = ngram_lm.fit(odd_docs)
    folder = local_form(model.folder)
    os.remove(next(f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.startswith("word-") and x.endswith(".key")))
    with pytest.raises(FileNotFoundError):
        ngram_lm.Reader(model)
