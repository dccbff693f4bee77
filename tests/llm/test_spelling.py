"""Near words, forms and roots against brute force."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def pairs_of(words):
    return sorted((a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if near(words[a], words[b]))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé\U0001f600", max_size=7), max_size=50))
def test_the_walk_finds_each_pair_once(words):
    words = sorted(words)
    i, j = S.near_pairs(words)
    assert sorted((min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)) == pairs_of(words)


def test_long_words_with_long_common_parts():
    words = sorted({"x" * n + tail for n in (0, 1, 500, 501, 502) for tail in ("", "ab", "b", "ac")} | {"y" * 3000})
    i, j = S.near_pairs(words)
    assert sorted((min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)) == pairs_of(words)


@pytest.mark.parametrize("home_words", [1, 4, 30, 10_000])
def test_the_cut_loses_and_repeats_no_pair(spark, home_words):
    import random

    rng = random.Random(home_words)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(0, 9))) for _ in range(150)} | {"a" * n for n in range(12)} | {"aaaa" + "b" * n for n in range(9)})
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, 3)], "word string, n long")
    got = sorted((r.word, r.near, r.near_n) for r in S.near_words(vocab, home_words).collect())
    one_way = [(words[a], words[b], b) for a, b in pairs_of(words)]
    assert got == sorted(one_way + [(b, a, words.index(a)) for a, b, _ in one_way])


def test_homes_hold_no_more_than_their_share(spark):
    words = [f"{'same' if i % 3 else 'other'}{i:05d}" for i in range(3000)]
    heavy = S.heavy_prefixes(spark.createDataFrame([(w,) for w in words], "word string"), 40)
    homes = Counter(w[: S.home(w, heavy)] for w in words)
    assert max(homes.values()) <= 40 and "same0" in heavy


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = sorted(w for w, n in counts.items() if len(w) >= 6 and n >= 5)
    around = {w: [] for w in words}
    for a, b in pairs_of(words):
        around[words[a]].append(words[b])
        around[words[b]].append(words[a])
    form = {w: next(iter(sorted((x for x in v if counts[x] >= 5 * counts[w]), key=lambda x: (-counts[x], x))), None) for w, v in around.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), counts[w], len(around[w]), counts[form[w]] if form[w] else 0) for w in words)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_forms_and_roots(spark):
    words = {"kitten": 400, "kittens": 60, "kitens": 11, "mitten": 400, "bitten": 2000, "kittenns": 12, "Kitten": 5, "naïvely": 30, "naïvelÿ": 6, "naivelyÀ": 5, "École": 9, "à×÷bcdé": 40, "à×bcdé": 7}
    docs = [(i, " ".join(w for w, n in words.items() for _ in range(n // 4 + (n % 4 > i)))) for i in range(4)] + [(None, "kitten-kitten_kitten9bitten"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert rows_of(S.group_variants(df)) == want and any(w != r for w, _, r, *_ in want)
    assert rows_of(S.group_variants(df, home_words=2)) == want


def test_odd_documents(spark, odd_docs, odd_table, no_docs):
    for docs in (odd_docs, odd_table):
        assert rows_of(S.group_variants(docs, home_words=20)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert S.group_variants(no_docs).count() == 0


def test_chains_of_any_length_are_followed(spark):
    steps = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, root string")
    assert {r.word: r.root for r in S.follow(steps).collect()} == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37"}
