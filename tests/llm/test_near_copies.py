"""The pipeline's near copies against brute-force Jaccard over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import near_copies, simhash
from test_simhash import classes


def brute_set(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    sets = [brute_set(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    comp = classes(near, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[comp[i]] = min(d, least.get(comp[i], d))
    return sorted(least.values()), [(i, j) for i, j in near if sets[i] != sets[j]]


def test_near_copies_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    common = [rng.choice(vocab) for _ in range(30)]
    texts = [None, "", " ", "One two", "one TWO", "one two three"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 150))] + (common if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            texts.append(" ".join(base))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want, near = kept_by_brute_force(rows)
    far = [simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[j][1].encode()) for i, j in near]
    assert sum(x.bit_count() > simhash.RADIUS for x in far) > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_stage(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_near_copies_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, near = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert near
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == want


def linked_classes(spark, texts, **_):
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    links = [(r.u, r.v) for r in near_copies.copy_links(df).collect()]
    sets = [brute_set(t) for t in texts]
    assert all(len(sets[u] & sets[v]) * 5 >= 4 * len(sets[u] | sets[v]) for u, v in links)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    return classes(links, range(len(texts))), classes(near, range(len(texts)))


def unlike(rng, n):
    """Texts that are not alike, then pairs that are, further apart than SimHash proposes."""
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(60)) for _ in range(n)]
    for _ in range(3):
        base = [word() for _ in range(120)]
        texts += [" ".join(base), " ".join([*base[:60], word(), *base[61:]])]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_groups_are_settled_whole(spark, monkeypatch, most):
    """All texts in all groups together: no pair may be passed over, however many are not alike."""
    monkeypatch.setattr(near_copies, "band_keys", lambda h: np.arange(3, dtype=np.int64) + 7)
    monkeypatch.setattr(near_copies, "MOST", most)
    got, want = linked_classes(spark, unlike(random.Random(3), 20))
    assert got == want and len(set(want.values())) == 23


def test_recall_of_band_keys():
    """Share of pairs of a similarity just above the threshold that have a key in common."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(1500):
        both = rng.integers(0, 2**62, 90)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**62, 11)])) for _ in range(2))
        met += bool(set(near_copies.band_keys(a)) & set(near_copies.band_keys(b)))
    assert met / 1500 > 0.995
