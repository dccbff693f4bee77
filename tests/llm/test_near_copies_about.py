"""Groups with one large part: texts are told by what sets them apart from its centre."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import near_copies
from test_near_copies import brute_set, linked_classes
from test_near_copies_met import texts_of_lengths


def copies(rng, n, few=3, many=4):
    """Copies of one text of 150 words, each with one to ``few`` words changed, every sixth with ``many``."""
    word = lambda: f"w{rng.randrange(10**6)}"
    base, texts = [word() for _ in range(150)], []
    for k in range(n):
        new = list(base)
        for at in rng.sample(range(150), many if k % 6 == 0 else rng.randint(1, few)):
            new[at] = word()
        texts.append(" ".join(new))
    return texts


@pytest.mark.parametrize("c", [0, 3, 90])
def test_every_alike_pair_about_a_centre_is_met(spark, c):
    texts = copies(random.Random(3), 60) + texts_of_lengths(random.Random(6))
    sets = [brute_set(t) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])
    root = [c if like(i, c) or i % 5 == 0 else i for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    roots = spark.createDataFrame(list(enumerate(root)), "key long, root long")
    near = df.select(F.lit(c).cast("long").alias("c"), "key")
    got = [tuple(sorted((r.a, r.b))) for r in near_copies._about(near, df, roots).collect()]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if root[i] != root[j] and like(i, j)}
    assert len(alike) > 50 and any(c in (root[i], root[j]) for i, j in alike)
    assert alike <= set(got) and all(root[i] != root[j] for i, j in got)


@pytest.mark.parametrize("n", [100, 200])
def test_copies_of_one_original_do_not_all_meet(spark, monkeypatch, n):
    """Copies of one text, each with some words changed: most are linked through the centre, some are too far from
    all others.  Those must not be paired with every text of the large part."""
    texts = copies(random.Random(12), n)
    proposed = []
    ordered = near_copies._ordered
    monkeypatch.setattr(near_copies, "_ordered", lambda pairs: proposed.append(pairs.distinct().count()) or ordered(pairs))
    monkeypatch.setattr(near_copies, "band_keys", lambda h: np.arange(1, dtype=np.int64) + 7)
    got, want = linked_classes(spark, texts)
    assert got == want and len(set(want.values())) > 1
    assert sum(proposed) <= 8 * n
