"""Large groups: what a cut proposes holds every alike pair, and does not grow with the square of a group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import near_copies
from test_near_copies import brute_set, linked_classes


def texts_of_lengths(rng):
    """Texts that are alike up to the least similarity, by changed words and by cut or added ends."""
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(6, 90))]
        texts.append(base)
        for _ in range(6):
            new = list(base)
            for _ in range(rng.randint(0, 2)):
                new[rng.randrange(len(new))] = f"w{rng.randrange(3000)}"
            n = rng.randint(0, len(base) // 4)
            texts.append(new[n:] if rng.random() < 0.5 else new + [f"w{rng.randrange(3000)}" for _ in range(n)])
    return sorted({" ".join(x) for x in texts})


def test_every_alike_pair_of_a_cut_is_met(spark):
    texts = texts_of_lengths(random.Random(6))
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    roots = df.select("key", F.when(F.col("key") % 4 == 0, F.lit(0)).otherwise(F.col("key")).cast("long").alias("root"))
    cut = near_copies._cut(roots.withColumn("h", F.lit(1).cast("long")), df)
    got = [tuple(sorted((r.a, r.b))) for r in near_copies._met(cut, roots).collect()]
    sets = [brute_set(t) for t in texts]
    root = [0 if k % 4 == 0 else k for k in range(len(texts))]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if root[i] != root[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}
    assert len({(len(sets[i]), len(sets[j])) for i, j in alike if len(sets[i]) != len(sets[j])}) > 20
    assert alike <= set(got) and all(root[i] != root[j] for i, j in got)


@pytest.mark.parametrize("n", [40, 80])
def test_proposed_pairs_grow_with_the_texts(spark, monkeypatch, n):
    """One passage in all texts, just short of what makes them alike: a few pairs a text, not a row for each two."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(124)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(16))]) for _ in range(n)]
    texts += [t + " end" for t in texts[:3]]
    proposed = []
    ordered = near_copies._ordered
    monkeypatch.setattr(near_copies, "_ordered", lambda pairs: proposed.append(pairs.count()) or ordered(pairs))
    monkeypatch.setattr(near_copies, "band_keys", lambda h: np.arange(3, dtype=np.int64) + 7)
    got, want = linked_classes(spark, texts)
    assert got == want and len(set(want.values())) == n
    assert sum(proposed) <= 12 * n
