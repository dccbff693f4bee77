"""Decontamination, packing, classifiers, media, shards and licences on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, licenses, media, packing, quality, token_shards, toxicity


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


# -- decontamination


def brute_hits(docs, items, w=10):
    out = []
    for d, t in docs:
        doc, hit, ids = words(t), set(), set()
        for i, x in items:
            item = words(x)
            k = min(w, len(item))
            for s in range(len(item) - k + 1 if k else 0):
                for p in range(len(doc) - k + 1):
                    if doc[p : p + k] == item[s : s + k]:
                        hit |= set(range(p, p + k))
                        ids.add(i)
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((str(d), len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def items_for(docs):
    whole = next(t for d, t in docs if d == 31)
    return [(1, whole), (2, " ".join(words(docs[2][1])[3:14])), (10, "a b"), (3, "nothing of this kind is anywhere in here at all"), (4, None), (5, "!!"),
            (6, "ab ab ab ab ab ab ab ab ab ab ab ab"), (None, docs[5][1]), (7, whole), (7, "x"), (8, docs[40][1][:400]), (1, whole)]


def test_decontamination(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = items_for(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    for limit in (None, 0):  # sides are broadcast, or all joins shuffle and hot terms are salted
        got = decontaminate.report(odd_docs, bench, limit=limit).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(x[5] for x in want) > 5
    assert decontaminate.report(no_docs, bench).count() == 0
    clean = decontaminate.report(odd_docs, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)
    con = duckdb.connect()
    con.register("documents", odd_docs.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW benchmark AS SELECT * FROM (VALUES (1, 'a b'), (2, 'Tail shared')) t(item_id, text)")
    assert len(con.sql(decontaminate.ORACLE).fetchall()) == len(docs)


def test_native_plan_has_no_python(spark, odd_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.report(odd_docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_index_holds_every_word_once(spark, odd_docs):
    index = decontaminate.build_index(odd_docs)
    got = sorted((str(r.doc_id), r.term, r.pos) for r in index.distinct().collect())
    assert got == sorted({(str(r.doc_id), w, i) for r in odd_docs.collect() for i, w in enumerate(words(r.text))})
    plan = decontaminate.build_index(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_near(docs, phrases, slop):
    freq, out = {}, []
    for _, t in docs:
        for w in words(t):
            freq[w] = freq.get(w, 0) + 1
    for p, x in phrases:
        terms = sorted(set(words(x)), key=lambda w: (freq.get(w, 0), w))
        for d, t in docs:
            ws = words(t)
            for i, w in enumerate(ws):
                if terms and w == terms[0] and all(any(v == o and abs(i - j) <= slop for j, v in enumerate(ws)) for o in terms[1:]):
                    out.append((str(d), p, i))
    return sorted(set(out))


def test_proximity(spark, odd_docs):
    docs = [(1, "red x x blue"), (2, "blue red"), (3, "red x x x x blue"), (4, "red red blue"), (None, "blue x red"), (7, None), (1, "other red blue")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    phrases = [(0, "red BLUE red"), (1, "x"), (2, "red x blue"), (3, "missing red"), (4, "!!")]
    asked = spark.createDataFrame(phrases, "phrase_id int, text string")
    for limit in (None, 0):
        got = decontaminate.proximity_hits(decontaminate.build_index(frame), asked, 3, limit).collect()
        assert sorted((str(r.doc_id), r.phrase_id, r.pos) for r in got) == brute_near(docs, phrases, 3)


# -- packing


def brute_pack(items, capacities):
    """Best-fit decreasing one item at a time with the same opening rule."""
    left, bins = sum(items), []
    for n in sorted(items, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            best = min(fit, key=lambda b: b[0] - b[1])
        else:
            best = [packing.opening(n, left - n, capacities), 0]
            bins.append(best)
        best[1] += n
        left -= n
    return sorted((min(c for c in capacities if c >= used), used) for _, used in bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_item_by_item(seed):
    rng = np.random.default_rng(seed)
    capacities = (16, 32, 64)
    items = rng.integers(1, [65, 20, 6, 65, 40, 3][seed], 400 if seed else 3).tolist()
    histogram = {}
    for n in items:
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.pack(histogram, capacities)
    got = sorted((g.capacity, g.used) for g in plan.groups for _ in range(g.count))
    assert got == brute_pack(items, capacities)
    spans = {}
    for n, count in histogram.items():
        for b, o, c in zip(*plan.place(n, np.arange(count)), strict=True):
            spans.setdefault((b, c), []).append((o, o + n))
    for (_, c), parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= c and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def all_ids(spark, docs):
    """Token ids of every text by one call of the tokenizer each, and END."""
    encoder = token_shards._encoder(token_shards.read_ranks(spark))
    return [(str(r.doc_id), [*encoder.encode(r.text or "", disallowed_special=()), token_shards.END]) for r in docs.collect()]


def test_packing_documents(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, (64, 256, 1024)).collect()
    want = all_ids(spark, odd_docs)
    cut = sorted((i, k, tuple(ids[at : at + 1024])) for i, ids in want for k, at in enumerate(range(0, len(ids), 1024)))
    got = []
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u2").tolist()
        assert len(ids) == r.capacity in (64, 256, 1024) and set(ids[r.n_tokens :]) <= {token_shards.PAD}
        edges = [*r.offsets, r.n_tokens]
        assert edges[0] == 0 and edges == sorted(edges) and r.capacity == min(c for c in (64, 256, 1024) if c >= r.n_tokens)
        got += [(str(d), k, tuple(ids[a:z])) for d, k, a, z in zip(r.doc_ids, r.pieces, edges[:-1], edges[1:], strict=True)]
    assert sorted(got) == cut and sorted(r.bin for r in rows) == list(range(len(rows)))
    assert sorted((r.capacity, r.n_tokens) for r in rows) == brute_pack([len(x) for _, _, x in cut], (64, 256, 1024))
    assert packing.pack_documents(no_docs).count() == 0


def test_placing_follows_from_the_data_alone(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED", 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(sorted(map(tuple, packing.pack_documents(docs.repartition(n)).withColumn("tokens", F.md5("tokens")).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


# -- classifiers


def labelled(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 3 == 0
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            line = [str(x) for x in rng.choice(vocab, int(rng.integers(4, 20)))]
            if toxic:
                line[0] = str(rng.choice(["vileone", "vileman", "vilest"]))
            lines.append(" ".join(x + ("%%%" if bad else "") for x in line) + ".")
        rows.append((i, "\n".join(lines)))
        labels.append((i, None if i % 50 == 49 else int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.5), (toxicity, "toxic", 0.7)])
def test_held_out_accuracy(spark, odd_docs, no_docs, module, label, cut):
    docs, labels = labelled(spark)
    rows = module.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert np.mean([r.predicted == r[label] for r in held if r[label] is not None]) > 0.95
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.classify(docs, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-12) for r in rows)
    n = odd_docs.count()
    assert module.classify(odd_docs, labels).count() == n and module.classify(no_docs, labels).count() == 0
    assert module.classify(odd_docs, labels.limit(0)).count() == n


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(2, 2))
    unary = [rng.normal(size=(n, 2)) for n in (4, 1, 3)]
    got, expected, logz = quality.forward_backward(unary, trans)
    z_all, pairs = 0.0, np.zeros((2, 2))
    for u, m in zip(unary, got, strict=True):
        total, marginal, pair = 0.0, np.zeros_like(u), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=len(u)):
            w = np.exp(sum(u[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, s in enumerate(path):
                marginal[i, s] += w
            for a, b in zip(path, path[1:], strict=False):
                pair[a, b] += w
        z_all += np.log(total)
        pairs += pair / total
        assert np.allclose(m, marginal / total)
    assert np.allclose(expected, pairs) and np.isclose(logz, z_all)


def test_quality_scores_by_brute_force(spark, odd_docs):
    """Features line by line, marginals by enumeration over all paths, the weighted mean, the curve."""
    rng = np.random.default_rng(6)
    field = quality.LineField(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)), 1.3, -0.2)
    texts = ["One line.", "a b c\n\nAAA 99 %%%\na b c\nlast one!", None, "", "\n", "x\ny\nx\nx x x"]

    def features(lines):
        own, seen = [], set()
        for x in lines:
            b, ws = x.encode(), x.split()
            n, m = len(b), max(1, len(ws))
            plain = sum(c.islower() or c.isupper() or c.isdigit() or c in " \t\r\x0b\x0c.," or ord(c) > 127 for c in x)
            distinct = len(set(ws))
            own.append([0.0] * 11 if not n else [
                min(1, math.log1p(n) / 8), min(1, m / 40), 2 * (n - plain) / n, sum(c.isupper() for c in x) / n, sum(c.isdigit() for c in x) / n, 1 - distinct / m,
                sum(a == c for a, c in zip(ws, ws[1:], strict=False)) / m if distinct < 0.9 * m else 0, float(x in seen), min(2, n / m / 10), float(x[-1] in ".!?"), 1.0,
            ])
            if n:
                seen.add(x)
        zero = [0.0] * 11
        return [own[i] + (own[i - 1] if i else zero) + (own[i + 1] if i + 1 < len(own) else zero) + [float(i == 0), float(i + 1 == len(own)), 1.0] for i in range(len(own))]

    def brute(text):
        lines = (text or "").split("\n")
        good = [float(np.dot(field.weights, f)) for f in features(lines)]
        size = [max(1, len(x.encode())) for x in lines]
        total, share = 0.0, [0.0] * len(lines)
        for path in itertools.product((0, 1), repeat=len(lines)):
            w = math.exp(sum((s - 0.5) * g for s, g in zip(path, good, strict=True)) + sum(field.trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            share = [x + w * s for x, s in zip(share, path, strict=True)]
        mean = min(max(sum(x / total * n for x, n in zip(share, size, strict=True)) / sum(size), 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(1.3 * math.log(mean / (1 - mean)) - 0.2)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.quality_score for r in quality.score(docs, field).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([brute(t) for t in texts])


def test_quality_is_fitted_on_whole_documents(spark):
    """Junk that begins after line 400 counts: no document is cut."""
    rows, labels = [], []
    for i in range(60):
        bad = i % 2
        rows.append((i, "\n".join(["Some plain words here."] * 450 + (["%% ## $$ 99 %%"] if bad else ["Other plain words."]) * 200)))
        labels.append((i, 1 - bad, 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got)
    assert quality.whole_within([(5, "a"), (9, "b"), (4, "c"), (2, "d")], 10) == ["a", "c"]


def brute_index(examples, everything, linked_by, factor):
    """{word: weight} unit vectors of texts over the examples' words, from the definition."""
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(t))
    n = len(everything)
    df = Counter(w for t in everything for w in set(split(t)))
    vocab = {w for t in examples for w in split(t)}

    def vector(t):
        v = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) * (factor if w in linked_by else 1) for w, c in Counter(split(t)).items() if w in vocab}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    return vector


def test_toxicity_by_brute_force(spark):
    docs, labels = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    index = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(index.ids) == sorted(train)
    pick = [i for i in train if xxhash.xxh32_intdigest(str(i)) % toxicity.TUNE]
    split = lambda t: set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(t)))
    n1, n0 = sum(truth[i] for i in pick), sum(1 - truth[i] for i in pick)
    tied = set()
    for w in {w for i in pick for w in split(texts[i])}:
        a, b = sum(truth[i] for i in pick if w in split(texts[i])), sum(1 - truth[i] for i in pick if w in split(texts[i]))
        rate = (a + b + 1) / (n0 + n1)
        z, ratio = abs(a / n1 - b / n0) / math.sqrt(rate * (1 / n0 + 1 / n1)), ((a + 0.5) / n1) / ((b + 0.5) / n0)
        if a + b >= 3 and z >= 3 and (ratio >= 4 or ratio <= 0.25):
            tied.add(w)
    assert {"vileone", "vileman", "vilest"} <= tied
    vector = brute_index([texts[i] for i in train], list(texts.values()), tied, toxicity.LINKED)
    vectors = {i: vector(texts[i]) for i in train}
    for i in list(texts)[::23]:
        mine = vector(texts[i])
        cosines = sorted((round(sum(x * v.get(w, 0) for w, x in mine.items()), 6) for v in vectors.values()), reverse=True)[:15]
        found = rows[i].evidence
        assert [e.cosine for e in found] == pytest.approx(cosines, abs=3e-6)
        for e in found:
            assert e.cosine == pytest.approx(sum(x * vectors[e.doc_id].get(w, 0) for w, x in mine.items()), abs=3e-6) and e.label == truth[e.doc_id]
        vote = sum(e.cosine * e.label for e in found) / sum(e.cosine for e in found)
        assert rows[i].score == pytest.approx(1 / (1 + math.exp(-(index.scale * vote + index.shift))), abs=1e-9)


def test_block_max_is_exact_and_passes_blocks_by():
    rng = np.random.default_rng(2)
    names = [f"t{i}".encode() for i in range(400)]
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
    words_ = np.sort(hashes)
    found, counts = [], []
    for g in rng.integers(0, 8, 1500):  # eight vocabularies that share a few words
        pick = np.unique(np.concatenate([rng.integers(0, 8, 3), 8 + 48 * g + rng.integers(0, 48, rng.integers(1, 9))]))
        found.append(hashes[pick])
        counts.append(rng.integers(1, 5, len(pick)).astype(np.uint32))
    found.append(np.zeros(0, np.uint64))
    counts.append(np.zeros(0, np.uint32))
    y = rng.integers(0, 2, len(found)).astype(float)
    index = toxicity.build(list(range(len(found))), y, found, counts, words_, rng.random(400) + 0.5)
    assert 0 < len(index.common) < 400 and len(index.labels) == 1500
    dense = np.zeros((1500, 400))
    for row, i in zip(dense, index.ids, strict=True):
        at, w = index.vector(found[i], counts[i])
        row[at] = w
    index.looked = index.passed = 0
    queries = [index.vector(found[i], counts[i]) for i in range(0, 1500, 9)]
    got = index.nearest(queries, 15)
    assert index.passed > index.looked / 4
    for (at, w), best in zip(queries, got, strict=True):
        s = dense[:, at] @ w
        assert [x for x, _ in best] == pytest.approx(np.sort(s)[::-1][:15], abs=2e-6)
        assert all(x == pytest.approx(s[i], abs=2e-6) for x, i in best) and len({i for _, i in best}) == 15
    assert index.nearest([index.vector(np.array([5], np.uint64), np.array([1]))], 15) == [[]]


# -- media


def test_media_round_trip(odd_docs, no_docs):
    rows = {i: r for i, r in enumerate(media.from_media(media.to_media(odd_docs.withColumn("doc_id", F.xxhash64("doc_id", "text")))).collect())}
    want = {}
    for r in odd_docs.withColumn("doc_id", F.xxhash64("doc_id", "text")).collect():
        raw = (r.text or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[r.doc_id] = (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.id] and r.error is None for r in rows.values())
    assert len(rows) == odd_docs.count() and media.from_media(media.to_media(no_docs)).count() == 0


def filtered(samples, kinds):
    """A PNG whose rows use the given filters, written from the definition."""
    h, w = samples.shape
    out = bytearray()
    for y in range(h):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x in range(w):
            a = int(samples[y, x - 1]) if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            guess = [0, a, b, (a + b) // 2, media._paeth(a, b, c)][kind]
            out.append((int(samples[y, x]) - guess) & 255)
    head = __import__("struct").pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    body = zlib.compress(bytes(out))
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", body[:7]) + media._chunk(b"IDAT", body[7:]) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0], [2, 2, 1, 1]])
def test_png_filters(kinds):
    samples = np.random.default_rng(3).integers(0, 256, (17, 23), dtype=np.uint8)
    data = filtered(samples, kinds)
    assert (media.decode_png(data) == samples).all()
    broken = bytearray(data)
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))
    for cut in (3, 20, len(data) - 5):
        with pytest.raises(ValueError):
            media.decode_png(data[:cut])


def test_hash_is_stable_under_noise():
    x = np.kron(np.random.default_rng(4).integers(20, 230, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    noisy = np.clip(x.astype(int) + np.random.default_rng(1).integers(-2, 3, x.shape), 0, 255).astype(np.uint8)
    a, b = int(media.perceptual_hash(x), 16), int(media.perceptual_hash(noisy), 16)
    assert (a ^ b).bit_count() <= 12 and media.perceptual_hash(np.zeros((1, 64), np.uint8)) == "0" * 16


# -- token shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_order_is_a_keyed_permutation(n):
    order = token_shards.Order(n)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.ordinals(slots) == np.arange(n)).all()
    if n >= 64:
        assert (slots != token_shards.Order(n, 99).slots(np.arange(n))).any() and (np.diff(slots) != 1).mean() > 0.9


def test_shards_round_trip(spark, odd_docs, no_docs, tmp_path):
    stored = token_shards.sequences(odd_docs, 64)
    ordered = token_shards.training_order(stored, 64, 50)
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 50 and r.offset == r.slot % 50 * 128 and len(r.record) == 128 for r in rows)
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.record, "<u2")
        assert (ids[r.n_tokens :] == token_shards.PAD).all() and (ids[: r.n_tokens] != token_shards.PAD).all()
        parts.setdefault(str(r.doc_id), []).append((r.seq_no, tuple(ids[: r.n_tokens].tolist())))
    want = {}
    for i, ids in all_ids(spark, odd_docs):  # null and repeated ids too
        want.setdefault(i, []).extend((k, tuple(ids[at : at + 64])) for k, at in enumerate(range(0, len(ids), 64)))
    assert {i: sorted(x) for i, x in parts.items()} == {i: sorted(x) for i, x in want.items()}
    files = token_shards.write_shards(ordered, str(tmp_path)).orderBy("shard").collect()
    assert [f.first_slot for f in files] == [50 * f.shard for f in files] and sum(f.records for f in files) == len(rows)
    by_slot = sorted(rows, key=lambda r: r.slot)
    read = list(token_shards.read_records(str(tmp_path), 45, 20, 64, 50))
    assert [x.tobytes() for x in read] == [r.record[: 2 * r.n_tokens] for r in by_slot[45:65]]
    assert token_shards.training_order(token_shards.sequences(no_docs)).count() == 0


def test_slots_follow_from_the_data_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 4, 8):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = token_shards.training_order(token_shards.sequences(docs.repartition(n)), shard_records=50)
            assert rows.rdd.getNumPartitions() <= 8  # many shards in a partition
            found.append(sorted((r.slot, r.shard, r.doc_id, r.seq_no, bytes(r.record)) for r in rows.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and found[0][-1][1] > 8


LONG = ["日本語の文章が続く" * 12_000, "日本語の文章。" * 12_000, "word\n" * 20_000, "tab\tseparated\twords\t" * 5000, "z" * 200_000, "a  b\n\n c" * 12_000, " " * 1_100_000 + "x", "don't 's 1234567 " * 6000]


def test_long_texts_get_the_ids_of_the_whole_text(spark):
    encoder = token_shards._encoder(token_shards.read_ranks(spark))
    for text in LONG:
        ids = token_shards.encode(text, encoder)
        assert ids[-1] == token_shards.END and encoder.decode(ids[:-1].tolist()) == text
        if len(text) < 1_000_000:
            assert ids[:-1].tolist() == encoder.encode(text, disallowed_special=())


def test_pieces_where_the_pattern_gives_up_are_the_same():
    class Broken:
        def encode_to_numpy(self, text, disallowed_special):
            raise ValueError

    with open(token_shards.RANKS, "rb") as f:
        encoder = token_shards._encoder(f.read())
    broken, rng = Broken(), random.Random(1)
    broken._encode_single_piece = encoder._encode_single_piece
    for _ in range(500):
        text = "".join(rng.choice("ab 's\n\t\x0b\x1c\x1d\x85\u3000日本。é١٢12!?__ll ve") for _ in range(rng.randint(0, 60)))
        assert token_shards.encode(text, broken).tolist()[:-1] == encoder.encode(text, disallowed_special=())


# -- licences


def test_licences(spark, no_docs):
    mit = dict(licenses.known_texts())["MIT"]
    body = mit.partition("\n\n")[2].partition("\n\n")[2]
    wrapped = body.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (3, "words\n\n  released under the *MIT* licence!\nmore"),
        (4, "Licensed under the Apache License, v2.0"), (5, None), (6, ""), (7, mit + " and more"), (8, "(c) x\nLicensed under CC BY-NC 4.0."), (None, mit), (1, "other"),
        (9, wrapped), (10, "The MIT License (MIT)\nCopyright 1999 A. Uthor\nAll rights reserved.\n" + body), (1, mit), (11, "x " * 300_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("q"), "digest": F.lit(1), "unit": F.lit(2), "tag": F.lit(3)})
    got = [(str(r.doc_id), r.license, tuple(r.notices)) for r in licenses.scan(docs).collect()]
    want = [
        ("1", "MIT", ()), ("2", "MIT", ()), ("3", None, ("MIT",)), ("4", "Apache-2.0", ("Apache-2.0",)), ("5", None, ()), ("6", None, ()), ("7", None, ()),
        ("8", "CC-BY-NC-4.0", ("CC-BY-NC-4.0",)), ("None", "MIT", ()), ("1", None, ()), ("9", "MIT", ()), ("10", "MIT", ()), ("1", "MIT", ()), ("11", None, ()),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(no_docs).count() == 0
    own = spark.createDataFrame([("House-1", "Ask first."), ("House-2", None), (None, "x")], "license string, text string")
    asked = spark.createDataFrame([(1, "ASK, first!"), (2, mit)], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(asked, own).collect()) == [(1, "House-1"), (2, None)]


def test_every_known_licence_is_found_as_a_whole_text(spark):
    known = licenses.known_texts()
    assert len({name for name, _ in known}) >= 20 and sum(len(t) > 1000 for _, t in known) >= 20
    rows = [(i, f"  {text.swapcase() if i % 2 else text}\n\n(c) 2001 x\n") for i, (_, text) in enumerate(known)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    named = {}
    for name, text in known:
        named.setdefault(licenses.canonical_text(text), set()).add(name)
    for i, (_, text) in enumerate(known):
        assert got[i].license == min(named[licenses.canonical_text(text)])
        assert got[i].digest == hashlib.sha256(licenses.canonical_text(text).encode()).hexdigest()
