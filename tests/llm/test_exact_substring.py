import hashlib
import random
from collections import defaultdict

import pytest

from siltstone.llm import exact_substring as X


def covered(texts, length):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].append((d, p))
    out = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                out[d][p : p + length] = b"\1" * length
    return out


def check(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if docs is None else docs
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, c in zip(rows, texts, covered(texts, 200), strict=True):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        want.append((str(i), len(t), sum(c), len([x for x in bytes(c).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in X.report(docs).collect()]
    assert sorted(got) == sorted(want)
    return want


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sum(w[2] for w in check(spark, rows, odd_docs)) > 0
    assert X.report(no_docs).count() == 0 and X.without_repeats(no_docs).columns == no_docs.columns
    cut = X.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(rows)
    assert cut.where("text IS NULL").count() == odd_docs.where("text IS NULL").count()


def test_random_and_periodic(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(60) for _ in range(20)]
    rows = [(i, prose(rng.randint(1, 200))) for i in range(60)]
    rows += [(100 + i, prose(rng.randint(0, 50)) + " " + rng.choice(base) + " " + prose(30) + rng.choice(base)[: rng.randint(100, 400)]) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "a" * 1000), (303, "ab" * 700), (304, "a" * 200), (305, "a" * 201), (306, "b" * 200), (307, rows[3][1]), (308, rows[3][1]), (309, ("xyz " * 30 + "q") * 6)]
    check(spark, rows)


def test_copies_with_edits(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(50)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for i in range(60):  # near copies of one text: many contexts of one boundary
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    check(spark, rows)


def test_wide_names_agree(spark):
    rng = random.Random(6)
    line = "".join(rng.choice("abcdef ") for _ in range(150))
    prose = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    ends = [prose(120) for _ in range(6)]
    rows = [(i, prose(100) + rng.choice(ends) + line + rng.choice(ends) + prose(50)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [
        {(r.k1, r.k2): X._merge([s.asDict() for s in r.spans], 200) for r in X.repeated_spans(docs, wide=wide).collect()} for wide in (3, X.WIDE)
    ]
    assert spans[0] == spans[1] and spans[0]
    check(spark, rows, docs)


@pytest.mark.parametrize("count", [2, 5])
def test_frequent_names_are_dealt_and_nothing_is_lost(spark, monkeypatch, count):
    monkeypatch.setattr(X, "HOT_COUNT", count)
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    line, ends = prose(190), [prose(150) for _ in range(4)]
    rows = [(i, prose(rng.randint(0, 150)) + rng.choice(ends) + line + rng.choice(ends) + prose(rng.randint(0, 90))) for i in range(50)]
    rows += [(100 + i, rows[0][1]) for i in range(12)] + [(200 + i, line * 3 + prose(i)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, phrases, *_ = X.frequent(docs.select(*X._key("doc_id", "text"), "text"), len(rows))
    assert len(names) > 3 and len(phrases) > 3
    check(spark, rows, docs)


def test_ids_of_other_kinds(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [prose(300) + " " + prose(40) for _ in range(8)]
    rows = [(f"d-{i}", t) for i, t in enumerate(texts)] + [(None, t + prose(9)) for t in texts[:4]] + [(None, texts[5]), ("d-5", texts[5]), ("d-1", "other text")]
    check(spark, rows, spark.createDataFrame(rows, "doc_id string, text string"))


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 700)
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc") for _ in range(5000)) + b"z" * 3000
    at, lo, hi, _ = X.anchors(text)
    starts = [p for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)]
    assert starts == list(range(len(text) - 199))
    assert ((at - lo < X.WINDOW) & (at >= hi)).all()


def test_suffix_order():
    parts = [b"banana", b"band", b"", b"ban", b"band", b"can"]
    order, common = X.suffix_order(parts)
    assert [parts[i] for i in order] == sorted(parts)
    assert common.tolist() == [0, 0, 3, 3, 4, 0]
