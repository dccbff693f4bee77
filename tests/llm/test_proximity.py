"""Words near each other: against plain Python, within the rows of the documents."""

import random
import re
from collections import Counter

from siltstone.llm import decontaminate as D


def brute(docs, items):
    lists = [(d, t, [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]) for d, t in docs if d is not None]
    freq = Counter(w for _, _, x in lists for w in x)
    out = Counter()
    for i, text in items:
        terms = sorted(set([w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w][: D.OPENING]), key=lambda w: (freq[w], w))
        for d, _, x in {(d, t): (d, t, x) for d, t, x in lists}.values():
            for p, w in enumerate(x):
                if i is not None and terms and w == terms[0] and all(t in x[max(0, p - D.SLOP) : p + D.SLOP + 1] for t in terms[1:]):
                    out[i, d] += 1
    return dict(out)


def case(spark):
    rng = random.Random(8)
    text = lambda n: rng.choice([" ", "", "--"]) + rng.choice([" ", ", "]).join(rng.choice(["The", "of", "and", "a"] + [f"w{i}" for i in range(60)]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 90))) for i in range(150)]
    docs += [docs[5], (5, docs[9][1]), (None, docs[3][1]), (900, None), (901, "")]
    items = [(i, text(rng.randint(1, 5))) for i in range(60)] + [(70, None), (71, "!"), (None, "the of"), (72, "nowhere the")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")


def test_openings_against_plain_python(spark, monkeypatch):
    docs, items, d, b = case(spark)
    want = brute(docs, items)
    assert len(want) > 500
    for name, value in (("PASS_WORDS", 50_000), ("PASS_WORDS", 40), ("AT_ONCE", 7)):
        monkeypatch.setattr(D, name, value)
        got = D.loose_openings(d, b).collect()
        assert {(r.item_id, r.doc_id): r.n_places for r in got} == want and len(got) == len(want)


def test_no_list_of_all_words_is_written(spark, monkeypatch):
    _, _, d, b = case(spark)
    written = []
    kept = D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, tag, *a: written.append((tag, kept(df, tag, *a))) or written[-1][1])
    found = D.loose_openings(d, b)
    found.collect()
    assert not {tag for tag, _ in written} & {"idx-postings", "near-places", "near-docs"} and sum(x.count() for _, x in written) < 600
