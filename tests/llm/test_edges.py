"""Every operator on one odd table: null, repeated and string ids, a text of a million
characters, empty and null texts, ties, clashing names; and on an empty table."""

import pytest

from siltstone.llm import decontaminate, exact_substring, licenses, media, near_copies, ngram_lm, packing, quality, simhash, token_shards, toxicity

LABELS = [(f"d-{i}", i % 2, i % 2) for i in range(20)] + [("d-3", None, 1), (None, 1, 1), ("d-4", 1, None), ("nobody", 1, 1)]
ITEMS = [("i-1", "a long text of some words"), (None, "a b"), ("i-2", None), ("i-2", "!!"), ("i-1", "a long text of some words")]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id string, quality int, toxic int")


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string").selectExpr("*", "1 AS key", "2 AS words", "3 AS n")


#: Name, function, and the id column of results that have one row a row of documents.
OPERATORS = [
    ("decontaminate", lambda s, d: decontaminate.report(d, items(s)), "doc_id"),
    ("packing", lambda s, d: packing.pack_documents(d), None),
    ("quality", lambda s, d: quality.classify(d, labels(s)), "doc_id"),
    ("quality keep", lambda s, d: quality.score(d, quality.fit_sample(d, labels(s))), "doc_id"),
    ("media", lambda s, d: media.from_media(media.to_media(d)), "id"),
    ("toxicity", lambda s, d: toxicity.classify(d, labels(s)), "doc_id"),
    ("ngram_lm", lambda s, d: ngram_lm.score_corpus(d), "doc_id"),
    ("token_shards", lambda s, d: token_shards.through_shards(d), None),
    ("exact_substring", lambda s, d: exact_substring.report(d), "doc_id"),
    ("exact_substring cut", lambda s, d: exact_substring.without_repeats(d), "doc_id"),
    ("simhash", lambda s, d: simhash.near_duplicates(d), "id"),
    ("simhash one", lambda s, d: simhash.one_of_each(d), None),
    ("near_copies one", lambda s, d: near_copies.one_of_each(d), None),
    ("licenses", lambda s, d: licenses.scan(d), "doc_id"),
]


@pytest.mark.parametrize(("name", "run", "id_col"), OPERATORS, ids=[x[0] for x in OPERATORS])
def test_odd_table(spark, odd_table, no_docs, name, run, id_col):
    rows = run(spark, odd_table).collect()
    ids = [r.doc_id for r in odd_table.select("doc_id").collect()]
    if id_col:
        assert sorted(map(str, (r[id_col] for r in rows))) == sorted(map(str, ids))
    assert rows
    if name in ("decontaminate", "quality", "toxicity", "ngram_lm", "exact_substring", "licenses"):
        twice = [r for r in rows if r.doc_id == "d-0"]  # repeated rows get equal results
        assert len(twice) == 2 and twice[0] == twice[1]
    assert run(spark, no_docs.selectExpr("cast(doc_id AS string) AS doc_id", "* EXCEPT (doc_id)")).count() == 0
