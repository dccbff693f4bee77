"""The pipeline against brute-force versions of its stages, each on its own input."""

import numpy as np
import pytest

from siltstone.llm import packing, token_shards
from test_exact_substring import covered
from test_near_copies import kept_by_brute_force

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF), "test-stage"))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_quality(spark, kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"
    ]
    assert all(x.columns == corpus_pipeline.COLUMNS for x in kept[:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(kept[0]), rows(kept[1])
    known = [(i in after) == bool(labels[i]) for i in before if i in labels]
    assert np.mean(known) > 0.95


def test_one_of_each_group(kept):
    before, after = rows(kept[1]), rows(kept[2])
    assert sorted(after) == kept_by_brute_force(list(before.items()))[0]


def test_repeats_are_cut(kept):
    before, after = rows(kept[2]), rows(kept[3])
    ids = sorted(before)
    texts = [before[i].encode() for i in ids]
    for i, t, c in zip(ids, texts, covered(texts, 200), strict=True):
        left = bytes(b for b, x in zip(t, c, strict=True) if not x).decode("utf-8", "ignore")
        assert after.get(i, "") == left and (i in after or t)


def test_contaminated_documents_go(spark, kept):
    from test_others import brute_hits

    before, after = rows(kept[3]), rows(kept[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {int(x[0]) for x in brute_hits(list(before.items()), items) if x[5]}
    assert set(after) == set(before) - hit


def test_everything_is_packed(spark, kept):
    encoder = token_shards._encoder(token_shards.read_ranks(spark))
    want = {i: [*encoder.encode(t or "", disallowed_special=()), token_shards.END] for i, t in rows(kept[4]).items()}
    parts = {}
    for r in kept[5].collect():
        assert r.capacity in packing.CAPACITIES
        ids, edges = np.frombuffer(r.tokens, "<u2").tolist(), [*r.offsets, r.n_tokens]
        for d, k, a, z in zip(r.doc_ids, r.pieces, edges[:-1], edges[1:], strict=True):
            parts.setdefault(d, []).append((k, ids[a:z]))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()} == want


def test_stages_take_odd_tables(spark, odd_table, no_docs):
    """Nulls, repeats, string ids, a long text and clashing names; and no rows at all."""
    for docs in (odd_table, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-odd")
            assert name == "best-fit packing" or docs.columns == corpus_pipeline.COLUMNS
