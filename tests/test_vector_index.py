"""The stored vector index against brute force: exact and by a number of cells."""

import numpy as np
import pytest

from siltstone.operators import search as S
from siltstone.operators import vector_index as X


def clustered(n, groups=12, width=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    return (centres[rng.integers(groups, size=n)] + rng.normal(size=(n, width)) * 0.3).round(3)


def brute(items, queries, k, width):
    unit = lambda v: np.zeros(width) if v is None or len(v) != width or not np.linalg.norm(v) else np.array(v, float) / np.linalg.norm(v)
    x = np.array([unit(v) for _, v in items])
    out = []
    for qid, v in queries:
        far = (1 - x @ unit(v)).round(12)
        for rank, i in enumerate(sorted(range(len(items)), key=lambda i: (far[i], items[i][0]))[:k], 1):
            out.append((qid, rank, items[i][0], round(max(0.0, 1 - far[i]), 9)))
    return sorted(out)


def found(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    x = clustered(1500)
    items = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in items], "id int, vector array<double>, label int").repartition(5)
    return items, X.build(df, str(tmp_path_factory.mktemp("ix") / "vectors"))


def asked(spark, items, step):
    queries = [(i, v) for i, v in items if i % step == 0]
    return queries, spark.createDataFrame(queries, "qid int, vector array<double>")


def test_exact_and_by_a_part_of_the_cells(spark, table):
    items, index = table
    queries, df = asked(spark, items, 100)
    assert found(index.search(df, 7)) == brute(items, queries, 7, 16)
    near = index.cells
    q = X._units([v for _, v in queries], 16)
    assert len(near.numbers) > 20
    read = set()  # the cells that hold what the bounds let through, by the definition
    for u, (_, rank, _, score) in zip(np.repeat(q, 7, axis=0), brute(items, queries, 7, 16), strict=True):
        if rank == 7:
            read |= set(near.numbers[near.reach(u[None])[1][0] <= 1 - score + 1e-6])
    assert len(read) < len(near.numbers)
    plan = index.search(df.where("qid = 0"), 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters", 1)[1][:200]


def test_filtered(spark, table):
    items, index = table
    queries, df = asked(spark, items, 250)
    assert found(index.where("label = 1").search(df, 5)) == brute([x for x in items if x[0] % 3 == 1], queries, 5, 16)


def test_recall_of_probes(spark, table):
    items, index = table
    queries, df = asked(spark, items, 20)
    want = {x[:3:2] for x in brute(items, queries, 10, 16)}
    got = {(r.qid, r.id) for r in index.search(df, 10, probes=8).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_blocks_of_a_cell_that_holds_nearly_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ITEMS", 50)
    monkeypatch.setattr(X, "BLOCK_QUERIES", 10)
    x = clustered(400, groups=2, width=6)
    x[:250] = x[0]  # very many equal ones
    items = [(f"i{i:03d}", v.tolist()) for i, v in enumerate(x)]
    index = X.build(spark.createDataFrame(items, "id string, vector array<double>"), str(tmp_path / "v"), cells=5)
    queries = [(i, v) for i, (_, v) in enumerate(items) if i % 8 == 0]
    assert found(index.search(spark.createDataFrame(queries, "qid int, vector array<double>"), 9)) == brute(items, queries, 9, 6)


def test_vectors_without_a_direction(spark, tmp_path):
    items = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.2]), (6, []), (7, [3.0, 3.0])]
    queries = [(0, [1.0, 0.1]), (1, None), (2, [1.0, 2.0, 3.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])]
    df, qs = spark.createDataFrame(items, "id int, vector array<double>"), spark.createDataFrame(queries, "qid int, vector array<double>")
    want = brute(items, queries, 4, 2)
    assert found(X.build(df, str(tmp_path / "v")).search(qs, 4)) == want
    assert found(S.vector_topk(df, qs, 4)) == want  # the plain scan judges widths alike


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id int, vector array<double>")
    some = spark.createDataFrame([(1, [1.0])], "qid int, vector array<double>")
    assert X.build(none, str(tmp_path / "v")).search(some, 3).count() == 0
    one = X.build(spark.createDataFrame([(1, [2.0])], "id int, vector array<double>"), str(tmp_path / "w"))
    assert one.search(some.where("qid = 9"), 3).count() == 0 and found(one.search(some, 3)) == [(1, 1, 1, 1.0)]
