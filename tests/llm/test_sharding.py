"""Shards and slots against rendezvous hashing written from its definition."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import sharding as H


def draw(key, shard, weight):
    number = int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16)
    return -weight / math.log((number + 0.5) / 16**13)


def brute(key, weights):
    return max((s for s, w in enumerate(weights) if w > 0), key=lambda s: (draw(key, s, weights[s]), -s))


@pytest.mark.parametrize("weights", [H.WEIGHTS, (1.0, 0.0, 3.0), (2.0,), (0.5, 0.25) * 20])
def test_shards_are_those_of_the_definition(spark, weights):
    ids = spark.range(400).selectExpr("id AS doc_id")
    got = {r.doc_id: r.shard for r in H.assign(ids, weights).collect()}
    assert got == {i: brute(str(i), weights) for i in range(400)}


def test_weights_that_mean_nothing_are_refused():
    for weights in ((), (0.0, 0.0), (1.0, -1.0)):
        with pytest.raises(ValueError):
            H.winner(F.lit("x"), weights)


def test_few_records_move(spark):
    ids = spark.range(20_000).selectExpr("id AS doc_id")
    of = lambda weights: {r.doc_id: r.shard for r in H.assign(ids, weights).collect()}
    eight, nine, heavier, less = of(H.WEIGHTS), of((*H.WEIGHTS, 1.0)), of((*H.WEIGHTS[:3], 2.0, *H.WEIGHTS[4:])), of((*H.WEIGHTS[:5], 0.0, 1.0, 1.0))
    moved = [i for i in eight if eight[i] != nine[i]]
    assert {nine[i] for i in moved} == {8} and abs(len(moved) / 20_000 - 1 / 9) < 0.01  # into the new one alone
    assert {heavier[i] for i in eight if eight[i] != heavier[i]} == {3}
    assert {eight[i] for i in eight if eight[i] != less[i]} == {5} and 5 not in less.values()
    sizes = Counter(heavier.values())
    assert abs(sizes[3] / 20_000 - 2 / 9) < 0.015 and all(abs(sizes[s] / 20_000 - 1 / 9) < 0.01 for s in range(8) if s != 3)


def check(rows, docs, weights=H.WEIGHTS):
    """Each row's values, and slots from 0 without gaps in every shard."""
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = []
    for i, t in docs:
        text, key = (t or "").encode(), "" if i is None else str(i)
        want.append((str(i), len(text) + 1, zlib.crc32(text), "key", brute(key, weights), brute(key, (*weights, 1.0))))
    assert sorted((str(r[0]), r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == sorted(want)


def test_odd_documents(spark, odd_docs, odd_table, no_docs):
    for docs in (odd_docs, odd_table):
        check(H.place(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert H.place(no_docs).count() == 0
    assert {r.grown_shard for r in H.place(odd_docs, grown=None).collect()} == {None}


def test_slots_follow_the_digest_and_from_nothing_else(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = H.place(docs).collect()
    digest = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16)
    for s in range(8):
        ids = [r.doc_id for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        assert ids == sorted(ids, key=digest)
    dealt = H.place(docs.repartition(7, "text").orderBy(F.desc("text"))).collect()
    assert sorted(rows) == sorted(dealt)


def test_one_key_with_most_rows_is_dealt_over_tasks(spark):
    docs = spark.range(4000).selectExpr("if(id < 3000, 7, id) AS doc_id", "if(id < 3000, 'same', cast(id AS string)) AS text")
    rows = H.place(docs)
    check(rows.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    laid = spark.read.parquet(next(p for p in rows.inputFiles()).rpartition("/")[0])
    assert laid.where("id = 7").select("part").distinct().count() > 1


def test_written_shards_hold_every_row_once(spark, odd_docs, tmp_path):
    H.write(odd_docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "lang").collect())) == sorted(map(str, odd_docs.select("doc_id", "text", "lang").collect()))
    assert all(r.shard == brute("" if r.doc_id is None else str(r.doc_id), H.WEIGHTS) for r in back.collect())


def test_a_column_called_shard_gives_way(spark):
    found = H.assign(spark.range(3).selectExpr("id AS doc_id", "'x' AS SHARD", "1 AS weight"))
    assert [c.lower() for c in found.columns] == ["doc_id", "shard", "weight"] and dict(found.dtypes)[found.columns[1]] == "int"
