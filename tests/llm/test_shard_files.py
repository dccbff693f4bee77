"""op7 goes through shard files: its records are what the files hold."""

from pathlib import Path

from siltstone.llm import queries, token_shards

SF = "/root/testdata/sf0.001"


def test_query_reads_the_shards_it_wrote(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "shards")
    monkeypatch.setattr(token_shards, "shared_path", lambda spark, tag: folder)
    got = queries.op7_token_shards(spark, SF)
    want = token_shards.training_order(token_shards.sequences(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got.columns == want.columns
    rows = sorted(got.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and len(rows) == want.count()
    files = sorted(Path(folder).glob("shard-*.bin"))
    data = b"".join(f.read_bytes() for f in files)
    assert data == b"".join(bytes(r.record) for r in rows)
    files[0].write_bytes(bytes(512) + files[0].read_bytes()[512:])
    changed = [r.slot for r in queries.token_shards.from_shards(token_shards.sequences(spark.read.parquet(f"{SF}/documents.parquet")), folder).collect() if bytes(r.record) == bytes(512)]
    assert changed == [0]
