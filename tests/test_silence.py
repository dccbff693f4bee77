"""Debounce by silence on a live stream, against the same log in one batch."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import silence, watch

SCHEMA = "user string, ts timestamp, path string"


@pytest.fixture
def store(spark):
    name, value = silence.STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def put(spark, folder, rows):
    made = spark.createDataFrame([(u, float(s), p) for u, s, p in rows], "user string, s double, path string")
    made.select("user", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "path").coalesce(1).write.mode("append").parquet(folder)


def take(spark, stream, tmp_path, name):
    """Run over all that is there, and what has been handed on by then."""
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    try:
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
    except Exception:
        return []
    return sorted((r.user, r.start_us, r.end_us, tuple(r.paths), r.n) for r in rows)


def test_steady_events_hold_a_burst_back(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    log = [[("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], [("a", 6, "x"), ("b", 30, "q"), ("a", 9, None)], [("a", 12, "w"), ("b", 32, "z")], [("c", 500, "end")], [("c", 900, "end")]]
    put(spark, folder, log[0])
    stream = silence.debounce_stream(spark.readStream.schema(SCHEMA).parquet(folder), timedelta(seconds=4), "user", "30 seconds")
    assert take(spark, stream, tmp_path, 0) == []  # nothing has been silent for long enough
    got = []
    for rows in log[1:]:
        put(spark, folder, rows)
        before, got = got, take(spark, stream, tmp_path, 0)
        assert set(before) <= set(got)
    whole = spark.read.schema(SCHEMA).parquet(folder)
    want = watch.debounce(whole, "4 seconds", "user").where("user <> 'c'")
    want = sorted((r.user, r.s, r.e, tuple(r.paths), r.n) for r in want.select("user", F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"), "paths", "n").collect())
    assert [x for x in got if x[0] != "c"] == want and ("a", 1_000_000, 16_000_000, ("w", "x", "y"), 5) in want


def test_by_the_clock(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", 1, "x"), ("a", 2, "y")])
    stream = silence.debounce_stream(spark.readStream.schema(SCHEMA).parquet(folder), timedelta(seconds=2), "user", by_clock=True)
    query = stream.writeStream.format("memory").queryName("held_back").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.table("held_back").count():
            time.sleep(0.5)
        assert [(r.user, r.paths, r.n) for r in spark.table("held_back").collect()] == [("a", ["x", "y"], 2)]
    finally:
        query.stop()
