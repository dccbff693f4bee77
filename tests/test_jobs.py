"""The two jobs: growing input, failure in the middle, a second run, the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import find_passages, ingest_documents
from jobs.settings import read

REPO = Path(__file__).resolve().parent.parent
SCHEMA = ingest_documents.KNOWN["schema"]


def put(spark, folder, rows):
    """One more file in the folder."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def settings(tmp_path, **more):
    return {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark"), **more}


def chunks_of(rows):
    """(doc_id, ord, start, end, block) of blocks between blank lines, per document."""
    out = []
    for i, text, *_ in rows:
        lines, block, n = (text or "").split("\n"), [], 0
        for k, line in enumerate([*lines, ""], 1):
            if line.strip():
                block.append(line)
            elif block:
                out.append((i, n, k - len(block), k - 1, "\n".join(block).strip()))
                block, n = [], n + 1
    return sorted(out)


def stored(spark, at):
    rows = ingest_documents.current(spark, at).collect()
    return sorted((r.doc_id, r.ord, r.start_line, r.end_line, r.text.split("\n\n", 1)[1]) for r in rows)


FIRST = [(i, f"one {i}\ntwo\n\nthree {i}", "en" if i % 2 else None, "s") for i in range(6)] + [(None, "no id", "en", "s")]
SECOND = [(7, "seven\n\n \nagain", "fr", "s"), (2, "changed", "en", "s"), (3, FIRST[3][1], "en", "s"), (4, "", None, "s"), (8, None, "en", "s")]
NOW = [r for r in FIRST if r[0] not in (None, 2, 4)] + SECOND[:2]


def test_only_new_files_are_taken(spark, tmp_path):
    at = settings(tmp_path)
    put(spark, at["input"], FIRST)
    assert ingest_documents.run(spark, at) == {"read": 7, "documents": 6, "chunks": 12}
    assert stored(spark, at) == chunks_of(FIRST[:6])
    put(spark, at["input"], SECOND)
    assert ingest_documents.run(spark, at) == {"read": 5, "documents": 4, "chunks": 3}  # 3 came again as it was
    assert stored(spark, at) == chunks_of(NOW)
    assert ingest_documents.run(spark, at) == {"read": 0, "documents": 0, "chunks": 0}
    assert stored(spark, at) == chunks_of(NOW)
    folders = {p.parent.relative_to(tmp_path / "out" / "chunks").as_posix() for p in (tmp_path / "out" / "chunks").rglob("*.parquet") if "batch=" in str(p)}
    assert folders == {"batch=0/lang=en", "batch=0/lang=unknown", "batch=1/lang=en", "batch=1/lang=fr"}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_a_batch_that_failed_half_way_is_done_again(spark, tmp_path, monkeypatch):
    at = settings(tmp_path, files=1)
    put(spark, at["input"], FIRST)
    read_back, calls = ingest_documents._stored, []

    def fails(spark_, known, name):
        calls.append(name)
        if name == "chunks":
            raise RuntimeError("lost")  # the chunks are written, the documents are not
        return read_back(spark_, known, name)

    with monkeypatch.context() as m:
        m.setattr(ingest_documents, "_stored", fails)
        with pytest.raises(Exception, match="lost"):
            ingest_documents.run(spark, at)
    assert calls == ["documents", "chunks"] and stored(spark, at) == []
    put(spark, at["input"], SECOND)
    assert ingest_documents.run(spark, at)["read"] == 12
    assert stored(spark, at) == chunks_of(NOW)


def test_an_empty_folder_gives_empty_tables(spark, tmp_path):
    at = settings(tmp_path)
    put(spark, at["input"], [])
    assert ingest_documents.run(spark, at) == {"read": 0, "documents": 0, "chunks": 0}
    assert stored(spark, at) == []


def tables(spark, tmp_path):
    docs = [(i, f"alpha beta {'gamma ' * (i % 3)}\n\ndelta {i} beta", ["en", "fr", None][i % 3], "s") for i in range(9)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, "gamma delta"), (2, "nowhere"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    return {"documents": str(tmp_path / "docs"), "questions": str(tmp_path / "asked"), "output": str(tmp_path / "found")}


def test_passages_and_a_second_run(spark, tmp_path):
    at = tables(spark, tmp_path) | {"k": 4, "candidates": 18}
    assert find_passages.run(spark, at) == {"documents": 9, "questions": 3, "written": 4}
    first = sorted(find_passages.result(spark, at).collect())
    assert {r.qid for r in first} == {1} and sorted(r["rank"] for r in first) == [1, 2, 3, 4]
    assert all(("gamma" in r.preview) != ("delta" in r.preview) and r.overlap >= 1 for r in first)
    find_passages.run(spark, at)
    assert sorted(find_passages.result(spark, at).collect()) == first


def test_the_command_line(spark, tmp_path):
    at = tables(spark, tmp_path)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"k": 2, "documents": at["documents"]}))
    command = [sys.executable, "-m", "jobs.find_passages", "--config", str(config), "--questions", at["questions"], "--output", at["output"]]
    done = subprocess.run(command, cwd=REPO, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote 2 passages" in done.stderr and find_passages.result(spark, at).count() == 2


def test_settings_that_nobody_reads_are_an_error(tmp_path):
    (tmp_path / "c.json").write_text('{"kk": 1}')
    with pytest.raises(ValueError, match="kk"):
        read(str(tmp_path / "c.json"), find_passages.KNOWN)
    for name, module in (("ingest_documents", ingest_documents), ("find_passages", find_passages)):
        read(str(REPO / "jobs" / f"{name}.json"), module.KNOWN)
