import numpy as np

from siltstone import config
from siltstone.operators import embed as E
from siltstone.operators.code import code_errors
from siltstone.plans.jobs import Jobs, ingest_rate


def test_layers(tmp_path):
    for name, text in (("a", "SILTSTONE_EMBED_BATCH_SIZE=8\nSILTSTONE_STORE='x y'\n# SILTSTONE_STORE=no"), ("b", "export SILTSTONE_EMBED_BATCH_SIZE=16\njunk")):
        (tmp_path / name).mkdir()
        (tmp_path / name / ".env").write_text(text)
    got = config.load(str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none"), environ={"SILTSTONE_INCLUDE_PATTERNS": " src/ ,, /docs"})
    assert (got.embed_batch_size, got.store, got.includes, got.max_file_bytes) == (16, "x y", ["src", "docs"], 800_000)
    assert ".py" in got.extensions


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "hello world")], "id int, text string")
    rows = {r.id: r.embedding for r in E.with_embedding(docs).collect()}
    assert rows[1] == rows[4] and len(rows[1]) == E.DIMENSION and np.isclose(np.linalg.norm(rows[1]), 1)
    assert not any(rows[2]) and not any(rows[3])
    assert E.info()["norm"] == 1.0 and E.backend("hashing") is E.HashingEmbedder and callable(E.backend("auto", "m"))


def test_quarantine(spark):
    files = spark.createDataFrame([("a.py", "x = ("), ("b.py", "y = 1"), ("c.md", "("), ("d.py", "\0")], "path string, content string")
    assert sorted((r.path, r.exc_type) for r in code_errors(files).collect()) == [("a.py", "SyntaxError"), ("d.py", "SyntaxError")]


def test_jobs(spark):
    jobs = Jobs(spark)

    def work(job, n):
        note = jobs.progress(job)
        for i in range(n):
            note("upsert_batch", {"written": i * 10, "total": 40})
        return n

    good, bad = jobs.run("a", work, n=4), jobs.run("b", lambda job: 1 / 0)
    assert (jobs.status(good)["status"], jobs.status(good)["result"]) == ("completed", 4)
    assert jobs.status(bad)["status"] == "failed" and "ZeroDivisionError" in jobs.status(bad)["error"]
    assert jobs.status(bad)["finished_at"] and not jobs.stop(bad) and not jobs.stop("none")
    assert [r.action for r in jobs.recent(1).collect()] == ["b"]
    assert jobs.progress_events().where("stage = 'upsert_batch'").count() == 4
    events = spark.createDataFrame([("j", "s", float(i), i * 10, 100) for i in range(5)], "job_id string, stage string, t double, written long, total long")
    last = ingest_rate(events).orderBy("t").collect()[-1]
    assert (last.rate, last.percent, last.eta) == (10.0, 40.0, 6.0)
