"""Tree source, store and sync on temporary trees."""

import os

import pytest

from siltstone.api import Engine
from siltstone.plans import store as K
from siltstone.plans import sync as Y
from siltstone.sources import tree
from siltstone.sources.ignore import IgnoreRules
from siltstone.streaming import watch as R


def put(root, path, text="x = 1\n"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


@pytest.fixture
def project(tmp_path):
    root = str(tmp_path / "proj")
    for p in ["pkg/__init__.py", "pkg/n.py", "pkg/UP.PY", "pkg/_priv/y.py", ".env", ".hid/z.py", "node_modules/x.js", "a.egg-info/t.txt", "logs/a.txt", "keep.md"]:
        put(root, p)
    put(root, "big.txt", "y" * 800_001)
    put(root, ".gitignore", "# c\nlogs/\n*.css\n!keep.css\n")
    put(root, "x.css")
    put(root, "keep.css")
    return root


LISTED = ["pkg/__init__.py", "pkg/n.py", "pkg/UP.PY", "pkg/_priv/y.py", ".env", ".hid/z.py", "big.txt", "keep.md", "keep.css"]


def test_listing(spark, project):
    got = [r.path for r in tree.list_files(spark, project).collect()]
    assert sorted(got) == sorted(LISTED)
    assert {r.path for r in tree.list_files(spark, project, ["pkg", "*.md", "pkg/n.py", "node_modules/*.js", ".env"]).collect()} == {
        "pkg/__init__.py", "pkg/n.py", "pkg/UP.PY", "pkg/_priv/y.py", "keep.md", ".env",
    }
    small = tree.list_files(spark, project, content=True, max_file_bytes=tree.MAX_FILE_BYTES).collect()
    assert "big.txt" not in {r.path for r in small} and {r.content for r in small} == {"x = 1\n"}
    assert [r.path for r in tree.list_files(spark, project, limit=2).collect()] == sorted(LISTED)[:2]
    assert tree.list_files(spark, project).where("path = 'pkg/n.py'").count() == 1
    with pytest.raises(PermissionError):
        tree.read_file(project, "../secret")


@pytest.mark.parametrize(("rules", "path", "want"), [
    ("*.log", "a/b.log", True), ("/a.log", "b/a.log", False), ("build/", "build", False), ("build/", "x/build/y", True), ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True), ("a/*", "a/x/y", True), ("**/t", "q/t", True), ("d/**", "d/x", True), ("*.py\n!k.py", "k.py", False),
    ("[!a].c", "b.c", True), ("[!a].c", "a.c", False), ("\\#x", "#x", True), ("a?c", "a/c", False), ("", "x", False),
])
def test_ignore(rules, path, want):
    assert IgnoreRules(rules).ignored(path) is want


def test_diff(spark):
    frame = lambda rows: spark.createDataFrame(rows, Y.MANIFEST)
    changes = Y.diff(frame([("a", 1, 10), ("b", 2, 10), ("d", 1, 5)]), frame([("a", 1, 10), ("b", 1, 10), ("c", 1, 10)]))
    assert {r.path: r.change for r in changes.collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}
    assert Y.change_counts(changes).first().changed_ratio == 1.0


def rows_of(engine, key, collection="code"):
    _, store = engine._store(key)
    return sorted((r.path, r.id, r.text) for r in store.read(collection).collect())


def test_sync_modes_and_engine(spark, project, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    key = engine.register_project(project).key
    run = lambda **o: engine.get_job_status(engine.ingest_project(key, wait=True, **o))["result"]
    first = run()
    assert (first["mode"], first["reason"]) == ("full", "missing_manifest")
    assert run()["mode"] == "noop"
    put(project, "pkg/n.py", "def f():\n    return 'needle'\n")
    put(project, "new.md", "# One\ntext\n# Two\nmore")
    os.remove(os.path.join(project, "keep.md"))
    third = run()
    assert (third["mode"], third["counts"]["n_new"], third["counts"]["n_changed"], third["counts"]["n_deleted"]) == ("incremental", 1, 1, 1)
    after = rows_of(engine, key)
    assert not any(p == "keep.md" for p, _, _ in after) and sum(p == "new.md" for p, _, _ in after) == 2
    assert run(force_full=True)["reason"] == "force_full"
    assert rows_of(engine, key) == after  # incremental and full agree
    engine.reset(key, "code")
    assert run()["reason"] == "empty_collection"
    hits = engine.search(key, "needle", 3, hybrid=True, rerank_results=True)
    assert hits[0]["meta"]["path"] == "pkg/n.py"
    got = engine.fetch_chunks([hits[0]["id"], "nope"])
    assert got["missing"] == ["nope"] and "needle" in got["found"][0]["doc"]
    os.remove(os.path.join(project, "new.md"))
    engine.ingest_paths(key, ["new.md"])
    assert not any(p == "new.md" for p, _, _ in rows_of(engine, key))
    assert engine.project_status(key)["collection_docs"] == len(rows_of(engine, key))
    assert engine.scan_project(key)["by_extension"][".py"] == 5
    assert engine.plan_ingest(key)["files_skipped"] == 1
    assert engine.list_recent_jobs(2).count() == 2
    assert engine.rebuild_manifest(key) > 0
    with pytest.raises(PermissionError):
        engine.project_status("")
    with pytest.raises(KeyError):
        engine.project_status("other")
    assert "needle" in engine.resource("file/pkg/n.py", key)


def test_items(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    key = engine.register_project(str(tmp_path)).key
    items = [{"text": "a", "id": "1", "metadata": {"path": "p", "start_line": 3, "who": "me"}}, {"text": "b", "id": "1", "metadata": {"path": "p"}}, {"text": "c", "collection": "x"}]
    assert engine.ingest_items(key, items)["by_collection"] == {"docs": 2, "x": 1}
    _, store = engine._store(key)
    assert [(r.id, r.text) for r in store.read("docs").collect()] == [("1", "b")]
    assert engine.ingest_items(key, [{"text": "z", "id": "9", "metadata": {"path": "p", "k": 1}}], replace_by_path=True)["replaced"] == {"docs": ["p"]}
    row = store.read("docs").first()
    assert (row.id, row.extra) == ("9", {"k": "1"})
    assert engine.ingest_texts(key, ["t1", "t2"]) == 2 and store.count("docs") == 3
    engine.delete_paths(key, ["p"], "docs")
    assert store.count("docs") == 2 and [r.text for r in store.get("x").collect()] == ["c"]
    for bad in ([], [{"text": 1}], ["x"]):
        with pytest.raises(ValueError):
            engine.ingest_items(key, bad)
    with pytest.raises(ValueError):
        engine.ingest_texts(key, [])


def test_replace_leaves_no_orphans(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "id string, path string")
    new = spark.createDataFrame([("5", "a")], "id string, path string")
    gone = spark.createDataFrame([("b",)], "path string")
    assert sorted(r.id for r in K.replace_by_path(old, new, gone).collect()) == ["4", "5"]


def test_watch(spark, project, tmp_path):
    seen = []
    go = lambda: R.watch(spark, project, lambda paths, _: seen.append(paths), str(tmp_path / "ck"), trigger={"availableNow": True})
    q = R.watch(spark, project, lambda paths, _: seen.append(paths), str(tmp_path / "ck"), trigger={"processingTime": "1 seconds"})
    q.processAllAvailable()
    assert sorted(seen[0]) == sorted(LISTED)
    put(project, "fresh.md")
    os.remove(os.path.join(project, "keep.md"))
    q.processAllAvailable()
    q.stop()
    assert sorted(x for s in seen[1:] for x in s) == ["fresh.md", "keep.md"]
    del go


def test_debounce(spark):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:03", "b"), ("2024-01-01 00:00:06", "a"), ("2024-01-01 00:00:20", "c")]
    events = spark.createDataFrame(rows, "ts string, path string").selectExpr("cast(ts as timestamp) ts", "path")
    assert [(r.paths, r.n) for r in R.debounce(events).orderBy("start").collect()] == [(["a", "b"], 3), (["c"], 1)]


ROWS = "id string, text string, path string"


def test_pointer_is_never_missing_and_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    one, two = (K.ChunkStore(spark, str(tmp_path), "p") for _ in range(2))
    frame = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    one.write("c", frame(("1", "a b", "x"), ("2", "b", "y"), ("3", "c c c", None)))
    before = two._state("c")
    monkeypatch.setattr(two, "_state", lambda c: before)  # the second writer began from the same state
    one.upsert("c", frame(("2", "B", "y")))
    with pytest.raises(K.ConcurrentWrite):
        two.upsert("c", frame(("1", "lost", "x")))
    monkeypatch.undo()
    assert sorted((r.id, r.text) for r in one.read("c").collect()) == [("1", "a b"), ("2", "B"), ("3", "c c c")]
    # A writer that breaks off before or while its pointer is made leaves the old state.
    monkeypatch.setattr(one.files, "create_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        one.write("c", frame(("9", "x", "x")))
    (tmp_path / "project=p/collection=c/_pointers/0000000009.json").write_text('{"generat')
    assert two.generation("c") == 2 and two.count("c") == 3
    for _ in range(3):
        two.upsert("c", frame(("1", "again", "x")))
    assert two.count("c") == 3 and two.lexical("c").n == 3
    assert len(list((tmp_path / "project=p/collection=c").glob("rows-*/b=*"))) <= 3 + 2 + 3  # old buckets are gone


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = K.ChunkStore(spark, str(tmp_path), "p")
    store.write("c", spark.createDataFrame([(str(i), f"word{i}", f"f{i}") for i in range(300)], ROWS))
    before = store._state("c")["buckets"]
    store.upsert("c", spark.createDataFrame([("5", "moved", "f5")], ROWS), replace=True)
    after = store._state("c")["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and store.count("c") == 300
    store.upsert("c", spark.createDataFrame([("7", "other place", "g7")], ROWS))  # the id leaves its old bucket
    assert [(r.path, r.text) for r in store.get("c", ids=["7"]).collect()] == [("g7", "other place")]


def test_last_of_equal_ids_wins(spark, tmp_path):
    rows = [("1", f"v{i}", "p", i) for i in range(50)]
    items = spark.createDataFrame(rows, ROWS + ", n int").repartition(7)
    assert K.upsert(items.limit(0).drop("n"), items, "n").first().text == "v49"
    first = {K.last_by_id(items.drop("n").repartition(n)).first().text for n in (1, 3, 8)}
    assert len(first) == 1


def test_full_ingest_goes_on_where_it_stopped(spark, tmp_path):
    root = str(tmp_path / "proj")
    for i in range(24):
        put(root, f"f{i}.txt", f"text {i}")
    store, stop, parts = K.ChunkStore(spark, str(tmp_path / "s"), "p"), [], []
    note = lambda stage, x: stage == "upsert_batch" and (parts.append(x["written"]), len(parts) == 2 and stop.append(1))
    sync = Y.Sync(spark, store, root, flush_files=6, progress=note, should_stop=lambda: bool(stop))
    report = sync.run()
    assert report.mode == "stopped" and 0 < report.files < 24 and report.seen == 24
    paused = sync.paused("code")
    assert paused["files_done"] == report.files == store.read("code").select("path").distinct().count() and paused["files_total"] == 24
    assert sync.manifest("code").count() == report.files
    stop.clear()
    again = sync.run()
    assert (again.mode, again.reason) == ("incremental", "resume") and again.counts["n_new"] == 24 - report.files
    assert sync.paused("code") is None and store.read("code").select("path").distinct().count() == 24
    assert sync.run().mode == "noop"


def test_stop_in_the_middle_leaves_a_marker(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "proj")
    put(root, "a.txt", "a")
    stop = []
    store = K.ChunkStore(spark, str(tmp_path / "s"), "p")
    sync = Y.Sync(spark, store, root, should_stop=lambda: bool(stop))

    def cancelled(*args):
        stop.append(1)
        raise RuntimeError("job cancelled")

    monkeypatch.setattr(store, "write", cancelled)
    assert sync.run().mode == "stopped" and sync.paused("code")["during"] == "RuntimeError"
    stop.clear()
    with pytest.raises(RuntimeError):  # a failure that is no stop stays one
        monkeypatch.setattr(store, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("disk")))
        sync.run()


def test_settings_and_an_index_inside_the_tree(spark, tmp_path):
    from siltstone.config import Settings

    root = str(tmp_path / "proj")
    put(root, "a.py", "def f(:\n")
    put(root, "b.txt", "some text")
    put(root, "c.zz", "other")
    put(root, "big.zz", "y" * 500)
    engine = Engine(spark, settings=Settings(store=f"{root}/index", allowed_extensions=".py,.zz", max_file_bytes=100))
    key = engine.register_project(root).key
    run = lambda: engine.get_job_status(engine.ingest_project(key, wait=True))["result"]
    first = run()
    assert {p for p, _, _ in rows_of(engine, key)} == {"a.py", "c.zz"}  # nothing of the index itself
    assert (first["seen"], first["files"], first["skipped"], first["errors"]) == (3, 2, 1, 1)
    assert [(r.path, r.exc_type) for r in engine.ingest_errors(key).collect()] == [("a.py", "SyntaxError")]
    assert [run()["mode"] for _ in range(2)] == ["noop", "noop"]
    assert engine.plan_ingest(key) == {"files_scanned": 3, "files_planned": 2, "files_skipped": 1, "chunks": 3}


def test_engine_watches(spark, tmp_path):
    root = str(tmp_path / "proj")
    put(root, "a.md", "# one\ntext")
    engine = Engine(spark, str(tmp_path / "s"))
    key = engine.register_project(root).key
    engine.ingest_project(key, wait=True)
    q = engine.watch(key, str(tmp_path / "ck"), trigger={"processingTime": "1 seconds"})
    q.processAllAvailable()
    put(root, "b.md", "# needle\nmore")
    os.remove(os.path.join(root, "a.md"))
    q.processAllAvailable()
    q.stop()
    assert {p for p, _, _ in rows_of(engine, key)} == {"b.md"}
    engine.search(key, "needle", hybrid=True)
    engine.rerank("needle", ["a", "needle"])
    actions = [r.action for r in engine.list_recent_jobs(10).collect()]
    assert {"search", "rerank", "ingest_project"} <= set(actions)


def test_finished_jobs_are_bounded(spark):
    from siltstone.plans.jobs import RECENT, Jobs

    jobs = Jobs(spark)
    for i in range(RECENT + 30):
        jobs.call("x", lambda i=i: [i])
    assert len(jobs.rows) <= RECENT + 1
    with pytest.raises(ZeroDivisionError):
        jobs.call("bad", lambda: 1 / 0)
    assert [r["status"] for r in jobs.rows.values()][-1] == "failed"


def test_drive_paths():
    assert tree.local_path("C:\\src\\x") == "/mnt/c/src/x" and tree.local_path("/a/b") == "/a/b" and tree.local_path("d:/q", "/m") == "/m/d/q"


def test_difference_by_digests(spark):
    import random

    from siltstone.plans import sync as Y

    rng = random.Random(4)
    rows = [(f"d{i % 7}/f{i}", rng.choice([i, None]), rng.choice([i, None])) for i in range(3000)]
    then = dict((p, (m, s)) for p, m, s in rows)
    now = dict(then)
    for p in rng.sample(sorted(now), 6):
        del now[p]
    for p in rng.sample(sorted(now), 7):
        now[p] = (now[p][1], 99)
    now |= {"new/a": (1, 2), "new/b": (None, None)}
    table = lambda x: spark.createDataFrame([(p, *v) for p, v in x.items()], Y.MANIFEST)
    want = {p: "new" if p not in then else "deleted" if p not in now else "same" if now[p] == then[p] else "changed" for p in then | now}
    got = Y.diff(table(now), table(then)).collect()
    assert {r.path: r.change for r in got} == want and len(got) == len(want)
    same = Y.diff(table(then), table(then))
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString()  # digests were all that was shuffled
    assert {r.change for r in same.collect()} == {"same"} and same.count() == 3000
    assert {r.change for r in Y.diff(table(now), table({})).collect()} == {"new"}
    assert {r.change for r in Y.diff(table({}), table(now)).collect()} == {"deleted"}


def test_failures_stay_listed_until_the_file_is_mended_or_gone(spark, tmp_path):
    root = str(tmp_path / "proj")
    put(root, "a.py", "def f(:\n")
    put(root, "b.py", "x = 1\n")
    engine = Engine(spark, str(tmp_path / "s"))
    key = engine.register_project(root).key

    def listed():
        engine.ingest_project(key, wait=True)
        return sorted(r.path for r in engine.ingest_errors(key).collect())

    assert listed() == ["a.py"]
    put(root, "d.py", "class :\n")
    assert listed() == ["a.py", "d.py"]  # a.py was not read again
    put(root, "a.py", "def f(): pass\n")
    assert listed() == ["d.py"]
    os.remove(f"{root}/d.py")
    assert listed() == []


def test_items_belong_to_their_project(spark, tmp_path):
    root = str(tmp_path / "proj")
    put(root, "a.md", "text")
    engine = Engine(spark, str(tmp_path / "s"))
    key = engine.register_project(root).key
    engine.ingest_items(key, [{"text": "z", "id": "1"}, {"text": "y", "id": "2", "metadata": {"project": "other", "repo_root": None}}])
    _, store = engine._store(key)
    assert sorted((r.id, r.project, r.repo_root) for r in store.read("docs").collect()) == [("1", key, root), ("2", "other", root)]
