import threading

from siltstone.llm import common as C


def test_tables_of_other_threads_stay(spark):
    began, made, found = threading.Event(), threading.Event(), {}

    def other():
        began.wait(60)
        found["df"] = C.materialize(spark.range(5).toDF("id"), "other")
        made.set()

    thread = threading.Thread(target=other)
    thread.start()
    with C.temporary():
        mine = C.materialize(spark.range(3).toDF("id"), "mine")
        began.set()
        assert made.wait(60)
    thread.join()
    assert found["df"].count() == 5
    assert not C.Files(spark).exists(mine.stored_at)


def test_writes_of_several_threads_restore_the_setting(spark):
    before = spark.conf.get(C._CLEAN, None)
    threads = [threading.Thread(target=lambda: C.materialize(spark.range(20).repartition(2), "race")) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(C._CLEAN, None) == before and not C._held


def test_folders_without_a_scheme_are_of_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = C.Files(spark)
    assert C.local_form(files.qualified("/some/where")) == "/some/where"
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.elsewhere.link./some", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    try:
        assert files.qualified("/some/where") == "viewfs://elsewhere/some/where"
        assert C.local_form(files.qualified("/some/where")) is None
    finally:
        conf.set("fs.defaultFS", before)
