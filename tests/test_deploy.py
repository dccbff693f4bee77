"""Workers must not depend on the folder that the driver runs in."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import siltstone.queries as Q
from siltstone.sources import tree
print("ROWS", Q.QUERIES["js_symbols"](spark, "/root/testdata/sf0.001").count(), tree.list_files(spark, {repo!r}, ["siltstone/functions"]).count())
"""


def test_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 450 3" in out.stdout, out.stderr[-2000:]
