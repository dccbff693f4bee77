"""The package's code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to all Python workers, once a context.

    Workers unpickle functions by module name; nothing is assumed about their path.  Spark's
    own file server hands the archive out, also to executors that join or are replaced later.
    """
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, f"{package.name}/{path.relative_to(package).as_posix()}")
    context.addPyFile(str(archive))
    context._siltstone_shipped = True
