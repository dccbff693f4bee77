"""Small driver-side files in any store that Hadoop reaches: pointers, manifests' markers."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def qualified(self, path: str) -> str:
        """``path`` with the scheme and host of the default file system where it names none."""
        fs, where = self._at(path)
        return fs.makeQualified(where).toString()

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        fs, where = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def read_json(self, path: str) -> Any:
        """None if the file is missing or is not JSON."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def write_json(self, path: str, value: Any) -> None:
        """Replaced as a whole: written beside and renamed over, so it is never missing."""
        self._put(path, value, "OVERWRITE")

    def create_json(self, path: str, value: Any) -> None:
        """As :meth:`write_json`, but ``FileExistsError`` if the file is there already."""
        self._put(path, value, "NONE")

    def _put(self, path: str, value: Any, mode: str) -> None:
        fs, where = self._at(path)
        _, beside = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.valueOf(mode)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        try:
            context.rename(fs.makeQualified(beside), fs.makeQualified(where), options)
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError(path) from None
            raise
