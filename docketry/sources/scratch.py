"""A place for files that go again: in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own() -> str:
    folder = tempfile.mkdtemp(prefix="docketry-files-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return where or _own()


class Folder:
    """A new folder for small files written by the driver; removed at exit."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared(spark)}/docketry/files-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(at)
        atexit.register(self._remove, self._files, at)

    @staticmethod
    def _remove(files, at) -> None:
        try:
            files.delete(at, True)
        except Exception:  # the virtual machine is gone: nothing can be removed any more
            return

    def put(self, name: str, body: str | bytes) -> str:
        path = f"{self.path}/{name}"
        out = self._files.create(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        out.write(bytearray(body.encode() if isinstance(body, str) else body))
        out.close()
        return path
