"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="corpusmill-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], True)
    return f"file://{_LOCAL_DIR[0]}"


class Scratch:
    """Parquet tables of one operator run.

    A table written here survives the loss of any executor, and reading it starts a new, short
    lineage. ``drop`` removes tables that no later plan reads; what is left goes when the process ends, on
    every file system.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        """Delete a folder while the session lives; without one, only a folder of this machine."""
        sc = self.spark.sparkContext
        if sc._jsc is not None and sc._jvm is not None:
            try:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
                return
            except Exception:  # the gateway is gone already
                pass
        if path.startswith("file://"):
            shutil.rmtree(path[7:], True)
