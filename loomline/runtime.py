"""Session helpers: reading tables, and cutting lineage through the shared folder.

``spool`` writes a DataFrame as Parquet below the folder named by
``spark.checkpoint.dir`` and reads it back.  It is used wherever an
iterative plan would otherwise grow without bound: the files survive the loss
of any executor, are column-pruned on re-read and are deleted as soon as a
later round replaces them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``.

    Only a session on one machine (``local``) may do without: it gets a
    temporary folder.  On a cluster a folder that every executor sees is needed.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_root is None:
            _own_root = tempfile.mkdtemp(prefix="loomline-")
        root = f"file://{_own_root}"
    return root.rstrip("/")


class Spool:
    """A written intermediate table; ``df`` reads it, ``drop`` deletes its files."""

    def __init__(self, df: DataFrame, label: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/loomline-{label}-{uuid.uuid4().hex}"
        df.write.mode("error").option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        atexit.register(self.drop)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; safe to call twice and after the session ended."""
        atexit.unregister(self.drop)
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spool(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    return Spool(df, label).df
