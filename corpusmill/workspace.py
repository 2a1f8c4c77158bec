"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import hashlib
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made in local mode, where driver and executors are one
    process; on a cluster it is an error, because executors don't see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder; nothing may lie where it goes."""
    p, fs = _file_system(spark, path)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} was not moved to {to}")


def file_states(spark: SparkSession, files: Iterable[str]) -> str:
    """A digest of files' names, lengths and times of change: the same as long as none is written again."""
    found = hashlib.sha256()
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        p, fs = _file_system(spark, urllib.parse.unquote(folder))
        states = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p) if s.isFile())
        found.update(repr(states).encode())
    return found.hexdigest()


class Workspace:
    """Tables written once and read back: they cut lineage and outlive lost executors.

    Everything lies in one folder below the shared root, which goes when the application ends.
    ``drop`` deletes a table that no later step reads; tables behind a lazy result have to stay until
    that result has been consumed. Inside ``scope`` all folders are deleted when the block ends.
    """

    _scopes: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        p, fs = _file_system(spark, self.path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        if Workspace._scopes:
            Workspace._scopes[-1].append(self)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.folder(name))

    def close(self) -> None:
        delete(self.spark, self.path)

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """Delete the folders made inside the block at its end; results that outlive it are written elsewhere before."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for ws in cls._scopes.pop():
                ws.close()
