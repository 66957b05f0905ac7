"""Sets of tables that appear together, and partitions that are replaced alone.

The tables of a set are written beside the former ones. When all are there, a manifest says so, and only then does each take
the place of its predecessor. A job that ends before leaves the former set as it was; one that ends after is completed by
whoever reads or writes the set next, so no reader that uses :func:`read_member` sees tables of two sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from steadymark.session import delete_path

#: Folders and files of a set under way; Spark does not list names with an underscore.
STAGED, MANIFEST, FORMER = "_staged-", "_manifest-", "_former-"


class _Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, of: str = "") -> list[str]:
        at = self._path(of)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def has(self, name: str) -> bool:
        return self.files.exists(self._path(name))

    def move(self, source: str, target: str) -> None:
        if not self.files.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source!r} to {target!r} in {self.root!r}")

    def make(self, name: str) -> None:
        self.files.mkdirs(self._path(name))

    def touch(self, name: str) -> None:
        self.files.create(self._path(name), True).close()

    def delete(self, name: str) -> None:
        delete_path(self.spark, f"{self.root}/{name}")


def _complete(folder: _Folder, number: str) -> None:
    """Put the tables of a decided set in place; those that are there already were moved before an interruption."""
    folder.make(f"{FORMER}{number}")
    for name in folder.names(f"{STAGED}{number}"):
        if folder.has(name):
            if folder.has(f"{FORMER}{number}/{name}"):  # moved aside before, and put in place in part
                folder.delete(name)
            else:
                folder.move(name, f"{FORMER}{number}/{name}")
        folder.move(f"{STAGED}{number}/{name}", name)
    folder.delete(f"{STAGED}{number}")
    folder.delete(f"{FORMER}{number}")
    folder.delete(f"{MANIFEST}{number}")


def recover(spark: SparkSession, root: str) -> None:
    """Complete the sets that were decided. Sets that were not are left to their writers."""
    folder = _Folder(spark, root)
    for name in folder.names():
        if name.startswith(MANIFEST):
            _complete(folder, name.removeprefix(MANIFEST))


def discard(spark: SparkSession, root: str) -> None:
    """Delete what jobs that ended early left; not while another job writes a set to ``root``."""
    recover(spark, root)
    folder = _Folder(spark, root)
    for name in folder.names():
        if name.startswith(STAGED):
            folder.delete(name)


@contextmanager
def published(spark: SparkSession, root: str) -> Iterator[str]:
    """The folder in which to write the tables of a set; at the end they replace those of the same names under ``root``.

    After an error nothing is replaced and what was written is deleted.
    """
    recover(spark, root)
    folder, number = _Folder(spark, root), uuid.uuid4().hex
    folder.make(f"{STAGED}{number}")
    try:
        yield f"{folder.root}/{STAGED}{number}"
    except BaseException:
        folder.delete(f"{STAGED}{number}")
        raise
    folder.touch(f"{MANIFEST}{number}")
    _complete(folder, number)


def read_member(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the last complete set."""
    recover(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write ``df`` by ``partitions``: those it has rows of are replaced, the others stay (a model scored anew, say)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
