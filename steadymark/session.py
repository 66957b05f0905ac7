"""Session settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are bounded by bytes, not only by rows: one row may hold a whole image.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join whose build side proves small in every partition at run time need not sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "steadymark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` entries (dots as ``__``) win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = SETTINGS | {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master gets a temporary folder when none is named; on a cluster a machine-local
    folder would be lost with its machine, so there the jobs go on without checkpoints.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            return None
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared checkpoint folder and read back from there.

    The written table survives the loss of executors, is read by column, and later plans start from a
    plain scan. Without a checkpoint folder the rows are only kept on the executors and recomputed
    where one is lost.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if folder is None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        _held(kept)
        return kept
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4()}"
    _held(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What the open scopes of :func:`released` hold, the innermost last: paths and persisted frames.
_SCOPES: list[list[str | DataFrame]] = []


def _held(what: str | DataFrame) -> None:
    if _SCOPES:
        _SCOPES[-1].append(what)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Whatever :func:`cut_lineage` keeps inside is let go at the end, after errors too.

    Results that are used later must have been written or collected by then. Scopes may be nested; threads started
    inside one belong to it.
    """
    scope: list[str | DataFrame] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        # By identity: two empty scopes are equal.
        del _SCOPES[next(i for i, held in enumerate(_SCOPES) if held is scope)]
        for what in scope:
            if isinstance(what, str):
                delete_path(spark, what)
            else:
                what.unpersist()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions started without ``--py-files``.

    Spark distributes the archive itself; doing it once per application is enough.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(root))
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
