"""Expansion of a data set into the work to be scored.

The dimensions (models, corruptions) are short literal lists, so the expansion is a generator on each
row: no join, no shuffle, and a plan whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymark.functions.corruption import LEVELS, SEVERITIES

# Ranks of the published adapters.
ADAPTER_RANKS = (4, 16, 32)


def literal_dimension(rows: Sequence[Sequence], names: Sequence[str]) -> Column:
    """A small dimension as an ``array<struct>`` literal, to be expanded with :func:`expand`."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def expand(df: DataFrame, dimension: Column) -> DataFrame:
    """Every row combined with every entry of ``dimension``."""
    return df.select("*", F.inline(dimension))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Unique keys; only the key columns are read."""
    return df.select(*keys).distinct()


def adapters(ranks: Sequence[int] = ADAPTER_RANKS) -> Column:
    return literal_dimension([(rank,) for rank in ranks], ["adapter_rank"])


def corruptions() -> Column:
    rows = [(kind, level, SEVERITIES[kind][level]) for kind in SEVERITIES for level in LEVELS]
    return literal_dimension(rows, ["corruption_type", "corruption_level", "severity"])


def model_workload(images: DataFrame, ranks: Sequence[int] = ADAPTER_RANKS) -> DataFrame:
    """images x models."""
    return expand(images, adapters(ranks))


def corruption_workload(images: DataFrame, ranks: Sequence[int] = ADAPTER_RANKS) -> DataFrame:
    """images x (corruption type x severity) x models."""
    return expand(expand(images, corruptions()), adapters(ranks))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for compute-heavy work on a table of few files.

    Rows move only when the scan has fewer splits than the session has cores; a large table has more and
    is not shuffled. ``scan`` must be a plain scan: to count the partitions of a shuffle is to run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def cluster_by_model(
    df: DataFrame, key: str, model: str = "adapter_rank", partitions: int | None = None
) -> DataFrame:
    """Let a task meet each model once, so that it switches models rarely.

    Rows are ordered by model inside their partition. With ``partitions`` they are also brought
    together by model; a model may own a third of all rows, so each is salted over many partitions by
    the hash of ``key``.
    """
    if partitions is not None:
        salt = F.pmod(F.xxhash64(key), F.lit(partitions))
        df = df.repartition(partitions, F.col(model), salt)
    return df.sortWithinPartitions(model)
