"""How the given tables stand in for the pipeline's inputs.

* ``embeddings`` are 8 x 8 one-channel images with a label; model r is a nearest-centroid scorer on
  r sums of their values, and its heatmap is the magnitude of the values.
* ``lineitem`` is a large (metric, outcome) fact: groups of an order are explained, its rows are outcomes.
* ``labels``, ``documents``, ``pages`` and ``events`` serve the small operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadymark.operators.gold import cell_table, join_outcomes
from steadymark.operators.scoring import LinearModels, fit_centroids
from steadymark.operators.workload import spread
from steadymark.plans.layers import ImageShape
from steadymark.sources.tables import read_table

SHAPE = ImageShape(height=8, width=8)
#: Digits of the group means: the same multiset summed in another order stays the same value.
MEAN_DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", *columns)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_path"), F.col("label").alias("true_label"), F.col("embedding").alias("vector")
    )


def work_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`images` for heavy work per row."""
    return spread(images(spark, sf_dir))


def models(spark: SparkSession, sf_dir: str) -> LinearModels:
    return fit_centroids(images(spark, sf_dir), "vector", "true_label")


def fact_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "entropy": "l_quantity", "sparsity": "l_discount", "deletion_score": "l_tax", "insertion_score": "l_extendedprice"
    }
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("image_path"), F.col("l_returnflag").alias("adapter_rank"))
        .agg(*[F.round(F.avg(source), MEAN_DIGITS).alias(metric) for metric, source in sources.items()])
    )


def fact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_path"),
        F.col("l_returnflag").alias("adapter_rank"),
        F.col("l_linestatus").alias("corruption_type"),
        F.when(quantity <= 17, "shallow").when(quantity <= 34, "medium").otherwise("heavy").alias("corruption_level"),
        (F.col("l_tax") <= 0.04).cast("int").alias("is_correct"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
    )


def fact(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    return join_outcomes(fact_explanations(spark, sf_dir), fact_outcomes(spark, sf_dir), carry=carry)


def fact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_table(fact(spark, sf_dir))
