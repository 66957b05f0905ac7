"""Parquet, CSV-log and model sinks, and the matching readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the two logs, in file order.
RUN_LOG = (
    "Timestamp string, Images long, Batch int, Device string, Duration_Sec string, Img_Per_Sec string, "
    "GPU_Avg double, GPU_Max double, RAM_Avg double, RAM_Max double, CPU_Avg double, "
    "Spark_Driver_Mem string, Spark_OffHeap string"
)
TRAINING_LOG = (
    "timestamp string, rank int, train_loss double, eval_loss double, accuracy double, precision double, "
    "recall double, f1 double, duration_min double"
)


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan of the named columns only."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def expand_struct(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column as columns of their own."""
    return df.select(f"{column}.*")


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """A few rows to look at, whichever come first; Spark stops reading once it has them."""
    return df.limit(rows)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_single_file(df: DataFrame, path: str) -> None:
    """One Parquet file, for result tables of a few rows."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A table clustered by its join keys: two tables bucketed alike join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def _append(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def log_run(
    spark: SparkSession,
    path: str,
    images: int,
    batch: int,
    device: str,
    seconds: float,
    resources: Mapping[str, float] | None = None,
) -> None:
    """Append one row about a run. ``images`` comes from an ``Observation`` on the job, not a count."""
    resources = resources or {}
    conf = spark.sparkContext.getConf()
    rate = images / seconds if seconds > 0 else 0.0
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.lit(images).cast("long").alias("Images"),
        F.lit(batch).alias("Batch"),
        F.lit(device).alias("Device"),
        F.format_string("%.2f", F.lit(float(seconds))).alias("Duration_Sec"),
        F.format_string("%.2f", F.lit(float(rate))).alias("Img_Per_Sec"),
        *[
            F.lit(float(resources.get(name, 0.0))).alias(name)
            for name in ("GPU_Avg", "GPU_Max", "RAM_Avg", "RAM_Max", "CPU_Avg")
        ],
        F.lit(conf.get("spark.driver.memory", "N/A")).alias("Spark_Driver_Mem"),
        F.lit(conf.get("spark.memory.offHeap.size", "N/A")).alias("Spark_OffHeap"),
    )
    _append(row, path)


def log_training(spark: SparkSession, path: str, rank: int, train_loss: float, evaluation: Mapping[str, float], minutes: float) -> None:
    """Append one training run; metrics missing from ``evaluation`` are logged as 0."""
    named = {name: float(evaluation.get(name, 0.0)) for name in ("eval_loss", "accuracy", "precision", "recall", "f1")}
    fixed = lambda value, digits: F.format_string(f"%.{digits}f", F.lit(float(value)))
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(rank).alias("rank"),
        fixed(train_loss, 4).alias("train_loss"),
        *[fixed(value, 4).alias(name) for name, value in named.items()],
        fixed(minutes, 2).alias("duration_min"),
    )
    _append(row, path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
