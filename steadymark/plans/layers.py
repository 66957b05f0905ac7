"""The layered jobs: embeddings, explanation metrics, corrupted outcomes, result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadymark.functions.arrays import as_doubles, stddev_pop
from steadymark.functions.corruption import corrupted_variants
from steadymark.functions.explanation import attention_entropy, gini_sparsity
from steadymark.operators import gold, report, stats
from steadymark.operators.learners import TrainingPlan, train
from steadymark.operators.ordered import exact_quantiles, ranked_values
from steadymark.operators.scoring import (
    LinearModels,
    Loader,
    explain_batches,
    extract_batches,
    score_batches,
    score_linear,
    silver_linear,
)
from steadymark.operators.workload import ADAPTER_RANKS, adapters, cluster_by_model, expand
from steadymark.session import cut_lineage, released
from steadymark.sources.tables import save_model, write_single_file, write_table
from steadymark.sources.tablesets import published

BRONZE = T.StructType([
    T.StructField("image_path", T.StringType()),
    T.StructField("cls", T.ArrayType(T.FloatType())),
    T.StructField("patches", T.ArrayType(T.ArrayType(T.FloatType()))),
    T.StructField("device", T.StringType()),
])


@dataclass(frozen=True)
class ImageShape:
    """Shape of the vectors, as numbers or as names of columns that hold them."""

    height: int | str
    width: int | str
    channels: int | str = 1
    pixels: bool = False

    def columns(self) -> tuple[Column | int, ...]:
        return tuple(F.col(v) if isinstance(v, str) else v for v in (self.height, self.width, self.channels))


def bronze(images: DataFrame, load: Callable, partitions: int | None = None, batch_size: int = 16) -> DataFrame:
    """Embeddings of images: class token and patch matrix, in mini-batches of one model per task."""
    return extract_batches(_placed(images, partitions), load, BRONZE, batch_size)


def _placed(images: DataFrame, partitions: int | None) -> DataFrame:
    """As they come, unless the caller names a number of partitions."""
    return images if partitions is None else images.repartition(partitions)


def silver(images: DataFrame, models: LinearModels, steps: int = 10, partitions: int | None = None) -> DataFrame:
    """Explanation metrics of every image under every model.

    ``images``: ``image_path, true_label, vector``. One image is one narrow unit of work.
    """
    rows = images.select("image_path", "true_label", as_doubles(F.col("vector")).alias("vector"))
    scored = silver_linear(_placed(rows, partitions), models, steps=steps)
    return scored.select(
        "image_path", "adapter_rank", *gold.METRICS, "confidence", "predicted_class",
        F.col("true_label").cast("string").alias("true_label"),
    )


def silver_with(
    images: DataFrame,
    loader: Loader,
    labels: Sequence[str],
    ranks: Sequence[int] = ADAPTER_RANKS,
    steps: int = 10,
    partitions: int | None = None,
    grid: tuple[int, int, int] = (0, 1, 1),
) -> DataFrame:
    """:func:`silver` for any predictor: it gives the heatmap and scores every mask.

    ``partitions`` brings the rows of a model together, each model salted over many tasks.
    """
    rows = images.select("image_path", "true_label", as_doubles(F.col("vector")).alias("vector"))
    work = cluster_by_model(expand(rows, adapters(ranks)), "image_path", partitions=partitions)
    explained = explain_batches(work, loader, steps=steps, grid=grid)
    names = F.array(*[F.lit(name) for name in labels])
    index = F.col("predicted_index")
    return explained.select(
        "image_path", "adapter_rank",
        attention_entropy(F.col("heatmap")).alias("entropy"), gini_sparsity(F.col("heatmap")).alias("sparsity"),
        "deletion_score", "insertion_score", F.coalesce(F.get(names, index), index.cast("string")).alias("predicted_class"),
        F.col("true_label").cast("string").alias("true_label"),
    )


def corrupted_images(
    images: DataFrame, shape: ImageShape, relative_noise: bool = False, partitions: int | None = None
) -> DataFrame:
    """Nine corrupted copies of every image: ``image_path, true_label, corruption_type, corruption_level, vector``.

    ``relative_noise`` measures the noise in units of each vector's deviation (the published scale
    assumes a deviation of 25), for data that are not 0..255 pixels.
    """
    size = [v for v in (shape.height, shape.width, shape.channels) if isinstance(v, str)]
    rows = images.select("image_path", "true_label", *size, as_doubles(F.col("vector")).alias("vector"))
    scale = stddev_pop(F.col("vector")) / 25.0 if relative_noise else 1.0
    variants = corrupted_variants(
        F.col("vector"), F.col("image_path"), *shape.columns(), noise_scale=scale, pixels=shape.pixels
    )
    return _placed(rows, partitions).select("image_path", "true_label", F.inline(variants))


OUTCOME = ("image_path", "corruption_type", "corruption_level", "adapter_rank", "predicted_class")


def outcomes(
    images: DataFrame,
    models: LinearModels,
    shape: ImageShape,
    relative_noise: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Correctness of every image under every corruption, severity and model.

    Images are corrupted before they meet the models, so a corrupted copy is made once, not once per
    model. No step shuffles.
    """
    corrupted = corrupted_images(images, shape, relative_noise, partitions)
    scored = score_linear(expand(corrupted, adapters(list(models.weights))), models)
    return scored.select(*OUTCOME, F.col("true_label").cast("string").alias("true_label"), "is_correct")


def outcomes_with(
    images: DataFrame,
    loader: Loader,
    labels: Sequence[str],
    shape: ImageShape,
    ranks: Sequence[int] = ADAPTER_RANKS,
    relative_noise: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """:func:`outcomes` for any predictor."""
    corrupted = corrupted_images(images, shape, relative_noise)
    work = cluster_by_model(expand(corrupted, adapters(ranks)), "image_path", partitions=partitions)
    scored = score_batches(work, loader, labels)
    return scored.select(*OUTCOME, F.col("true_label").cast("string").alias("true_label"), "is_correct")


def clean_outcomes(images: DataFrame, models: LinearModels) -> DataFrame:
    """Correctness on the untouched images."""
    rows = images.select("image_path", "true_label", as_doubles(F.col("vector")).alias("vector"))
    return score_linear(expand(rows, adapters(list(models.weights))), models)


def gold_tables(
    explanations: DataFrame, results: DataFrame, threshold: float = 0.8
) -> dict[str, DataFrame]:
    """All result tables that need no classifier, as lazy DataFrames over one cell table."""
    joined = gold.join_outcomes(explanations, results)
    return tables_from(ranked_values(joined, gold.METRICS, gold.TARGET), gold.cell_table(joined), threshold)


def tables_from(ranked: DataFrame, cells: DataFrame, threshold: float = 0.8) -> dict[str, DataFrame]:
    """The tables from ranked metric values and cells, the only two readings of the joined rows."""
    degraded = gold.degradation(cells)
    summary = gold.adapter_summary(cells)
    return {
        "base_stats": gold.base_stats(cells),
        "degradation": degraded,
        "xai_global": gold.global_profile(exact_quantiles(ranked, gold.QUARTILES), cells),
        "adapter_summary": summary,
        "corruption_impact": gold.corruption_impact(cells),
        "feature_separation": gold.feature_separation(cells),
        "xai_by_corruption": gold.by_corruption(cells),
        "worst_cases": gold.worst_cases(cells, threshold),
        "correlations": stats.correlations(gold.outcome_moments(cells), ranked),
        "quantitative_summary": report.quantitative_summary(summary, degraded),
        "adapter_ranking": gold.adapter_ranking(summary),
        "worst_corruption_per_adapter": gold.worst_corruption(degraded),
    }


def run_gold(
    explanations: DataFrame,
    results: DataFrame,
    root: str,
    threshold: float = 0.8,
    plan: TrainingPlan = TrainingPlan(),
) -> int:
    """Write all seventeen tables and the best model under ``root``.

    The joined rows are written first and read back: the table is the cut in the lineage, shared by
    every later step and safe when executors are lost. The cell table is written once too. All are written beside those of
    an earlier run and replace them together at the end. Nothing is left in the checkpoint folder. Returns the number of
    joined rows, which the cells already hold.
    """
    spark = explanations.sparkSession
    with released(spark), published(spark, root) as place:
        return _run_gold(explanations, results, place, threshold, plan)


def _run_gold(explanations: DataFrame, results: DataFrame, root: str, threshold: float, plan: TrainingPlan) -> int:
    spark = explanations.sparkSession
    write_table(gold.join_outcomes(explanations, results), f"{root}/joined_dataset.parquet")
    joined = spark.read.parquet(f"{root}/joined_dataset.parquet")
    write_single_file(gold.cell_table(joined), f"{root}/_cells.parquet")
    cells = spark.read.parquet(f"{root}/_cells.parquet")

    # Ranked once for the profile and the correlations.
    ranked = cut_lineage(ranked_values(joined, gold.METRICS, gold.TARGET))

    tables = tables_from(ranked, cells, threshold)
    for name, table in tables.items():
        write_single_file(table, f"{root}/{name}.parquet")

    trained = train(joined, plan)
    written = spark.read.parquet(f"{root}/correlations.parquet")
    for name, table in {
        "classifier_comparison": trained.comparison.drop("model_order"),
        "feature_importance": trained.importance,
        "qualitative_summary": report.qualitative_summary(written, trained.comparison),
        "xai_feature_ranking": report.feature_ranking(trained.importance),
    }.items():
        write_single_file(table, f"{root}/{name}.parquet")
    save_model(trained.pipeline(plan.features), f"{root}/meta_learner")
    return cells.agg(F.sum("n")).first()[0] or 0


def published_tables() -> Sequence[str]:
    """Names of the tables :func:`run_gold` writes."""
    return (
        "base_stats", "degradation", "xai_global", "adapter_summary", "corruption_impact", "feature_separation",
        "xai_by_corruption", "worst_cases", "correlations", "classifier_comparison", "feature_importance",
        "qualitative_summary", "quantitative_summary", "xai_feature_ranking", "adapter_ranking",
        "worst_corruption_per_adapter", "joined_dataset",
    )
