"""Robustness tables over (explanation metric, outcome) rows.

Every table here but the quantiles is a function of counts, means and squared deviations per
(adapter, corruption, severity, outcome). :func:`cell_table` computes those in one pass with map-side
combination; the tables are roll-ups of its few rows, so the joined data is read once however many
tables are wanted and never has to be cached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadymark.functions.corruption import LEVELS

# Column names of the published tables.
METRICS = ("entropy", "sparsity", "deletion_score", "insertion_score")
CELL = ("adapter_rank", "corruption_type", "corruption_level")
JOIN_KEYS = ("image_path", "adapter_rank")
TARGET = "is_correct"


def short(metric: str) -> str:
    """Column stem of a metric in the per-group tables."""
    return metric.removesuffix("_score")


def join_outcomes(
    explanations: DataFrame,
    outcomes: DataFrame,
    keys: Sequence[str] = JOIN_KEYS,
    metrics: Sequence[str] = METRICS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Inner join of metrics (one row per key) with outcomes (many per key).

    No hint and no counting: Spark broadcasts the metrics when their size is under its threshold,
    otherwise both sides are shuffled by the keys and AQE splits a hot key's partition.
    """
    left = outcomes.select(*keys, "corruption_type", "corruption_level", TARGET, *carry)
    return left.join(explanations.select(*keys, *metrics), list(keys), "inner")


def unmatched_counts(explanations: DataFrame, outcomes: DataFrame, keys: Sequence[str] = JOIN_KEYS) -> DataFrame:
    """Rows that :func:`join_outcomes` drops: ``(side, unmatched_rows)``.

    Both sides are reduced to row counts per key before they meet.
    """
    count = F.count(F.lit(1))
    left = explanations.groupBy(*keys).agg(count.alias("_l"))
    right = outcomes.groupBy(*keys).agg(count.alias("_r"))
    both = left.join(right, list(keys), "full").agg(
        F.sum(F.when(F.col("_r").isNull(), F.col("_l"))).alias("explanations"),
        F.sum(F.when(F.col("_l").isNull(), F.col("_r"))).alias("outcomes"),
    )
    return both.selectExpr(
        "stack(2, 'explanations', coalesce(explanations, 0), 'outcomes', coalesce(outcomes, 0)) AS (side, unmatched_rows)"
    )


def cell_table(
    joined: DataFrame, keys: Sequence[str] = CELL, metrics: Sequence[str] = METRICS, target: str = TARGET
) -> DataFrame:
    """Sufficient statistics per cell and outcome: rows, and per metric its count, mean, sum of squared
    deviations, minimum and maximum."""
    stats: list[Column] = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        x = F.col(m).cast("double")
        stats += [
            F.count(x).alias(f"n_{m}"),
            F.avg(x).alias(f"mean_{m}"),
            (F.var_pop(x) * F.count(x)).alias(f"ss_{m}"),
            F.min(x).alias(f"min_{m}"),
            F.max(x).alias(f"max_{m}"),
        ]
    return joined.groupBy(*keys, target).agg(*stats)


def roll_up(
    cells: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS, target: str = TARGET
) -> DataFrame:
    """Combine cells into the groups of ``by``: ``n``, ``positives`` and per metric ``n_``, ``mean_``,
    ``ss_``, ``min_``, ``max_``. Deviations are combined around the group mean, so nothing cancels."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    centred = cells.select(
        "*",
        *[
            F.try_divide(F.sum(F.col(f"mean_{m}") * F.col(f"n_{m}")).over(group), F.sum(f"n_{m}").over(group)).alias(
                f"centre_{m}"
            )
            for m in metrics
        ],
    )
    stats: list[Column] = [
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col(target)).alias("positives"),
    ]
    for m in metrics:
        gap = F.col(f"mean_{m}") - F.col(f"centre_{m}")
        stats += [
            F.sum(f"n_{m}").alias(f"n_{m}"),
            F.max(f"centre_{m}").alias(f"mean_{m}"),
            F.sum(F.col(f"ss_{m}") + F.col(f"n_{m}") * gap * gap).alias(f"ss_{m}"),
            F.min(f"min_{m}").alias(f"min_{m}"),
            F.max(f"max_{m}").alias(f"max_{m}"),
        ]
    return centred.groupBy(*by).agg(*stats)


def sample_std(metric: str) -> Column:
    """Sample standard deviation from a roll-up; NULL for a single row."""
    return F.sqrt(F.try_divide(F.col(f"ss_{metric}"), F.col(f"n_{metric}") - 1))


def population_std(metric: str) -> Column:
    return F.sqrt(F.try_divide(F.col(f"ss_{metric}"), F.col(f"n_{metric}")))


def _accuracy() -> Column:
    return F.try_divide(F.col("positives"), F.col("n"))


def base_stats(cells: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per cell: means and sample deviations of the metrics, accuracy, counts, entropy variance."""
    first = metrics[0]
    return roll_up(cells, CELL, metrics).select(
        *CELL,
        *[F.col(f"mean_{m}").alias(f"mean_{short(m)}") for m in metrics],
        *[sample_std(m).alias(f"std_{short(m)}") for m in metrics],
        _accuracy().alias("accuracy"),
        F.col("positives").alias("correct_count"),
        F.col("n").alias("total_count"),
        F.try_divide(F.col(f"ss_{first}"), F.col(f"n_{first}") - 1).alias(f"var_{short(first)}"),
        (1.0 - _accuracy()).alias("error_rate"),
    )


def accuracy_by(cells: DataFrame, by: Sequence[str], target: str = TARGET) -> DataFrame:
    n, hits = F.sum("n"), F.sum(F.col("n") * F.col(target))
    return cells.groupBy(*by).agg(F.try_divide(hits, n).alias("accuracy"))


def degradation(cells: DataFrame, by: Sequence[str] = ("adapter_rank", "corruption_type"), target: str = TARGET) -> DataFrame:
    """Accuracy by severity side by side and its drops; ``drop_pct`` is NULL when ``shallow`` is 0."""

    def at(level: str) -> Column:
        chosen = F.col("corruption_level") == level
        hits = F.sum(F.when(chosen, F.col("n") * F.col(target)))
        return F.try_divide(hits, F.sum(F.when(chosen, F.col("n")))).alias(level)

    drop = F.col("shallow") - F.col("heavy")
    return (
        cells.groupBy(*by)
        .agg(*[at(level) for level in LEVELS])
        .select(
            "*",
            drop.alias("drop_shallow_heavy"),
            (F.try_divide(drop, F.col("shallow")) * 100).alias("drop_pct"),
            (F.col("shallow") - F.col("medium")).alias("drop_shallow_medium"),
            (F.col("medium") - F.col("heavy")).alias("drop_medium_heavy"),
        )
    )


#: Shares of the profile's quantiles: median and quartiles.
QUARTILES = (0.5, 0.25, 0.75)


def global_profile(quantiles: DataFrame, cells: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row: mean, std, min, max, median and quartiles of every metric over all joined rows.

    ``quantiles`` are those of the joined rows for :data:`QUARTILES`, by
    :func:`~steadymark.operators.quantiles.sketched_quantiles` or, where ranks are needed anyway, by
    :func:`~steadymark.operators.ordered.exact_quantiles`.
    """
    moments = roll_up(cells, [], metrics)
    per_feature = F.array(*[
        F.struct(
            F.lit(m).alias("feature"),
            F.col(f"mean_{m}").alias("mean"),
            sample_std(m).alias("std"),
            F.col(f"min_{m}").alias("min"),
            F.col(f"max_{m}").alias("max"),
        )
        for m in metrics
    ])
    table = moments.select(F.inline(per_feature)).join(quantiles, "feature")
    columns = {"mean": "mean", "std": "std", "min": "min", "max": "max", "median": "q_0", "q25": "q_1", "q75": "q_2"}
    return table.agg(*[
        F.max(F.when(F.col("feature") == m, F.col(source))).alias(f"{name}_{m}")
        for name, source in columns.items()
        for m in metrics
    ])


def adapter_summary(cells: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per adapter, in numeric order of rank."""
    first = metrics[0]
    return (
        roll_up(cells, ["adapter_rank"], metrics)
        .select(
            "adapter_rank",
            _accuracy().alias("accuracy"),
            *[F.col(f"mean_{m}").alias(f"mean_{short(m)}") for m in metrics],
            sample_std(first).alias(f"std_{short(first)}"),
            F.col("n").alias("n_samples"),
        )
        .orderBy(F.expr("try_cast(adapter_rank AS INT)"), "adapter_rank")
    )


def by_corruption(cells: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    keys = ["corruption_type", "corruption_level"]
    return roll_up(cells, keys, metrics).select(
        *keys,
        *[F.col(f"mean_{m}").alias(f"mean_{short(m)}") for m in metrics],
        _accuracy().alias("accuracy"),
        F.col("n").alias("n_samples"),
    )


def outcome_moments(cells: DataFrame, metrics: Sequence[str] = METRICS, target: str = TARGET) -> DataFrame:
    """One row per metric: ``n1 mean1 ss1`` over correct rows and ``n0 mean0 ss0`` over wrong ones."""
    per_outcome = roll_up(cells, [target], metrics, target)
    entries = F.array(*[
        F.struct(
            F.lit(m).alias("feature"),
            F.col(f"n_{m}").alias("n"),
            F.col(f"mean_{m}").alias("mean"),
            F.col(f"ss_{m}").alias("ss"),
        )
        for m in metrics
    ])
    long = per_outcome.select(target, F.inline(entries))
    return long.groupBy("feature").agg(*[
        F.max(F.when(F.col(target) == side, F.col(c))).alias(f"{c}{side}") for side in (1, 0) for c in ("n", "mean", "ss")
    ])


def feature_separation(cells: DataFrame, metrics: Sequence[str] = METRICS, target: str = TARGET) -> DataFrame:
    """One row: mean and sample deviation of every metric over correct and over wrong rows."""
    moments = outcome_moments(cells, metrics, target)

    def pick(m: str, value: Column) -> Column:
        return F.max(F.when(F.col("feature") == m, value))

    columns = []
    for name, side in (("correct", 1), ("wrong", 0)):
        spread = F.sqrt(F.try_divide(F.col(f"ss{side}"), F.col(f"n{side}") - 1))
        columns += [pick(m, F.col(f"mean{side}")).alias(f"{m}_{name}_mean") for m in metrics]
        columns += [pick(m, spread).alias(f"{m}_{name}_std") for m in metrics]
    return moments.agg(*columns)


def worst_cases(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Cells with an accuracy strictly below ``threshold``, the worst first."""
    return accuracy_by(cells, CELL).where(F.col("accuracy") < threshold).orderBy("accuracy", *CELL)


def corruption_impact(cells: DataFrame) -> DataFrame:
    """Corruption types of each adapter ranked from the lowest accuracy."""
    order = Window.partitionBy("adapter_rank").orderBy("accuracy", "corruption_type")
    return accuracy_by(cells, ["adapter_rank", "corruption_type"]).withColumn("impact_rank", F.row_number().over(order))


def adapter_ranking(summary: DataFrame, columns: Sequence[str] = ("mean_entropy", "mean_sparsity")) -> DataFrame:
    """Adapters by falling accuracy, numbered from 1."""
    order = Window.orderBy(F.desc("accuracy"), "adapter_rank")
    return summary.select("adapter_rank", "accuracy", *columns, F.row_number().over(order).alias("rank"))


def worst_corruption(table: DataFrame) -> DataFrame:
    """Per adapter the corruption type with the largest ``drop_pct``; the first by name on ties."""
    order = Window.partitionBy("adapter_rank").orderBy(F.desc_nulls_last("drop_pct"), "corruption_type")
    ranked = table.where("drop_pct IS NOT NULL").withColumn("_place", F.row_number().over(order))
    return ranked.where("_place = 1").select(
        "adapter_rank", F.col("corruption_type").alias("worst_corruption"), F.col("drop_pct").alias("max_drop_pct")
    )


def mean_drop_by_type(table: DataFrame) -> DataFrame:
    """Mean ``drop_pct`` per corruption type, the largest first."""
    return (
        table.groupBy("corruption_type").agg(F.avg("drop_pct").alias("mean_drop_pct")).orderBy(F.desc("mean_drop_pct"))
    )


def drop_summary(table: DataFrame) -> DataFrame:
    """Extremes and mean of ``drop_pct`` with the cell of the maximum (first by key on ties)."""
    cells = table.where("drop_pct IS NOT NULL")
    largest = F.min_by(F.struct("adapter_rank", "corruption_type"), F.struct(-F.col("drop_pct"), "adapter_rank", "corruption_type"))
    return cells.agg(
        F.max("drop_pct").alias("max_drop_pct"),
        F.min("drop_pct").alias("min_drop_pct"),
        F.avg("drop_pct").alias("mean_drop_pct"),
        largest.alias("_worst"),
    ).select(
        "max_drop_pct",
        "min_drop_pct",
        "mean_drop_pct",
        F.col("_worst.adapter_rank").alias("worst_adapter"),
        F.col("_worst.corruption_type").alias("worst_type"),
    )


def drop_matrix(table: DataFrame, adapters: Sequence | None = None) -> DataFrame:
    """Corruption types as rows, adapters as columns ``drop_<adapter>``, ``drop_pct`` as value.

    Without ``adapters`` all of the table, read from it in order.
    """
    if adapters is None:
        adapters = sorted(row[0] for row in table.select("adapter_rank").where("adapter_rank IS NOT NULL").distinct().collect())
    return table.groupBy("corruption_type").agg(*[
        F.max(F.when(F.col("adapter_rank") == a, F.col("drop_pct"))).alias(f"drop_{a}") for a in adapters
    ])


def best_worst_gap(summary: DataFrame) -> DataFrame:
    """Best and worst adapter by accuracy and their distance in percentage points (first by key on ties)."""
    return summary.agg(
        F.min_by("adapter_rank", F.struct(-F.col("accuracy"), F.col("adapter_rank"))).alias("best_adapter"),
        F.max("accuracy").alias("best_accuracy"),
        F.min_by("adapter_rank", F.struct("accuracy", "adapter_rank")).alias("worst_adapter"),
        F.min("accuracy").alias("worst_accuracy"),
        ((F.max("accuracy") - F.min("accuracy")) * 100).alias("gap_points"),
    )


def generalisation_gap(clean: DataFrame, corrupted: DataFrame, target: str = TARGET) -> DataFrame:
    """Accuracy on clean and on corrupted inputs per adapter, matched by key, and the gap in points."""
    left = clean.groupBy("adapter_rank").agg(F.avg(target).alias("clean_accuracy"))
    right = corrupted.groupBy("adapter_rank").agg(F.avg(target).alias("corrupted_accuracy"))
    gap = (F.col("clean_accuracy") - F.col("corrupted_accuracy")) * 100
    return left.join(right, "adapter_rank").withColumn("gap_points", gap)
