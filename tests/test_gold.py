"""Result tables: definitions, edge cases, and independence of row order and partitioning."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadymark.catalog import standins
from steadymark.functions.corruption import LEVELS
from steadymark.operators import gold, labels, report, workload


@pytest.fixture(scope="module")
def joined(spark, sf_dir):
    df = standins.fact(spark, sf_dir).cache()
    yield df
    df.unpersist()


def outcomes(spark, *rows):
    """Rows of (adapter, type, level, correct) with the same metric values."""
    return spark.createDataFrame(
        [(f"img{i}", *row, 0.5, 0.5, 0.5, 0.5) for i, row in enumerate(rows)],
        "image_path string, adapter_rank string, corruption_type string, corruption_level string, is_correct int, "
        "entropy double, sparsity double, deletion_score double, insertion_score double",
    )


def test_rolled_up_cells_equal_direct_aggregates(joined):
    direct = (
        joined.groupBy("adapter_rank")
        .agg(F.avg("entropy").alias("m"), F.stddev("entropy").alias("s"), F.avg("is_correct").alias("a"), F.count("*").alias("n"))
        .toPandas().set_index("adapter_rank")
    )
    summary = gold.adapter_summary(gold.cell_table(joined)).toPandas().set_index("adapter_rank")
    for ours, theirs in {"mean_entropy": "m", "std_entropy": "s", "accuracy": "a", "n_samples": "n"}.items():
        pd.testing.assert_series_equal(summary[ours].sort_index(), direct[theirs].sort_index(), check_names=False)


def test_deviation_survives_a_large_mean(spark):
    """Squared deviations are combined around the group mean, so a large offset does not cancel them."""
    rows = [("a", "t", level, i % 2) for i, level in enumerate(LEVELS * 4)]
    df = outcomes(spark, *rows).withColumn("entropy", F.lit(1e9) + F.rand(1))
    got = gold.adapter_summary(gold.cell_table(df)).first()["std_entropy"]
    assert got == pytest.approx(df.agg(F.stddev("entropy")).first()[0], rel=1e-6)


def test_degradation_does_not_depend_on_the_partitioning(joined):
    table = lambda df: gold.degradation(gold.cell_table(df)).orderBy("adapter_rank", "corruption_type").toPandas()
    pd.testing.assert_frame_equal(table(joined), table(joined.repartition(17, F.rand(3))))


def test_drop_is_null_when_nothing_was_right(spark):
    df = outcomes(spark, ("a", "t", "shallow", 0), ("a", "t", "heavy", 0), ("b", "t", "shallow", 1), ("b", "t", "heavy", 0))
    rows = {r["adapter_rank"]: r for r in gold.degradation(gold.cell_table(df)).collect()}
    assert rows["a"]["drop_pct"] is None and rows["a"]["medium"] is None
    assert rows["b"]["drop_pct"] == 100.0
    worst = gold.worst_corruption(gold.degradation(gold.cell_table(df))).collect()
    assert [(r["adapter_rank"], r["worst_corruption"]) for r in worst] == [("b", "t")]


def test_adapters_are_ordered_by_number(spark):
    df = outcomes(spark, *[(rank, "t", "shallow", 1) for rank in ("16", "4", "32")])
    summary = gold.adapter_summary(gold.cell_table(df))
    assert [r["adapter_rank"] for r in summary.collect()] == ["4", "16", "32"]
    assert summary.first()["std_entropy"] is None


def test_ties_are_broken_by_key(spark):
    df = outcomes(spark, ("a", "y", "shallow", 1), ("a", "x", "shallow", 1))
    got = {r["corruption_type"]: r["impact_rank"] for r in gold.corruption_impact(gold.cell_table(df)).collect()}
    assert got == {"x": 1, "y": 2}


def test_threshold_is_strict(spark):
    df = outcomes(spark, ("a", "t", "shallow", 1), ("a", "t", "shallow", 0), ("b", "t", "shallow", 0))
    cells = gold.cell_table(df)
    assert [r["adapter_rank"] for r in gold.worst_cases(cells, 0.5).collect()] == ["b"]
    assert gold.worst_cases(cells, 0.8).count() == 2


def test_a_missing_outcome_leaves_nulls(spark):
    df = outcomes(spark, ("a", "t", "shallow", 1), ("a", "t", "medium", 1))
    row = gold.feature_separation(gold.cell_table(df)).first()
    assert row["entropy_correct_mean"] == 0.5 and row["entropy_wrong_mean"] is None


def test_unmatched_rows_are_counted(spark):
    schema = "image_path string, adapter_rank int"
    left = spark.createDataFrame([("a", 4), ("b", 4)], schema)
    right = spark.createDataFrame([("a", 4), ("a", 4), ("c", 4), ("c", 4), ("c", 16)], schema)
    got = {r["side"]: r["unmatched_rows"] for r in gold.unmatched_counts(left, right).collect()}
    assert got == {"explanations": 1, "outcomes": 3}


def test_gap_is_matched_by_adapter(spark):
    clean = spark.createDataFrame([(4, 1), (4, 1), (16, 0)], "adapter_rank int, is_correct int")
    corrupted = spark.createDataFrame([(16, 0), (4, 1), (4, 0)], "adapter_rank int, is_correct int")
    got = {r["adapter_rank"]: r["gap_points"] for r in gold.generalisation_gap(clean, corrupted).collect()}
    assert got == {4: 50.0, 16: 0.0}


def test_workload_size_is_the_product(spark):
    images = spark.range(37).withColumnRenamed("id", "image_path")
    work = workload.corruption_workload(images)
    assert work.count() == 37 * 9 * 3
    assert work.distinct().count() == 37 * 9 * 3


def test_label_order_is_lexicographic(spark):
    df = spark.createDataFrame([(v,) for v in ("10", "2", "a", "B", "1", "2")], "c string")
    assert {r["label"]: r["label_index"] for r in labels.label_dictionary(df, "c").collect()} == {
        v: i for i, v in enumerate(sorted({"10", "2", "a", "B", "1"}))
    }


def test_unknown_labels_are_wrong_and_indices_without_name_stay_numbers(spark):
    dictionary = spark.createDataFrame([("cat", 0), ("dog", 1)], "label string, label_index int")
    df = spark.createDataFrame([("cat", 0), ("cat", 1), ("fox", 0), ("dog", 7)], "true_label string, p int")
    rows = labels.decode_labels(labels.flag_correct(df, dictionary, "true_label", "p"), dictionary, "p", "name").collect()
    assert sorted((r["true_label"], r["name"], r["is_correct"]) for r in rows) == [
        ("cat", "cat", 1), ("cat", "dog", 0), ("dog", "7", 0), ("fox", "cat", 0),
    ]


def test_path_helpers(spark):
    df = spark.createDataFrame([("file:/data/a.b/cats/1.jpg",), ("x.jpg",)], "p string")
    rows = df.select(
        labels.label_from_path(F.col("p")).alias("l"),
        labels.rewrite_prefix(F.col("p"), "a.b", "z").alias("k"),
    ).collect()
    assert [tuple(r) for r in rows] == [("cats", "file:/data/z/cats/1.jpg"), (None, "x.jpg")]


def test_training_table(spark):
    run = spark.createDataFrame(
        [("t", 16, 0.3, 0.1, 0.9, 0.8, 0.7, 0.6, 36.0), ("t", 5, 0.3, 0.1, 0.9, 0.8, 0.7, 0.6, 1.0)],
        "timestamp string, rank int, train_loss double, eval_loss double, accuracy double, precision double, "
        "recall double, f1 double, duration_min double",
    )
    rows = {r["Rank"]: r for r in report.training_table(run).collect()}
    assert rows[16]["Alpha"] == 32 and rows[16]["Trainable Params"] == "2.25M" and rows[16]["F1 Score"] == 0.6
    assert rows[5]["Trainable Params"] is None and len(rows[5]) == 11


def test_resource_stats_without_values(spark):
    df = spark.createDataFrame([("gpu", None), ("cpu", 1.234), ("cpu", 3.0)], "series string, value double")
    got = {r["series"]: (r["avg_value"], r["max_value"]) for r in report.resource_stats(df, "series", "value").collect()}
    assert got == {"gpu": (0.0, 0.0), "cpu": (2.12, 3.0)}
