"""Whole jobs: training, the seventeen tables, and the plans they run as."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadymark import session
from steadymark.catalog import standins
from steadymark.operators import gold, learners
from steadymark.plans import layers
from steadymark.sources.tables import load_model

TINY = {
    learners.FOREST: {"trees": 3, "depth": 4},
    learners.BOOSTED: {"trees": 2, "depth": 3},
    learners.TUNED: {"trees": 2},
}


@pytest.fixture(scope="module")
def signal(spark):
    """1,500 rows whose entropy decides most outcomes, in the shape of the joined table."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        x = rng.normal(size=4)
        level = ("shallow", "medium", "heavy")[i % 3]
        rows.append((f"img{i // 9}", str((4, 16, 32)[i % 9 // 3]), f"type{i % 2}", level, f"{i}", int(x[0] + 0.4 * rng.normal() > 0), *map(float, x)))
    schema = (
        "image_path string, adapter_rank string, corruption_type string, corruption_level string, row_id string, "
        "is_correct int, entropy double, sparsity double, deletion_score double, insertion_score double"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def trained(signal):
    plan = learners.TrainingPlan(keys=("row_id",), params=TINY, folds=2, permutations=2)
    return learners.train(signal, plan)


def test_learners_find_the_signal(trained):
    rows = {r["model"]: r for r in trained.comparison.collect()}
    assert set(rows) == set(learners.MODELS)
    for row in rows.values():
        assert row["roc_auc"] > 0.8 and row["cv_auc_mean"] > 0.8 and 0 <= row["cv_auc_std"] < 0.1
        assert row["tp"] + row["tn"] + row["fp"] + row["fn"] in (300, 301)
    best = max(rows.values(), key=lambda r: (r["roc_auc"], -r["model_order"]))
    assert trained.best == best["model"]


def test_importances_point_to_the_signal(trained):
    rows = trained.importance.collect()
    assert rows[0]["feature"] == "entropy" and rows[0]["perm_importance"] > 0.1
    assert rows[0]["lr_odds_ratio"] == pytest.approx(np.exp(rows[0]["lr_coef"])) and rows[0]["lr_coef"] > 0
    assert sum(r["rf_importance"] for r in rows) == pytest.approx(1.0)


def test_saved_model_scores_raw_rows(trained, signal, tmp_path):
    from steadymark.sources.tables import save_model

    path = str(tmp_path / "model")
    save_model(trained.pipeline(), path)
    save_model(trained.pipeline(), path)
    scored = load_model(path).transform(signal)
    assert scored.where("prediction = is_correct").count() > 1200


def test_one_class_cannot_be_trained_on(signal):
    with pytest.raises(ValueError, match="both outcomes"):
        learners.train(signal.withColumn("is_correct", F.lit(1)), learners.TrainingPlan(keys=("row_id",), params=TINY, folds=2))


def test_published_settings_are_the_default():
    plan = learners.TrainingPlan()
    forest, boosted, tuned = (learners.settings_of(n, plan) for n in (learners.FOREST, learners.BOOSTED, learners.TUNED))
    ridge = learners.logistic("y", 1000, learners.settings_of(learners.LOGISTIC, plan))
    assert (forest.trees, forest.depth, forest.least_split, forest.least_leaf) == (200, 12, 5, 2)
    assert (boosted.trees, boosted.depth, boosted.rate, boosted.alpha, boosted.ridge) == (200, 6, 0.1, 0.1, 1.0)
    assert (tuned.trees, tuned.least_gain, tuned.least_hessian, tuned.alpha, tuned.ridge) == (300, 0.1, 3.0, 0.5, 2.0)
    assert ridge.getRegParam() == pytest.approx(1 / (0.1 * 1000)) and not ridge.getStandardization()


def kept_files(spark):
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith(("table-", "model-"))}


def test_kept_tables_are_released(spark):
    before = kept_files(spark)
    with pytest.raises(ZeroDivisionError), session.released(spark):
        kept = session.cut_lineage(spark.range(5))
        with session.released(spark):
            session.cut_lineage(spark.range(3))
            assert len(kept_files(spark) - before) == 2
        assert len(kept_files(spark) - before) == 1 and kept.count() == 5
        raise ZeroDivisionError
    assert kept_files(spark) == before
    session.cut_lineage(spark.range(2))
    assert len(kept_files(spark) - before) == 1  # outside a scope a table stays


def test_gold_job_writes_every_table(spark, signal, tmp_path):
    before = kept_files(spark)
    explanations = signal.groupBy("image_path", "adapter_rank").agg(*[F.avg(m).alias(m) for m in gold.METRICS])
    results = signal.select("image_path", "adapter_rank", "corruption_type", "corruption_level", "is_correct")
    root = str(tmp_path / "gold")
    plan = learners.TrainingPlan(params=TINY, folds=2, permutations=1)
    assert layers.run_gold(explanations, results, root, plan=plan) == 1500
    assert kept_files(spark) == before
    counts = {name: spark.read.parquet(f"{root}/{name}.parquet").count() for name in layers.published_tables()}
    assert len(counts) == 17 and counts["joined_dataset"] == 1500
    assert counts["adapter_summary"] == 3 and counts["correlations"] == 4 and counts["qualitative_summary"] == 5
    assert counts["quantitative_summary"] == 4 and counts["classifier_comparison"] == 4 and counts["base_stats"] == 18
    columns = spark.read.parquet(f"{root}/correlations.parquet").columns
    assert "pearson_p" in columns and "spearman_p" in columns and "point_biserial_r" in columns
    assert len(spark.read.parquet(f"{root}/xai_global.parquet").columns) == 28
    assert load_model(f"{root}/meta_learner").stages


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_an_image_never_shuffles(spark, sf_dir):
    images, models = standins.images(spark, sf_dir), standins.models(spark, sf_dir)
    explained = plan_of(layers.silver(images, models, partitions=None).drop("true_label"))
    assert explained.count("Exchange") - explained.count("BroadcastExchange") <= 1  # at most the spread of a small input
    big = images.repartition(64)
    results = plan_of(layers.outcomes(big, models, standins.SHAPE, relative_noise=True))
    assert results.count("Exchange RoundRobin") == 1  # the one above, none added
    assert results.count("Exchange hashpartitioning") == 0 and results.count("SortMergeJoin") == 0
    assert results.count("ArrowEvalPython") == 1


def test_cell_table_combines_before_its_shuffle(spark, signal):
    text = plan_of(gold.cell_table(signal))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_avg" in text


def test_a_hot_key_is_split_in_the_join(spark):
    """Half of the outcomes belong to one key: AQE splits its partition and no row is lost."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        results = spark.range(0, 60000, 1, 8).select(
            hot.alias("image_path"), F.lit(4).alias("adapter_rank"), F.md5(F.col("id").cast("string")).alias("corruption_type"),
            F.lit("shallow").alias("corruption_level"), F.lit(1).alias("is_correct"),
        )
        explanations = results.select("image_path", "adapter_rank").distinct().select(
            "*", *[F.lit(0.5).alias(m) for m in gold.METRICS]
        ).repartition(5)
        joined = gold.join_outcomes(explanations, results)
        assert len(joined.collect()) == 60000
        assert "skew=true" in plan_of(joined)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_checkpoint_folder_of_the_session_is_used(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.ensure_checkpoint_dir(spark) == named
    kept = session.cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert kept.count() == 10 and kept.inputFiles()[0].startswith(f"file://{named}/table-")


def test_registered_training_has_published_sizes(monkeypatch):
    from types import SimpleNamespace

    from steadymark.catalog import queries

    plans = []
    monkeypatch.setattr(queries, "_TRAINED", {})
    monkeypatch.setattr(queries, "fact", lambda *a: None)
    monkeypatch.setattr(queries.learners, "train", lambda rows, plan: plans.append(plan))
    queries._trained(SimpleNamespace(sparkContext=SimpleNamespace(applicationId="a")), "sf")
    assert not plans[0].params
