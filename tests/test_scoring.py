"""Scoring by opaque predictors, and its faults."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadymark.catalog import standins
from steadymark.catalog.queries import CentroidPredictor, centroid_loader
from steadymark.functions import curves, explanation
from steadymark.functions.scores import argmax, linear_logits
from steadymark.operators import scoring, workload
from steadymark.plans import layers


@pytest.fixture(scope="module")
def models(spark, sf_dir):
    return standins.models(spark, sf_dir)


def test_centroids_equal_numpy(spark, sf_dir, models):
    rows = standins.images(spark, sf_dir).toPandas()
    for k, name in enumerate(models.labels):
        mine = np.stack(rows[rows["true_label"] == int(name)]["vector"].to_numpy()).astype(float).mean(axis=0)
        for rank in models.weights:
            folded = np.array([mine[j::rank].sum() for j in range(rank)])
            assert models.weights[rank][k] == pytest.approx(folded[np.arange(64) % rank])
            assert models.bias[rank][k] == pytest.approx(-0.5 * (folded**2).sum())


def test_every_model_sees_the_last_value(spark, models):
    base = [0.01 * i for i in range(64)]
    changed = [*base[:-1], base[-1] + 3.0]
    for rank in models.weights:
        predictor = CentroidPredictor(models.weights[rank], models.bias[rank])
        scores = predictor.predict(np.array([base, changed]))
        assert not np.allclose(scores[0], scores[1])
    df = spark.createDataFrame([(1, "0", base), (2, "0", changed)], "image_path int, true_label string, vector array<double>")
    got = {(r["image_path"], r["adapter_rank"]): r["confidence"] for r in layers.silver(df, models).collect()}
    assert all(got[1, rank] != got[2, rank] for rank in models.weights)


def test_rows_without_a_label_are_not_learned_from(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 2.0]), (None, [9.0, 9.0])], "l string, v array<double>")
    fitted = scoring.fit_centroids(df, "v", "l", ranks=[2])
    assert fitted.labels == ("a",) and fitted.weights[2].tolist() == [[2.0, 2.0]]


def test_too_many_classes_are_refused(spark, sf_dir):
    with pytest.raises(ValueError, match="more than 3 classes"):
        scoring.fit_centroids(standins.images(spark, sf_dir), "vector", "true_label", max_classes=3)


def test_models_are_joined_by_shuffle_when_large(spark, models, monkeypatch):
    plan = lambda: models.frame(spark)._jdf.queryExecution().toString()
    assert "broadcast" in plan().lower()
    monkeypatch.setattr(scoring, "MAX_BROADCAST_BYTES", 10)
    assert "broadcast" not in plan().lower()


def test_rows_of_a_missing_model_are_left_out_and_counted(spark, sf_dir, models):
    work = workload.model_workload(standins.images(spark, sf_dir), [4, 8])
    scored = scoring.score_batches(work, centroid_loader(models), models.labels)
    assert scored.groupBy("adapter_rank").count().collect() == [(4, 500)]
    skipped = scoring.unserved_models(work, list(models.weights)).collect()
    assert [(r["adapter_rank"], r["skipped_rows"]) for r in skipped] == [(8, 500)]


def test_a_failing_loader_stops_the_job(spark, sf_dir):
    def broken():
        raise RuntimeError("no weights here")

    work = workload.model_workload(standins.images(spark, sf_dir))
    with pytest.raises(Exception, match="no weights here"):
        scoring.score_batches(work, broken, ["0"]).count()


def test_a_model_is_built_once_per_task_and_switched_rarely(spark, sf_dir):
    counter = spark.sparkContext.accumulator(0)

    def load():
        def get(rank):
            counter.add(1)
            return CentroidPredictor(np.zeros((2, 64)), np.zeros(2))

        return get

    work = workload.cluster_by_model(workload.model_workload(standins.images(spark, sf_dir)), "image_path", partitions=6)
    scored = scoring.score_batches(work, load, ["0", "1"], batch_size=50)
    assert scored.count() == 1500
    assert counter.value <= 6 * 3


def test_unknown_true_label_is_wrong(spark, models):
    df = spark.createDataFrame([("a", "nobody", [0.1] * 64)], "image_path string, true_label string, vector array<double>")
    rows = layers.clean_outcomes(df, models).collect()
    assert [r["is_correct"] for r in rows] == [0, 0, 0]
    opaque = scoring.score_batches(workload.model_workload(df), centroid_loader(models), models.labels).collect()
    assert {r["adapter_rank"]: r["predicted_class"] for r in opaque} == {r["adapter_rank"]: r["predicted_class"] for r in rows}


def test_opaque_curves_equal_linear_ones_on_a_patch_grid(spark):
    rng = np.random.default_rng(11)
    weights, bias = rng.normal(size=(4, 60)), rng.normal(size=4)
    images = [(i, 7, rng.normal(size=60).tolist(), rng.random(4).tolist()) for i in range(20)]
    df = spark.createDataFrame(images, "id int, adapter_rank int, vector array<double>, heatmap array<double>")

    def load():
        return {7: CentroidPredictor(weights, bias)}.get

    # 4 rows of 5 pixels, three channels, patches of side 2: one column is in no patch.
    opaque = scoring.explain_batches(df, load, heatmap="heatmap", grid=(5, 2, 3)).toPandas().set_index("id").sort_index()
    w, b = F.lit(weights.tolist()), F.lit(bias.tolist())
    target = argmax(linear_logits(F.col("vector"), w, b))
    args = (F.col("vector"), F.col("heatmap"), w, b, F.col("t"), 10, curves.PatchGrid(width=5, patch=2, channels=3))
    linear = df.withColumn("t", target).select(
        "id", "t", curves.deletion_score(*args).alias("d"), curves.insertion_score(*args).alias("i")
    ).toPandas().set_index("id").sort_index()
    assert opaque["predicted_index"].tolist() == linear["t"].tolist()
    assert opaque["deletion_score"].to_numpy() == pytest.approx(linear["d"].to_numpy())
    assert opaque["insertion_score"].to_numpy() == pytest.approx(linear["i"].to_numpy())


def test_embeddings_skip_unreadable_inputs(spark):
    """A batch function may return fewer rows than it got."""
    def load():
        def extract(rows):
            return [(p, [1.0, 2.0], [[0.5], [0.25]], "cpu") for p in rows["image_path"] if not p.endswith("bad")]

        return extract

    paths = spark.createDataFrame([(f"img{i}",) for i in range(9)] + [("img.bad",)], "image_path string")
    got = layers.bronze(paths, load, partitions=3)
    assert got.schema == layers.BRONZE and got.count() == 9
    assert isinstance(got.schema["patches"].dataType.elementType, T.ArrayType)


def test_chained_arrays_are_evaluated_once(spark):
    """The heatmap is bound before its elements are divided by its sum."""
    df = spark.range(10).select(F.array(*[F.lit(float(i)) for i in range(1, 400)]).alias("x"))
    assert df.select(F.sum(explanation.attention_entropy(explanation.normalise(F.col("x"))))).first()[0] > 0


def test_a_model_stage_asks_for_devices(spark, sf_dir, models):
    """The plan of each model stage carries the profile; other stages keep the session's executors."""
    profile = scoring.device_profile(amount=2, kind="gpu")
    assert {k: r.amount for k, r in profile.taskResources.items()} == {"cpus": 1, "gpu": 2} and profile.executorResources["gpu"].amount == 2
    work = workload.model_workload(standins.images(spark, sf_dir))
    load = centroid_loader(models)
    schema = T.StructType().add("n", T.LongType())
    for stage in (
        scoring.score_batches(work, load, models.labels, profile=profile),
        scoring.explain_batches(work, load, profile=profile),
        scoring.extract_batches(work, lambda: lambda rows: [(len(rows),)], schema, profile=profile),
    ):
        held = stage._jdf.queryExecution().analyzed().profile()
        assert held.isDefined() and held.get().id() == profile.id
    assert not scoring.score_batches(work, load, models.labels)._jdf.queryExecution().analyzed().profile().isDefined()


def test_a_task_without_a_device_says_so(spark, sf_dir, models, monkeypatch):
    work = workload.model_workload(standins.images(spark, sf_dir))
    for scored in (
        scoring.score_batches(work, centroid_loader(models), models.labels, device="device"),
        scoring.explain_batches(work.limit(20), centroid_loader(models), device="device"),
    ):
        assert [r["device"] for r in scored.select("device").distinct().collect()] == ["cpu"] and scored.columns[-1] == "device"

    class Given:
        def resources(self):
            return {"gpu": type("Resource", (), {"addresses": ["3", "4"]})()}

    assert scoring.task_device() == "cpu"
    monkeypatch.setattr(scoring.TaskContext, "get", classmethod(lambda cls: Given()))
    assert scoring.task_device() == "gpu:3" and scoring.task_device("fpga") == "cpu"
