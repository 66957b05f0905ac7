"""Batch scoring of a workload by several models.

Two routes give the same answer. A linear model (:class:`LinearModels`) is scored by array expressions
in the JVM. Any other model is a Python object with a ``predict`` method and is called on Arrow batches,
built once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadymark.functions.arrays import as_doubles
from steadymark.functions.curves import PatchGrid, deletion_score, insertion_score
from steadymark.functions.explanation import EPSILON, attention_entropy, gini_sparsity, normalise
from steadymark.functions.scores import argmax, linear_logits, softmax_at
from steadymark.operators.workload import ADAPTER_RANKS, model_workload

#: A fitted model is collected to the driver, so the number of classes is checked first.
MAX_CLASSES = 10_000
#: Parameters above this size are joined by shuffle instead of broadcast.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class LinearModels:
    """One linear model per adapter rank, with a weight for every value of a vector."""

    labels: tuple[str, ...]
    weights: Mapping[int, np.ndarray]
    bias: Mapping[int, np.ndarray]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per model, hinted for broadcast while its parameters are small."""
        rows = [(rank, list(self.labels), self.bias[rank].tolist(), self.weights[rank].tolist()) for rank in self.weights]
        schema = "adapter_rank int, labels array<string>, bias array<double>, weights array<array<double>>"
        models = spark.createDataFrame(rows, schema)
        size = sum(w.nbytes for w in self.weights.values())
        return F.broadcast(models) if size <= MAX_BROADCAST_BYTES else models


def fit_centroids(
    df: DataFrame, vector: str, label: str, ranks: Sequence[int] = ADAPTER_RANKS, max_classes: int = MAX_CLASSES
) -> LinearModels:
    """Nearest-centroid models of rank r: a vector is mapped to r values, z_j = sum of x_i with i mod r = j, and
    ``logit_k = z . c_k - |c_k|^2 / 2`` with the class means c of z.

    As the map is linear, a model is kept as weights of all values of x. The class means are one partial
    aggregation; only one row per class reaches the driver. Rows without a label are not learned from.
    """
    means = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("string").alias("label"))
        .agg(vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col(vector))))).alias("centre"))
        .take(max_classes + 1)
    )
    if len(means) > max_classes:
        raise ValueError(f"more than {max_classes} classes in column {label!r}")
    means = sorted(means, key=lambda row: row["label"])
    centres = np.array([row["centre"] for row in means])
    weights, bias = {}, {}
    for rank in ranks:
        place = np.arange(centres.shape[1]) % rank
        folded = np.stack([centres[:, place == j].sum(axis=1) for j in range(rank)], axis=1)
        weights[rank], bias[rank] = folded[:, place], -0.5 * (folded * folded).sum(axis=1)
    return LinearModels(tuple(row["label"] for row in means), weights, bias)


def score_linear(workload: DataFrame, models: LinearModels, vector: str = "vector", label: str = "true_label") -> DataFrame:
    """Add ``predicted_index``, ``predicted_class`` and ``is_correct`` for each (row, adapter)."""
    joined = workload.join(models.frame(workload.sparkSession), "adapter_rank")
    scored = joined.withColumn("predicted_index", argmax(linear_logits(F.col(vector), F.col("weights"), F.col("bias"))))
    # array_position is 0 for an unknown label: its index becomes -1, which no prediction equals.
    truth = F.array_position("labels", F.col(label).cast("string")) - 1
    return (
        scored.withColumn(
            "predicted_class",
            F.coalesce(F.get("labels", F.col("predicted_index")), F.col("predicted_index").cast("string")),
        )
        .withColumn("is_correct", (F.col("predicted_index") == truth).cast("int"))
        .drop("labels", "bias", "weights")
    )


def silver_linear(
    images: DataFrame,
    models: LinearModels,
    vector: str = "vector",
    steps: int = 10,
    grid: PatchGrid | None = None,
) -> DataFrame:
    """images x models with entropy, sparsity, deletion and insertion score of one heatmap.

    The heatmap is the normalised magnitude of the values; the curves follow the
    confidence in the *predicted* class. The whole step is one narrow projection per image.
    """
    workload = model_workload(images, list(models.weights)).join(models.frame(images.sparkSession), "adapter_rank")
    x, h, weights, bias, predicted = (F.col(c) for c in ("_x", "_h", "weights", "bias", "predicted_index"))
    curve = (x, h, weights, bias, predicted, steps, grid)
    return (
        workload.withColumn("_x", F.col(vector))
        .withColumns({"_h": normalise(F.transform(x, F.abs)), "_logits": linear_logits(x, weights, bias)})
        .withColumn("predicted_index", argmax(F.col("_logits")))
        .select(
            *images.columns,
            "adapter_rank",
            "predicted_index",
            attention_entropy(h).alias("entropy"),
            gini_sparsity(h).alias("sparsity"),
            deletion_score(*curve).alias("deletion_score"),
            insertion_score(*curve).alias("insertion_score"),
            softmax_at(F.col("_logits"), predicted).alias("confidence"),
            F.get("labels", predicted).alias("predicted_class"),
        )
    )


class Predictor(Protocol):
    """A model as the executors see it: a batch of vectors in, one row of logits each out.

    ``attend`` gives one normalised heatmap per vector; only explanations need it.
    """

    def predict(self, batch: np.ndarray) -> np.ndarray: ...

    def attend(self, batch: np.ndarray) -> np.ndarray: ...


def task_device(kind: str = "gpu") -> str:
    """The device that Spark gave this task, ``gpu:0`` say; ``cpu`` where it has none."""
    context = TaskContext.get()
    given = context.resources().get(kind) if context is not None else None
    return f"{kind}:{given.addresses[0]}" if given is not None and given.addresses else "cpu"


def device_profile(amount: int = 1, kind: str = "gpu", cpus: int = 1, script: str = "", vendor: str = "") -> ResourceProfile:
    """What a model stage asks for: executors and tasks with ``amount`` devices. Other stages keep the session's executors."""
    executors = ExecutorResourceRequests().resource(kind, amount, script, vendor)
    tasks = TaskResourceRequests().cpus(cpus).resource(kind, amount)
    return ResourceProfileBuilder().require(executors).require(tasks).build


#: Builds the models in the task: called once per partition, returns ``load(rank) -> Predictor | None``.
Loader = Callable[[], Callable[[int], Predictor | None]]


def _by_model(batches: Iterator[pd.DataFrame], loader: Loader, model: str) -> Iterator[tuple[Predictor, pd.DataFrame]]:
    """Groups of one model each; a model is loaded when it is first needed and kept until another one is."""
    load = loader()
    active: int | None = None
    predictor: Predictor | None = None
    for batch in batches:
        for rank, group in batch.groupby(model, sort=True):
            if rank != active:
                predictor, active = load(int(rank)), rank
            if predictor is not None:
                yield predictor, group


def score_batches(
    workload: DataFrame,
    loader: Loader,
    labels: Sequence[str],
    vector: str = "vector",
    label: str = "true_label",
    model: str = "adapter_rank",
    batch_size: int = 1024,
    profile: ResourceProfile | None = None,
    device: str | None = None,
) -> DataFrame:
    """:func:`score_linear` for any predictor. Rows of a model the loader does not know are left out;
    see :func:`unserved_models`. A loader that fails stops the job. ``profile`` asks for executors with devices for this stage
    alone (:func:`device_profile`); the column ``device`` tells which one a row was scored on."""
    index = {name: i for i, name in enumerate(labels)}
    kept = [f.name for f in workload.schema.fields if f.name != vector]
    schema = (
        workload.select(*kept).schema
        .add("predicted_index", T.IntegerType())
        .add("predicted_class", T.StringType())
        .add("is_correct", T.IntegerType())
    )
    schema = schema if device is None else schema.add(device, T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for predictor, group in _by_model(batches, loader, model):
            for start in range(0, len(group), batch_size):
                chunk = group.iloc[start : start + batch_size]
                logits = predictor.predict(np.stack(chunk[vector].to_numpy()))
                best = logits.argmax(axis=1)
                truth = chunk[label].astype(str).map(index).fillna(-1).to_numpy()
                yield chunk[kept].assign(
                    **({} if device is None else {device: task_device()}),
                    predicted_index=best,
                    predicted_class=[labels[i] if i < len(labels) else str(i) for i in best],
                    is_correct=(best == truth).astype(int),
                )

    return workload.mapInPandas(run, schema, profile=profile)


def explain_batches(
    workload: DataFrame,
    loader: Loader,
    vector: str = "vector",
    heatmap: str | None = None,
    model: str = "adapter_rank",
    steps: int = 10,
    batch_size: int = 256,
    grid: tuple[int, int, int] = (0, 1, 1),
    profile: ResourceProfile | None = None,
    device: str | None = None,
) -> DataFrame:
    """Deletion and insertion scores of any predictor: every mask is scored again.

    The heatmap is the column ``heatmap`` or, without one, the predictor's ``attend``; it is returned as
    ``heatmap``. ``profile`` and ``device`` are those of :func:`score_batches`. ``grid`` is (image width, patch size, channels); width 0 makes every value its own patch.
    """
    kept = [f.name for f in workload.schema.fields if f.name not in (vector, heatmap)]
    schema = (
        workload.select(*kept).schema
        .add("predicted_index", T.IntegerType())
        .add("heatmap", T.ArrayType(T.DoubleType()))
        .add("deletion_score", T.DoubleType())
        .add("insertion_score", T.DoubleType())
    )
    schema = schema if device is None else schema.add(device, T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for predictor, group in _by_model(batches, loader, model):
            # Models may differ in the number of values they see, so a chunk holds one width.
            for _, same in group.groupby(group[vector].map(len)):
                for start in range(0, len(same), batch_size):
                    chunk = same.iloc[start : start + batch_size]
                    images = np.stack(chunk[vector].to_numpy()).astype(float)
                    heat = predictor.attend(images) if heatmap is None else np.stack(chunk[heatmap].to_numpy())
                    target, deletion, insertion = _masked_scores(predictor, images, heat, steps, grid)
                    yield chunk[kept].assign(
                        **({} if device is None else {device: task_device()}),
                        predicted_index=target, heatmap=list(heat), deletion_score=deletion, insertion_score=insertion
                    )

    return workload.mapInPandas(run, schema, profile=profile)


def _masked_scores(
    predictor: Predictor, images: np.ndarray, heat: np.ndarray, steps: int, grid: tuple[int, int, int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, patches = heat.shape
    width, side, channels = grid
    position = np.arange(images.shape[1])
    if width:
        pixel = position // channels
        down, across = pixel // width // side, pixel % width // side
        whole = (across < width // side) & (down * (width // side) + across < patches)
        patch_of = np.where(whole, down * (width // side) + across, patches)
    else:
        patch_of = position
    size = max(1, patches // steps)
    place = np.argsort(np.argsort(-heat, axis=1, kind="stable"), axis=1, kind="stable")
    turn = np.concatenate([place // size, np.full((rows, 1), patches)], axis=1)[:, patch_of]
    fill = images.reshape(rows, -1, channels).mean(axis=1)[:, position % channels]
    target = predictor.predict(images).argmax(axis=1)

    def confidence(batch: np.ndarray) -> np.ndarray:
        logits = predictor.predict(batch)
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds[np.arange(rows), target] / odds.sum(axis=1)

    done = range(-(-patches // size) + 1)
    removed = np.stack([confidence(np.where(turn < n, fill, images)) for n in done], axis=1)
    revealed = np.stack([confidence(np.where(turn < n, images, 0.0)) for n in done], axis=1)
    area = lambda s: (s.sum(axis=1) - (s[:, 0] + s[:, -1]) / 2) / (s.shape[1] - 1)
    return target, area(removed) / np.maximum(removed[:, 0], EPSILON), area(revealed)


def extract_batches(
    images: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], Iterable[tuple]]],
    schema: T.StructType,
    batch_size: int = 256,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Embedding extraction: ``load()`` runs once per task and returns ``extract(rows) -> records``.

    ``extract`` may return fewer records than it got, so an unreadable input does not fail its batch. With ``profile`` the
    stage asks for devices; ``load`` learns its own from :func:`task_device`.
    """
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = load()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                records = list(extract(batch.iloc[start : start + batch_size]))
                if records:
                    yield pd.DataFrame.from_records(records, columns=names)

    return images.mapInPandas(run, schema, profile=profile)


def unserved_models(workload: DataFrame, known: Sequence[int], model: str = "adapter_rank") -> DataFrame:
    """Rows per requested model that no loaded model serves."""
    return workload.where(~F.col(model).isin(list(known))).groupBy(model).agg(F.count(F.lit(1)).alias("skipped_rows"))
