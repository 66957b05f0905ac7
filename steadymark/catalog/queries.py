"""One query per operator, each over whole tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadymark.catalog import standins
from steadymark.catalog.standins import SHAPE, fact, fact_cells, images, models, table, work_images
from steadymark.functions import corruption, curves, explanation
from steadymark.functions.arrays import as_doubles, stddev_pop
from steadymark.functions.scores import argmax, linear_logits
from steadymark.operators import evaluate, gold, labels, learners, report, scoring, splits, stats, workload
from steadymark.operators.ordered import ranked_values
from steadymark.operators.quantiles import sketched_quantiles
from steadymark.plans import layers
from steadymark.session import cut_lineage, ensure_checkpoint_dir, ship_package
from steadymark.sources.tables import expand_struct, write_single_file
from steadymark.sources.tablesets import published, read_member, replace_partitions

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    """Add a query under its name; Python workers get the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    _REGISTRY[query.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round fractions and widen integers, so that two engines print the same values."""

    def column(name: str, kind: str) -> Column:
        if kind in ("float", "double"):
            return F.round(F.col(name).cast("double"), digits).alias(name)
        return F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)

    return df.select(*[column(n, k) for n, k in df.dtypes])


# ---------------------------------------------------------------- workload and labels


@register
def workload_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = workload.distinct_keys(images(spark, sf_dir), "image_path")
    return tidy(workload.model_workload(keys))


@register
def workload_ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(workload.corruption_workload(images(spark, sf_dir).select("image_path", "true_label")))


@register
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the fact per ordinal of severity."""
    rank = corruption.severity_rank(F.col("corruption_level")).alias("level_order")
    rows = standins.fact_outcomes(spark, sf_dir).groupBy("corruption_level", rank)
    return tidy(rows.agg(F.count(F.lit(1)).alias("rows")))


@register
def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(labels.label_dictionary(table(spark, sf_dir, "documents", "lang"), "lang"))


@register
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by index, decoded; source numbers serve as indices, most of them unknown."""
    documents = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    dictionary = cut_lineage(labels.label_dictionary(documents, "lang"))
    index = F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("predicted_index")
    rows = documents.select("doc_id", "lang", index)
    decoded = labels.decode_labels(rows, dictionary, "predicted_index", "predicted_class")
    return tidy(labels.flag_correct(decoded, dictionary, "lang", "predicted_index"))


@register
def path_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", labels.label_from_path(F.col("url")).alias("label")
    )


@register
def key_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id",
        labels.rewrite_prefix(url, "http://", "file:/staged/").alias("literal_key"),
        labels.rewrite_prefix(url, "^https?://[^/]+", "/staged", pattern=True).alias("pattern_key"),
    )


@register
def struct_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a struct as columns."""
    rows = table(spark, sf_dir, "pages", "page_id", "url")
    packed = rows.select(F.struct("page_id", labels.label_from_path(F.col("url")).alias("true_label")).alias("data"))
    return expand_struct(packed, "data")


# ---------------------------------------------------------------- result tables over the fact


@register
def joined_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fact(spark, sf_dir, "row_key"))


@register
def joined_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"))


@register
def unmatched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without items, and items of unknown orders."""
    explained = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_path"))
    observed = standins.fact_outcomes(spark, sf_dir)
    return gold.unmatched_counts(explained, observed, ["image_path"])


@register
def base_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.base_stats(fact_cells(spark, sf_dir)), 4)


@register
def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.degradation(fact_cells(spark, sf_dir)))


@register
def global_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = cut_lineage(fact(spark, sf_dir))
    quantiles = sketched_quantiles(joined, gold.METRICS, gold.QUARTILES)
    return tidy(gold.global_profile(quantiles, gold.cell_table(joined)), 5)


@register
def adapter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.adapter_summary(fact_cells(spark, sf_dir)), 4)


@register
def by_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.by_corruption(fact_cells(spark, sf_dir)), 4)


@register
def feature_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.feature_separation(fact_cells(spark, sf_dir)), 4)


@register
def worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.worst_cases(fact_cells(spark, sf_dir), threshold=0.56))


@register
def impact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.corruption_impact(fact_cells(spark, sf_dir)))


@register
def mean_drop_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.mean_drop_by_type(gold.degradation(fact_cells(spark, sf_dir))))


@register
def drop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.drop_summary(gold.degradation(fact_cells(spark, sf_dir))))


@register
def drop_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.drop_matrix(gold.degradation(fact_cells(spark, sf_dir))))


@register
def best_worst_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.best_worst_gap(gold.adapter_summary(fact_cells(spark, sf_dir))))


@register
def worst_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.worst_corruption(gold.degradation(fact_cells(spark, sf_dir))))


@register
def adapter_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(gold.adapter_ranking(gold.adapter_summary(fact_cells(spark, sf_dir))), 5)


@register
def quantitative_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fact_cells(spark, sf_dir)
    return report.quantitative_summary(gold.adapter_summary(cells), gold.degradation(cells))


# ---------------------------------------------------------------- statistics


@register
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = gold.outcome_moments(fact_cells(spark, sf_dir))
    return tidy(stats.effect_sizes(moments), 5)


@register
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = cut_lineage(fact(spark, sf_dir).select(*gold.METRICS, gold.TARGET))
    return tidy(stats.spearman(ranked_values(joined, gold.METRICS, gold.TARGET)))


@register
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = cut_lineage(fact(spark, sf_dir))
    table_ = stats.correlations(
        gold.outcome_moments(gold.cell_table(joined)), ranked_values(joined, gold.METRICS, gold.TARGET)
    )
    return tidy(table_.select("feature", "pearson_p", "spearman_p"), 5)


@register
def association_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = gold.outcome_moments(fact_cells(spark, sf_dir))
    return tidy(report.association_summary(stats.effect_sizes(moments)))


# ---------------------------------------------------------------- vectors: metrics and corruptions


def _heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised magnitudes of all values, for every model."""
    seen = as_doubles(F.col("vector"))
    work = workload.model_workload(images(spark, sf_dir))
    return work.select("image_path", "adapter_rank", explanation.normalise(F.transform(seen, F.abs)).alias("heatmap"))


@register
def attention_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 values as 4 heads of a class token and 15 patches each."""
    x = F.transform(as_doubles(F.col("vector")), F.abs)
    heads = F.array(*[F.slice(x, 1 + 16 * head, 16) for head in range(4)])
    maps = images(spark, sf_dir).select("image_path", explanation.attention_heatmap(heads).alias("h"))
    return tidy(maps.select("image_path", F.posexplode("h").alias("patch", "weight")))


@register
def attention_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _heatmaps(spark, sf_dir)
    return tidy(maps.select("image_path", "adapter_rank", explanation.attention_entropy(F.col("heatmap")).alias("entropy")))


@register
def gini_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _heatmaps(spark, sf_dir)
    return tidy(maps.select("image_path", "adapter_rank", explanation.gini_sparsity(F.col("heatmap")).alias("sparsity")))


def _corrupted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Values of one corruption type, one row per image, severity and position."""
    x = as_doubles(F.col("vector"))
    noise_unit = stddev_pop(x) / 25.0
    blurs = None
    if kind in ("blur", "box_blur"):
        blur = corruption.gaussian_blurs if kind == "blur" else corruption.box_blurs
        blurs = blur(x, [corruption.SEVERITIES["blur"][v] for v in corruption.LEVELS], 8, 8)
    copies = []
    for position, level in enumerate(corruption.LEVELS):
        value = corruption.SEVERITIES.get(kind, {}).get(level)
        if kind == "gaussian_noise":
            copy = corruption.gaussian_noise(x, noise_unit * value, F.col("image_path"), F.lit(kind), F.lit(level))
        elif kind == "contrast":
            copy = corruption.contrast(x, value)
        else:
            copy = F.get(blurs, F.lit(position))
        copies.append(F.struct(F.lit(level).alias("corruption_level"), copy.alias("vector")))
    rows = work_images(spark, sf_dir).select("image_path", F.inline(F.array(*copies)))
    return tidy(rows.select("image_path", "corruption_level", F.posexplode("vector").alias("i", "value")))


@register
def corrupt_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrupted(spark, sf_dir, "contrast")


@register
def corrupt_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrupted(spark, sf_dir, "gaussian_noise")


@register
def corrupt_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrupted(spark, sf_dir, "blur")


@register
def corrupt_box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blur by three extended boxes along each axis."""
    return _corrupted(spark, sf_dir, "box_blur")


# ---------------------------------------------------------------- scoring and curves


@register
def clean_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = layers.clean_outcomes(images(spark, sf_dir), models(spark, sf_dir))
    return tidy(scored.select("image_path", "adapter_rank", "predicted_class", "is_correct"))


@register
def ood_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = layers.outcomes(work_images(spark, sf_dir), models(spark, sf_dir), SHAPE, relative_noise=True)
    return tidy(results)


@register
def generalisation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = models(spark, sf_dir)
    rows = work_images(spark, sf_dir)
    clean = layers.clean_outcomes(rows, scorer)
    return tidy(gold.generalisation_gap(clean, layers.outcomes(rows, scorer, SHAPE, relative_noise=True)))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.silver(work_images(spark, sf_dir), models(spark, sf_dir))


@register
def deletion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_silver(spark, sf_dir).select("image_path", "adapter_rank", "deletion_score"))


@register
def insertion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_silver(spark, sf_dir).select("image_path", "adapter_rank", "insertion_score"))


@register
def silver_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_silver(spark, sf_dir))


@register
def patch_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves over the 16 square patches of side 2 of the whole image, under a model of all 64 values."""
    scorer = scoring.fit_centroids(images(spark, sf_dir), "vector", "true_label", ranks=[64])
    grid = curves.PatchGrid(width=8, patch=2)
    heat = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda p: F.aggregate(grid.pixels(p), F.lit(0.0), lambda acc, i: acc + F.abs(F.get("x", i))),
    )
    rows = workload.model_workload(work_images(spark, sf_dir), [64]).join(scorer.frame(spark), "adapter_rank")
    rows = rows.withColumn("x", as_doubles(F.col("vector"))).withColumn("h", explanation.normalise(heat))
    rows = rows.withColumn("target", argmax(linear_logits(F.col("x"), F.col("weights"), F.col("bias"))))
    curve = (*[F.col(c) for c in ("x", "h", "weights", "bias", "target")], 10, grid)
    return tidy(
        rows.select(
            "image_path",
            curves.deletion_score(*curve).alias("deletion_score"),
            curves.insertion_score(*curve).alias("insertion_score"),
        )
    )


@register
def robustness_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explain, corrupt, score, join and aggregate: the whole pipeline on the vectors."""
    scorer = models(spark, sf_dir)
    rows = work_images(spark, sf_dir)
    results = layers.outcomes(rows, scorer, SHAPE, relative_noise=True)
    return tidy(gold.base_stats(gold.cell_table(gold.join_outcomes(layers.silver(rows, scorer), results))))


class CentroidPredictor:
    """The linear model as an opaque Python predictor."""

    def __init__(self, weights, bias):
        self.weights, self.bias = weights, bias

    def predict(self, batch):
        return batch @ self.weights.T + self.bias

    def attend(self, batch):
        seen = np.abs(batch)
        return seen / (seen.sum(axis=1, keepdims=True) + 1e-10)


def centroid_loader(scorer: scoring.LinearModels) -> scoring.Loader:
    def load():
        built = {rank: CentroidPredictor(scorer.weights[rank], scorer.bias[rank]) for rank in scorer.weights}
        return built.get

    return load


@register
def batch_score_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = models(spark, sf_dir)
    work = workload.model_workload(work_images(spark, sf_dir))
    clustered = workload.cluster_by_model(work, "image_path")
    scored = scoring.score_batches(clustered, centroid_loader(scorer), scorer.labels)
    return tidy(scored.select("image_path", "adapter_rank", "predicted_class", "is_correct"))


@register
def batch_explain_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of an opaque predictor over given heatmaps, every mask rescored."""
    scorer = models(spark, sf_dir)
    seen = as_doubles(F.col("vector"))
    work = workload.model_workload(work_images(spark, sf_dir)).select(
        "image_path", "adapter_rank", seen.alias("vector"), explanation.normalise(F.transform(seen, F.abs)).alias("weight")
    )
    clustered = workload.cluster_by_model(work, "image_path")
    scored = scoring.explain_batches(clustered, centroid_loader(scorer), heatmap="weight")
    return tidy(scored.select("image_path", "adapter_rank", "deletion_score", "insertion_score"))


@register
def silver_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four metrics under opaque predictors of all 64 values, which give their own heatmaps."""
    scorer = scoring.fit_centroids(images(spark, sf_dir), "vector", "true_label", ranks=[64])
    rows = layers.silver_with(work_images(spark, sf_dir), centroid_loader(scorer), scorer.labels, [64])
    return tidy(rows)


@register
def ood_outcomes_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = models(spark, sf_dir)
    rows = work_images(spark, sf_dir)
    return tidy(layers.outcomes_with(rows, centroid_loader(scorer), scorer.labels, SHAPE, relative_noise=True))


def patch_extractor():
    """Stand-in for an embedding network: 4 patch vectors of 16 values, their mean as class token."""

    def extract(rows):
        patches = np.stack(rows["vector"].to_numpy()).astype(float).reshape(-1, 4, 16)
        for key, patch in zip(rows["image_path"], patches):
            yield str(key), patch.mean(axis=0).tolist(), patch.tolist(), "cpu"

    return extract


@register
def bronze_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = layers.bronze(work_images(spark, sf_dir).select("image_path", "vector"), lambda: patch_extractor())
    tokens = extracted.select("image_path", F.posexplode("cls").alias("i", "value"), F.size("patches").alias("patches"))
    return tidy(tokens)


# ---------------------------------------------------------------- splits and evaluation


@register
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fact(spark, sf_dir, "row_key")
    scaler = splits.Standardiser.fit(joined, gold.METRICS)
    return tidy(scaler.transform(joined).select("row_key", *[f"{m}_z" for m in gold.METRICS]), 4)


@register
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels", "doc_id", "quality")
    return tidy(splits.stratified_split(rows, "quality", ["doc_id"]))


@register
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels", "doc_id", "quality")
    return tidy(splits.stratified_folds(rows, "quality", ["doc_id"]))


@register
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's fold, which all its items have in common, and their number."""
    rows = standins.fact_outcomes(spark, sf_dir).select("image_path", "is_correct")
    folded = splits.grouped_parts(rows, "image_path", "is_correct", [1.0] * 5, output="fold")
    return tidy(folded.groupBy("image_path", "fold").agg(F.count(F.lit(1)).alias("rows")))


@register
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(splits.class_weights(table(spark, sf_dir, "labels", "quality"), "quality"))


@register
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluate.confusion(table(spark, sf_dir, "labels", "quality", "toxic"), "quality", "toxic"))


@register
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = layers.clean_outcomes(images(spark, sf_dir), models(spark, sf_dir))
    named = scored.withColumn("true_label", F.col("true_label").cast("string"))
    return tidy(evaluate.weighted_scores(named, "true_label", "predicted_class", ["adapter_rank"]))


def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_quantity", "l_tax", "l_returnflag").select(
        "l_returnflag", (F.col("l_quantity") / 50).alias("score"), (F.col("l_tax") <= 0.04).cast("int").alias("is_correct")
    )


@register
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = evaluate.curve_areas(_scored_rows(spark, sf_dir), "score", "is_correct", ["l_returnflag"])
    return tidy(areas.select("l_returnflag", "roc_auc"))


@register
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = evaluate.curve_areas(_scored_rows(spark, sf_dir), "score", "is_correct", ["l_returnflag"])
    return tidy(areas.select("l_returnflag", "avg_precision"))


@register
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluate.brier(_scored_rows(spark, sf_dir), "score", "is_correct", ["l_returnflag"]))


@register
def permuted_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fact(spark, sf_dir, "row_key").select("row_key", "entropy")
    return tidy(splits.permute_column(joined, ["row_key"], "entropy", repeats=2))


@register
def resource_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.resource_stats(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")


@register
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a third of the users each stand for the training run of a rank."""
    rank = F.get(F.array(*[F.lit(r) for r in workload.ADAPTER_RANKS]), (F.col("user_id") % 3).cast("int")).alias("rank")
    value, kind = F.col("value"), F.col("event_type")
    part = lambda name: F.avg((kind == name).cast("int"))
    runs = table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy(rank).agg(
        F.avg(value).alias("train_loss"), F.max(value).alias("eval_loss"), part("click").alias("accuracy"), part("view").alias("precision"),
        part("purchase").alias("recall"), part("signup").alias("f1"), F.count(F.lit(1)).cast("double").alias("duration_min"),
    )
    return tidy(report.training_table(runs))


def _shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    folder = ensure_checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4()}"


@register
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes written by adapter and type; those of one adapter are then written anew, and all are read back."""
    path = _shared_path(spark, "outcomes")
    rows = standins.fact_outcomes(spark, sf_dir).select("row_key", "adapter_rank", "corruption_type", "is_correct")
    replace_partitions(rows, path, ["adapter_rank", "corruption_type"])
    anew = rows.where("adapter_rank = 'R'").withColumn("is_correct", 1 - F.col("is_correct"))
    replace_partitions(anew, path, ["adapter_rank", "corruption_type"])
    back = spark.read.parquet(path)
    return tidy(back.groupBy("adapter_rank", "corruption_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("is_correct").alias("correct")))


@register
def table_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two small result tables published together, twice, and read back as one."""
    root = _shared_path(spark, "set")
    events = table(spark, sf_dir, "events", "event_type", "value")
    for least in (float("inf"), 0.0):  # the first set is empty
        with published(spark, root) as place:
            some = events.where(F.col("value") >= least)
            write_single_file(some.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows")), f"{place}/counts.parquet")
            write_single_file(some.groupBy("event_type").agg(F.max("value").alias("largest")), f"{place}/largest.parquet")
    counts, largest = (read_member(spark, root, f"{name}.parquet") for name in ("counts", "largest"))
    return tidy(counts.join(largest, "event_type"))


# ---------------------------------------------------------------- trained classifiers

_TRAINED: dict[tuple[str, str], learners.TrainedModels] = {}


def _trained(spark: SparkSession, sf_dir: str) -> learners.TrainedModels:
    """Trained once per application and data set; four tables are read from it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TRAINED:
        plan = learners.TrainingPlan(keys=("row_key",))
        _TRAINED[at] = learners.train(fact(spark, sf_dir, "row_key"), plan)
    return _TRAINED[at]


@register
def classifier_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_trained(spark, sf_dir).comparison.drop("model_order"), 4)


@register
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_trained(spark, sf_dir).importance, 4)


@register
def feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(report.feature_ranking(_trained(spark, sf_dir).importance), 4)


@register
def qualitative_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = stats.effect_sizes(gold.outcome_moments(fact_cells(spark, sf_dir)))
    return report.qualitative_summary(effects, _trained(spark, sf_dir).comparison)
