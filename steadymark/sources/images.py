"""Image folders: listing, labels from directory names, decoding to pixel arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadymark.operators.labels import label_dictionary, label_from_path
from steadymark.session import cut_lineage


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )


#: All image files, whatever the case of their suffix.
IMAGES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def scan_images(spark: SparkSession, root: str, patterns: tuple[str, ...] = (IMAGES,)) -> DataFrame:
    """Files under ``root`` as ``image_path, true_label, length``; the content is not read.

    By default all image files. Of several patterns the first that matches any file is used.
    """
    for pattern in patterns:
        files = _files(spark, root, pattern).select("path", "length")
        if not files.isEmpty():
            return files.select(F.col("path").alias("image_path"), label_from_path(F.col("path")).alias("true_label"), "length")
    raise FileNotFoundError(f"no files like {', '.join(patterns)} under {root}")


def image_dataset(spark: SparkSession, root: str, patterns: tuple[str, ...] = (IMAGES,)) -> DataFrame:
    """:func:`scan_images` with ``label_index``, the dense index of the directory name."""
    files = scan_images(spark, root, patterns)
    dictionary = cut_lineage(label_dictionary(files, "true_label").withColumnRenamed("label", "true_label"))
    return files.join(dictionary, "true_label", "left").select("image_path", "true_label", "label_index", "length")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _pixels(data: pd.Series, channels: pd.Series) -> pd.Series:
    def decode(raw: bytes, c: int) -> np.ndarray:
        flat = np.frombuffer(raw, dtype=np.uint8).reshape(-1, c)
        if c == 1:
            flat = flat.repeat(3, axis=1)
        return flat[:, 2::-1].astype(np.float32).reshape(-1)  # stored blue first; a fourth (alpha) value is dropped

    return pd.Series([decode(raw, c) for raw, c in zip(data, channels)])


def pixel_array(image: str = "image") -> Column:
    """Row-major RGB values of a decoded image struct; a grey image is repeated on three channels."""
    return _pixels(F.col(f"{image}.data"), F.col(f"{image}.nChannels"))


def decode_images(
    spark: SparkSession, root: str, pattern: str = IMAGES, observation: Observation | None = None
) -> DataFrame:
    """Decoded images as ``image_path, true_label, height, width, channels, vector``.

    The JVM decodes. Files that are no images are dropped; an ``observation`` counts what was ``read``
    and what was ``dropped``.
    """
    images = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    broken = (F.col("image.height") <= 0) | F.col("image.height").isNull()
    if observation is not None:
        images = images.observe(observation, F.count(F.lit(1)).alias("read"), F.count_if(broken).alias("dropped"))
    path = F.col("image.origin")
    return images.where(~broken).select(
        path.alias("image_path"),
        label_from_path(path).alias("true_label"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.lit(3).alias("channels"),
        pixel_array().alias("vector"),
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; no rows when the path does not exist."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
