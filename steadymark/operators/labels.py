"""Class labels: taken from paths, indexed, decoded and compared.

Joins with a dictionary carry no hint. Give one whose size Spark knows, such as a written table
(:func:`~steadymark.session.cut_lineage`): it is then broadcast while it is under Spark's threshold, and the
data are not shuffled by a label that may hold a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_from_path(path: Column) -> Column:
    """Name of the directory that holds the file; NULL when there is none."""
    return F.get(F.reverse(F.split(path, "/")), F.lit(1))


def rewrite_prefix(path: Column, old: str, new: str, pattern: bool = False) -> Column:
    """Replace ``old`` by ``new``: literally, or as a regular expression when ``pattern`` is set."""
    if pattern:
        return F.regexp_replace(path, old, new)
    return F.replace(path, F.lit(old), F.lit(new))


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels with a dense 0-based index in lexicographic order.

    The window runs over one row per class, never over the data.
    """
    names = df.select(F.col(label).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    return names.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_index"))


def decode_labels(df: DataFrame, dictionary: DataFrame, index: str, name: str) -> DataFrame:
    """Add ``name``: the label of ``index``, or the index as text when the dictionary lacks it."""
    lookup = dictionary.select(F.col("label_index").alias(index), F.col("label").alias("_decoded"))
    joined = df.join(lookup, index, "left")
    return joined.withColumn(name, F.coalesce("_decoded", F.col(index).cast("string"))).drop("_decoded")


def flag_correct(df: DataFrame, dictionary: DataFrame, label: str, predicted_index: str) -> DataFrame:
    """Add ``is_correct``: 1 when the predicted index is that of the true label; an unknown label counts as wrong."""
    lookup = dictionary.select(F.col("label").alias(label), F.col("label_index").alias("_true"))
    joined = df.join(lookup, label, "left")
    flag = (F.col(predicted_index) == F.coalesce("_true", F.lit(-1))).cast("int")
    return joined.withColumn("is_correct", flag).drop("_true")
